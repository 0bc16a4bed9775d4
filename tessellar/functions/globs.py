"""Glob patterns as regular expressions, and sets of ignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is ignored where a workspace names nothing.
DEFAULT_IGNORES = ("**/.git", "**/node_modules", "**/target", "**/dist")


def glob_regex(glob: str, separator: bool = True) -> str:
    """The regular expression of a glob; with ``separator`` a single ``*`` or ``?`` does not cross ``/``."""
    out, i, n = "", 0, len(glob)
    one = "[^/]" if separator else "."
    while i < n:
        c = glob[i]
        if c == "*":
            j = i
            while j < n and glob[j] == "*":
                j += 1
            if j - i >= 2 and separator:
                if j < n and glob[j] == "/" and (i == 0 or glob[i - 1] == "/"):
                    out += "(?:.*/)?"
                    i = j + 1
                    continue
                out += ".*"
            else:
                out += f"{one}*" if j - i == 1 else ".*"
            i = j
            continue
        if c == "?":
            out += one
        elif c == "[":
            j = glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "^", "]") else i + 1)
            if j < 0:
                out += r"\["
            else:
                body = glob[i + 1 : j].replace("\\", r"\\")
                out += "[" + ("^" + body[1:] if body[:1] in ("!", "^") else body) + "]"
                i = j
        elif c == "{":
            j = glob.find("}", i)
            if j < 0:
                out += r"\{"
            else:
                out += "(?:" + "|".join(glob_regex(g, separator)[1:-1] for g in glob[i + 1 : j].split(",")) + ")"
                i = j
        elif c == "\\" and i + 1 < n:
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def ignore_patterns(lines: list[str]) -> list[str]:
    """The globs of an ignore file: blank lines and # comments dropped, bare names meant at any depth."""
    out = []
    for line in lines:
        glob = line.strip()
        if not glob or glob.startswith("#"):
            continue
        glob = glob.removesuffix("/")
        out.append(glob if "/" in glob else f"**/{glob}")
    return out


def ignored(path: Column | str, globs: list[str]) -> Column:
    """Whether a path or a directory above it matches one of the globs; the root never does."""
    c = F.col(path) if isinstance(path, str) else path
    if not globs:
        return F.lit(False)
    union = "|".join(glob_regex(g)[1:-1] for g in globs)
    return (c != "") & c.rlike(f"^(?:{union})(?:/.*)?$")


def ignore_rules(lines: list[str], base: str = "") -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern of whole paths, ignores, directories only) of each line of a version-control ignore file in the folder ``base``.

    A later rule overrides an earlier one; ``!`` takes a path in again; a slash before the end binds a rule to the folder.
    """
    front = re.escape(base.strip("/") + "/") if base.strip("/") else ""
    out = []
    for line in lines:
        text = line.rstrip("\r\n")
        text = text.rstrip() if not text.endswith("\\ ") else text
        if not text or text.startswith("#"):
            continue
        ignores = not text.startswith("!")
        text = text if ignores else text[1:]
        folder = text.endswith("/")
        text = text.rstrip("/")
        glob = text.lstrip("/") if "/" in text else f"**/{text}"
        if glob:
            out.append((re.compile(front + glob_regex(glob)[1:-1] + r"\Z"), ignores, folder))
    return out


def decision(path: str, folder: bool, rules: list[tuple[re.Pattern, bool, bool]]) -> bool | None:
    """Whether the last rule that fits a path ignores it; None where none fits."""
    return next((ignores for pattern, ignores, only in reversed(rules) if (folder or not only) and pattern.match(path)), None)
