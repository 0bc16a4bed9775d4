"""Index blocks at the top of code files and outlines in the frontmatter of markdown files, written in place.

A code file gets, after its preamble (comments, imports, package clause), a comment block with its
path and a row for each symbol and its line; earlier blocks are taken out first and lines count as
they are after the block is in, so writing twice changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessellar.operators import markdown
from tessellar.operators.code.facts import FAMILY, facts_of, language_of

# Fixed values of the layout.
COMMENT = {"python": "#", "rust": "//", "script": "//", "go": "//"}
GAP = 4
#: A block is looked for this far down at least.
SEARCH = 256
BULLETS = {1: "• ", 2: "  ◦ ", 3: "    ▪ ", 4: "      · "}
CALLABLE = ("fn", "method", "constructor", "getter", "setter", "macro")
ROW = re.compile(r" L\d+$")
PATH_HEADER = re.compile(r"^[^\s/][^\s]*\.[A-Za-z0-9]+$")

#: First words of lines that belong to a preamble, by family; continued lines are followed to their end.
STARTS = {
    "rust": re.compile(r"#!\[|(?:pub(?:\([^)]*\))?\s+)?use\s|(?:pub(?:\([^)]*\))?\s+)?mod\s+\w+\s*;|extern\s+crate\s"),
    "script": re.compile(r"import\b(?!\s*\()|(?:const|let|var)\s.*\brequire\s*\(|export\s+(?:\*|\{[^}]*\}|\{).*|['\"]use \w+['\"]"),
    "python": re.compile(r"(?:import|from)\s"),
    "go": re.compile(r"package\s|import\b"),
}


def split_lines(source: str) -> tuple[list[str], str, bool]:
    """Lines, the line end in use, and whether the last line is ended."""
    newline = "\r\n" if "\r\n" in source else "\n"
    lines = [x.rstrip("\r") for x in source.split("\n")]
    ended = source.endswith("\n")
    if ended and lines and not lines[-1]:
        lines.pop()
    return ([] if lines == [""] else lines), newline, ended


def preamble_end(lines: list[str], family: str) -> int:
    """The number of lines of the preamble; comments that stand directly above a declaration are not part of it."""
    end, i, n = 0, 0, len(lines)
    docstring = family == "python"
    while i < n:
        text = lines[i].strip()
        if not text:
            i += 1
            continue
        if i == 0 and text.startswith("#!") and not text.startswith("#!["):
            i = end = 1
            continue
        if text.startswith(COMMENT[family]) and not (family == "rust" and text.startswith("///")):
            i += 1
            # A comment belongs to the preamble if a blank line or more preamble follows.
            if i < n and not lines[i].strip():
                end = i
            continue
        if family != "python" and text.startswith("/*") and not (family == "rust" and text.startswith("/**")):
            while i < n and "*/" not in lines[i]:
                i += 1
            i += 1
            if i >= n or not lines[i].strip():
                end = min(i, n)
            continue
        if docstring and (m := re.match(r"[rRuU]?('''|\"\"\")", text)):
            quote, rest = m[1], text[m.end() :]
            while quote not in rest and i + 1 < n:
                i += 1
                rest = lines[i]
            i += 1
            end, docstring = min(i, n), False
            continue
        if not STARTS[family].match(text):
            break
        docstring = False
        depth = 0
        while i < n:
            depth += sum(lines[i].count(c) for c in "([{") - sum(lines[i].count(c) for c in ")]}")
            i += 1
            done = depth <= 0 and (family != "rust" or lines[i - 1].rstrip().endswith((";", "]"))) and not lines[i - 1].rstrip().endswith("\\")
            if done:
                break
        end = min(i, n)
    return end


def is_body(line: str, mark: str) -> bool:
    text = line.strip()
    return text == mark or text.startswith(mark + " ")


def is_separator(line: str, mark: str) -> bool:
    text = line.strip()
    return text.startswith(mark + " ") and bool(re.fullmatch(r"-+", text[len(mark) + 1 :].strip()))


def find_block(lines: list[str], mark: str, header: str, limit: int) -> tuple[int, int] | None:
    """(first, end) of a written block: a path header, rows under it, and the blank line behind."""
    for start in range(min(limit, len(lines))):
        text = lines[start].strip()
        if not text.startswith(mark + " "):
            continue
        value = text[len(mark) + 1 :].strip()
        if not (value == header or PATH_HEADER.match(value)) or start + 1 >= len(lines) or not is_body(lines[start + 1], mark):
            continue
        end = start + 1
        while end < len(lines) and is_body(lines[end], mark):
            end += 1
        if end < len(lines) and not lines[end].strip():
            end += 1
        while start > 0 and is_separator(lines[start - 1], mark):
            start -= 1
        return start, end
    return None


def display(name: str, parent: str | None, kind: str, shown: str) -> str:
    front = f"{shown} " if shown.strip() else ""
    return ("  " if parent else "") + front + name + ("()" if kind in CALLABLE else "")


def table(rows: list[tuple[str, int]], indent: str) -> tuple[list[str], int]:
    """Rows with their lines right-aligned, and the width of the table."""
    labels = [f"L{n}" for _, n in rows]
    left, right = max((len(a) for a, _ in rows), default=0), max((len(x) for x in labels), default=0)
    return [f"{indent}{a:<{left}}{' ' * GAP}{x:>{right}}" for (a, _), x in zip(rows, labels)], left + GAP + right


def write_index(source: str, path: str) -> tuple[str, str | None]:
    """(new text, warning) of a code file; the warning says that rows which were no index rows went with an old block."""
    language = language_of(path)
    family = FAMILY[language]
    mark = COMMENT[family]
    lines, newline, ended = split_lines(source)
    foreign = 0
    while (block := find_block(lines, mark, path, max(preamble_end(lines, family), SEARCH))) is not None:
        body = [x.strip()[len(mark) :].strip() for x in lines[block[0] : block[1]]]
        foreign += sum(1 for x in body if x and not re.fullmatch("-+", x) and not ROW.search(" " + x) and not PATH_HEADER.match(x) and x != path)
        del lines[block[0] : block[1]]
    at = preamble_end(lines, family)
    found = facts_of(path, "\n".join(lines) + ("\n" if ended and lines else ""), language).symbols
    found.sort(key=lambda s: (s[4], s[0]))
    inserted = len(found) + 5 if found else 3
    rows, width = table([(display(s[0], s[1], s[2], s[3]), s[4] + inserted if s[4] > at else s[4]) for s in found], f"{mark} ")
    rule = [f"{mark} {'-' * width}"] if found else []
    block_lines = [*rule, f"{mark} {path}", mark, *rows, *rule, ""]
    out = newline.join(lines[:at] + block_lines + lines[at:])
    if ended and out:
        out += newline
    return out, f"{foreign} rows that are no index rows were removed" if foreign else None


def frontmatter_end(lines: list[str]) -> int:
    if not lines or lines[0].strip() != "---":
        return 0
    return next((i + 1 for i in range(1, len(lines)) if lines[i].strip() == "---"), 0)


def write_outline(source: str, path: str, force: bool = False) -> tuple[str | None, str | None]:
    """(new text, warning) of a markdown file; no text where its frontmatter has keys of others, unless forced."""
    lines, newline, ended = split_lines(source)
    while (block := find_block(lines, ">", path, max(frontmatter_end(lines), SEARCH))) is not None:
        del lines[block[0] : block[1]]
    end = frontmatter_end(lines)
    inner = lines[1 : end - 1] if end else []
    if not force and any(x.strip() and not x.startswith((" ", "\t")) and not x.strip().startswith("#") and not re.match(r"(?:path|outline):", x.strip()) for x in inner):
        return None, "frontmatter has other keys"
    kept, skipping = [], False
    for x in inner:
        if x.startswith(("path:", "outline:")):
            skipping = x.startswith("outline:")
        elif not (skipping and (x.startswith((" ", "\t")) or not x.strip())):
            skipping = False
            kept.append(x)
    body = lines[end:]
    heads = [(" ".join(re.sub(r"!?\[\[(?:[^\]|]*\|)?([^\]]*)\]\]|!?\[([^\]]*)\]\([^)]*\)|`", lambda m: m[1] or m[2] or "", raw).replace("'", "’").split()), level, line) for _, raw, level, line, _ in markdown.parse("\n".join(body)).headings]
    blank = not body or body[0] != ""
    shift = 3 + len(kept) + (1 + len(heads) if heads else 0) + blank
    rows, _ = table([(BULLETS.get(level, "        · ") + title, line + shift) for title, level, line in heads], "  ")
    out = newline.join(["---", *kept, f"path: {path}", *(["outline: |", *rows] if heads else []), "---", *([""] if blank else []), *body])
    return out + (newline if ended and out else ""), None


def format_files(files: DataFrame, content: str = "content", force: bool = False) -> DataFrame:
    """(path, content, changed, warning) of all code and markdown files; others and null contents drop out. Only changed rows need to be written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for path, source in frame.itertuples(index=False):
                if not path or source is None:
                    continue
                if language_of(path):
                    text, warning = write_index(source, path)
                elif path.lower().endswith(".md"):
                    text, warning = write_outline(source, path, force)
                else:
                    continue
                rows.append((path, source if text is None else text, text is not None and text != source, warning))
            yield pd.DataFrame(rows, columns=["path", "content", "changed", "warning"], dtype=object)

    return files.select("path", content).mapInPandas(run, "path string, content string, changed boolean, warning string")
