"""What one source file states: its symbols, what it imports and passes on, and the identifiers it uses.

Each file is scanned once into tokens (comments and literals left out); declarations are recognised
by the keywords before a name and by the brackets it stands in. Files need not parse.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from tessellar.functions.paths import LANGUAGES

TOKEN = {
    "rust": re.compile(r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*[\s\S]*?\*/)*\*/|b?r(#*)\"[\s\S]*?\"\1|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n]{1,9}?)'|'\w+|(?P<name>(?:r#)?[^\W\d]\w*)|(?P<sign>::|->|=>|\.\.|[{}()\[\]<>;:,.=!&*#|])|\d[\w.]*"),
    "script": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|(?<=[=(,:\[!&|?{};\n ])/(?![*/\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*(?=[\s.,;)\]}])|`(?:[^`\\]|\\[\s\S])*`|\"(?P<dq>(?:[^\"\\\n]|\\.)*)\"|'(?P<sq>(?:[^'\\\n]|\\.)*)'|(?P<name>#?[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>=>|\.\.\.|\?\.|[{}()\[\]<>;:,.=!?*@&|/])|\d[\w.]*"),
    "python": re.compile(r"\#[^\n]*|(?i:[rbuf]{0,2})(?:'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")|(?P<name>[^\W\d]\w*)|(?P<sign>->|[{}()\[\];:,.=*@])|\d[\w.]*"),
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|`(?P<raw>[^`]*)`|\"(?P<dq>(?:[^\"\\\n]|\\.)*)\"|'(?:[^'\\\n]|\\[^\n]{1,9}?)'|(?P<name>[^\W\d]\w*)|(?P<sign>:=|\.\.\.|[{}()\[\];:,.=*&<-])|\d[\w.]*"),
}
FAMILY = {"rust": "rust", "javascript": "script", "typescript": "script", "tsx": "script", "python": "python", "go": "go"}
# Names that are never uses.
KEYWORDS = {
    "rust": frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()),
    "script": frozenset("abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface keyof let namespace new null number of private protected public readonly require return set static string super switch this throw true try type typeof undefined unknown var void while with yield".split()),
    "python": frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield self cls".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false string int bool error byte rune".split()),
}

SYMBOL = "name string, parent string, kind string, display_kind string, line int, end_line int, is_public boolean, body_line int"
IMPORT = "candidates array<struct<path:string,rest:int>>, local string, definition string, style string, passed_on boolean, line int, raw string"
USE = "name string, member string, line int, col int"
FACTS = f"path string, language string, symbols array<struct<{SYMBOL}>>, imports array<struct<{IMPORT}>>, uses array<struct<{USE}>>, default_name string, all_names array<string>"
COLUMNS = ["path", "language", "symbols", "imports", "uses", "default_name", "all_names"]
#: Characters of source whose facts are held at a time: as objects they take many times the memory of the text.
CHARACTERS = 500_000


@dataclass
class Token:
    text: str
    start: int
    end: int
    line: int
    col: int
    name: bool
    literal: str | None = None


@dataclass
class Facts:
    symbols: list[tuple] = field(default_factory=list)
    imports: list[tuple] = field(default_factory=list)
    uses: list[tuple] = field(default_factory=list)
    default_name: str | None = None
    all_names: list[str] | None = None


#: Text of an element on one line: its quotes and brackets need not balance.
ELEMENT_TEXT = re.compile(r"(?<=[>}])[^<>{}`;=\n]*(?=</)")


def tokens_of(source: str, family: str) -> list[Token]:
    if family == "script" and "</" in source:
        source = ELEMENT_TEXT.sub(lambda m: " " * len(m[0]), source)
    starts = [0] + [m.end() for m in re.finditer("\n", source)]
    out = []
    for m in TOKEN[family].finditer(source):
        groups = m.groupdict()
        literal = groups.get("dq") if groups.get("dq") is not None else groups.get("sq") if groups.get("sq") is not None else groups.get("raw")
        name, sign = groups.get("name"), groups.get("sign")
        if name is None and sign is None and literal is None:
            continue
        line = bisect_right(starts, m.start())
        begin = starts[line - 1]
        col = len(source[begin : m.start()].encode()) + 1
        out.append(Token(m[0] if literal is None else "", m.start(), m.end(), line, col, name is not None, literal))
    return out


def closing(tokens: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at ``i``, or the last token."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    depth = 0
    for j in range(i, len(tokens)):
        t = tokens[j].text
        if t in pairs:
            depth += 1
        elif t in (")", "]", "}"):
            depth -= 1
            if depth <= 0:
                return j
    return len(tokens) - 1


def line_at(source: str, offset: int) -> int:
    return source.count("\n", 0, offset) + 1


# Symbols


def rust_symbols(t: list[Token], source: str) -> list[tuple]:
    out: list[tuple] = []
    kinds = {"fn": "fn", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "const", "static": "static", "mod": "mod", "union": "struct"}
    stack: list[tuple[int, str | None, bool]] = []
    i = 0
    while i < len(t):
        while stack and i > stack[-1][0]:
            stack.pop()
        w = t[i].text
        nxt = t[i + 1] if i + 1 < len(t) else None
        if w == "impl" and t[i].name:
            j = i + 1
            while j < len(t) and t[j].text not in ("{", ";"):
                j += 1
            head = [x for x in t[i + 1 : j]]
            names, depth, after_for = [], 0, []
            for k, x in enumerate(head):
                if x.text == "<":
                    depth += 1
                elif x.text == ">":
                    depth -= 1
                elif x.text == "where":
                    break
                elif x.text == "for" and not depth and not (k + 1 < len(head) and head[k + 1].text == "<"):
                    after_for = []
                    names = []
                    after_for.append(True)
                elif x.name and not depth and x.text not in ("dyn", "mut", "const", "unsafe"):
                    names.append(x.text)
            if j < len(t) and t[j].text == "{":
                stack.append((closing(t, j), names[-1] if names else None, False))
            i = j + 1
            continue
        if w == "macro_rules" and nxt is not None and nxt.text == "!":
            j = i + 2
            if j < len(t):
                out.append((t[j].text, None, "macro", "macro_rules!", t[i].line, line_at(source, t[closing(t, j + 1)].start) if j + 1 < len(t) else t[j].line, False))
            i = j + 1
            continue
        if w in kinds and nxt is not None and nxt.name and not (w == "const" and nxt.text in ("fn", "unsafe", "async", "extern")) and not (w == "type" and nxt.text == "=") and (nxt.text not in KEYWORDS["rust"] or w == "static" and nxt.text == "mut"):
            name = t[i + 2].text if nxt.text == "mut" and i + 2 < len(t) else nxt.text
            b = i
            words: list[str] = []
            while b > 0 and (t[b - 1].text in ("pub", "async", "const", "unsafe", "extern", "default", "crate") or t[b - 1].text == ")" or t[b - 1].text in ("(", "in", "super", "self") and b > 1):
                if t[b - 1].text == ")":
                    k = b - 1
                    while k > 0 and t[k].text != "(":
                        k -= 1
                    if k == 0 or t[k - 1].text != "pub":
                        break
                    words.insert(0, "pub(" + " ".join(x.text for x in t[k + 1 : b - 1]) + ")")
                    b = k - 1
                    continue
                if t[b - 1].text in ("(", "in", "super", "self", "crate"):
                    break
                words.insert(0, t[b - 1].text)
                b -= 1
            public = any(x.startswith("pub") for x in words)
            j = i + 1
            angle = 0
            while j < len(t):
                x = t[j].text
                if x in ("(", "["):
                    j = closing(t, j)
                elif x == "{" or x == ";" and not angle:
                    break
                j += 1
            j = min(j, len(t) - 1)
            end = closing(t, j) if t[j].text == "{" else j
            if w in ("const", "static", "type") and t[j].text == "{":
                while j < len(t) - 1 and t[j].text != ";":
                    j = closing(t, j) + 1 if t[j].text == "{" else j + 1
                end = j = min(j, len(t) - 1)
            parent = next((s[1] for s in reversed(stack) if s[1]), None) if w in ("fn", "const", "type") else None
            in_trait = next((s for s in reversed(stack) if s[1]), (0, None, False))[2]
            if not (w == "mod" and t[j].text == ";"):
                out.append((name, parent, kinds[w], " ".join([*words, w]), t[b].line, line_at(source, t[min(end, len(t) - 1)].start), public or bool(stack) and in_trait and parent is not None and stack[-1][2]))
            if w == "trait" and t[j].text == "{":
                stack.append((closing(t, j), name, public))
            i = j + 1 if t[j].text == "{" and w in ("trait", "mod", "fn") else max(end + 1, i + 2)
            continue
        i += 1
    return out


def go_symbols(t: list[Token], source: str) -> list[tuple]:
    out: list[tuple] = []
    i = 0
    while i < len(t):
        w = t[i].text
        if w == "func" and t[i].name:
            j, parent = i + 1, None
            if j < len(t) and t[j].text == "(":
                end = closing(t, j)
                names, depth = [], 0
                for x in t[j + 1 : end]:
                    depth += (x.text == "[") - (x.text == "]")
                    if x.name and not depth:
                        names.append(x.text)
                parent = names[-1] if len(names) > 1 else None
                j = end + 1
            if j < len(t) and t[j].name:
                name, at = t[j].text, t[j]
                k = j + 1
                while k < len(t) and t[k].text != "{" and t[k].line == t[k - 1].line or k < len(t) and t[k].text in (")", "]"):
                    k = closing(t, k) + 1 if t[k].text in ("(", "[") else k + 1
                end = closing(t, k) if k < len(t) and t[k].text == "{" else k - 1
                out.append((name, parent, "fn", "func", t[i].line, line_at(source, t[min(end, len(t) - 1)].start), name[0].isascii() and name[0].isupper()))
                del at
                i = min(end, len(t) - 1) + 1
                continue
        elif w in ("type", "const", "var") and t[i].name:
            grouped = i + 1 < len(t) and t[i + 1].text == "("
            stop = closing(t, i + 1) if grouped else None
            k = i + 2 if grouped else i + 1
            while k < len(t) and (stop is None or k < stop):
                first = k
                names = [t[k]] if t[k].name else []
                while w != "type" and k + 2 < len(t) and t[k + 1].text == "," and t[k + 2].name:
                    k += 2
                    names.append(t[k])
                k += 1
                what = t[k].text if k < len(t) else ""
                while k < len(t) and (stop is None or k < stop) and (t[k].line == line_at(source, t[k - 1].end)):
                    k = closing(t, k) + 1 if t[k].text in ("(", "[", "{") else k + 1
                end = line_at(source, t[k - 1].end - 1)
                for n in names:
                    kind = {"struct": "struct", "interface": "interface"}.get(what, "type") if w == "type" else "variable" if w == "var" else "const"
                    shown = f"type {what}" if w == "type" and what in ("struct", "interface") else w
                    out.append((n.text, None, kind, shown, (t[i] if not grouped else t[first]).line, end, n.text[0].isascii() and n.text[0].isupper()))
                if not grouped:
                    break
            i = max(k, i + 1) if not grouped else stop + 1
            continue
        elif w in ("{", "("):
            i = closing(t, i)
        i += 1
    return out


def script_symbols(t: list[Token], source: str) -> tuple[list[tuple], str | None]:
    out: list[tuple] = []
    default: str | None = None
    prefix = {"export", "default", "async", "abstract", "declare"}
    modifiers = {"public", "private", "protected", "static", "async", "readonly", "abstract", "override", "declare", "get", "set"}
    classes: list[tuple[int, int, str, bool]] = []
    functions: list[int] = []
    i = 0

    def head(i: int) -> tuple[int, list[str]]:
        b, words = i, []
        while b > 0 and t[b - 1].text in prefix and t[b - 1].name:
            words.insert(0, t[b - 1].text)
            b -= 1
        return b, words

    def body_end(j: int) -> int:
        while j < len(t) and t[j].text not in ("{", ";"):
            j = closing(t, j) + 1 if t[j].text in ("(", "[") else j + 1
        if j >= len(t):
            return len(t) - 1
        return closing(t, j) if t[j].text == "{" else j

    while i < len(t):
        while classes and i > classes[-1][1]:
            classes.pop()
        while functions and i > functions[-1]:
            functions.pop()
        w, nxt = t[i].text, t[i + 1] if i + 1 < len(t) else None
        member = classes and i > classes[-1][0] and (not functions or functions[-1] >= classes[-1][1])
        if w in ("class", "interface", "enum", "namespace") and t[i].name and nxt is not None and nxt.name and (i == 0 or t[i - 1].text not in (".",)):
            b, words = head(i)
            name = nxt.text
            j = i + 2
            while j < len(t) and t[j].text != "{":
                j += 1
            if j < len(t):
                end = closing(t, j)
                exported = "export" in words
                if "default" in words:
                    default = name
                out.append((name, None, w if w != "namespace" else "mod", " ".join([*words, w]), t[b].line, line_at(source, t[end].start), exported))
                if w == "class":
                    classes.append((j, end, name, exported))
                    i = j + 1
                    continue
                i = end + 1
                continue
        elif w == "type" and t[i].name and nxt is not None and nxt.name and i + 2 < len(t) and t[i + 2].text in ("=", "<") and not functions:
            b, words = head(i)
            j = i + 2
            while j < len(t) and t[j].text != ";" and (t[j].line == t[j - 1].line or t[j].text in ("|", "&", "=", "?", ":")):
                j = closing(t, j) + 1 if t[j].text in ("(", "[", "{") else j + 1
            out.append((nxt.text, None, "type", " ".join([*words, "type"]), t[b].line, line_at(source, t[min(j, len(t)) - 1].start), "export" in words))
            i = j
            continue
        elif w == "function" and t[i].name:
            k = i + 1
            if k < len(t) and t[k].text == "*":
                k += 1
            b, words = head(i)
            if k < len(t) and t[k].name and t[k].text != "(" and (b == 0 or t[b - 1].text not in ("=", "(", ",", ":", "=>", "return")):
                end = body_end(k + 1)
                if "default" in words:
                    default = t[k].text
                out.append((t[k].text, None, "fn", " ".join([*words, "function"]), t[b].line, line_at(source, t[end].start), "export" in words))
                functions.append(end)
                i = k + 1
                continue
        elif w in ("const", "let", "var") and t[i].name and not functions and not classes and nxt is not None and nxt.name and nxt.text != "enum":
            b, words = head(i)
            if not any(x.text in ("{", "(") and closing(t, k) > i for k, x in enumerate(t[:i])) or True:
                j = i + 2
                arrow = False
                while j < len(t) and t[j].text != ";" and not (t[j].line > t[j - 1].line and t[j - 1].text not in ("=", "=>", "(", ",", ".", ":", "?", "|", "&") and t[j].text not in (".", "?", ":", "=>", ")", "|", "&")):
                    arrow = arrow or t[j].text == "=>"
                    j = closing(t, j) + 1 if t[j].text in ("(", "[", "{") else j + 1
                end = min(j, len(t) - 1) if j < len(t) and t[j].text == ";" else min(j, len(t)) - 1
                if depth_zero(t, i):
                    out.append((nxt.text, None, "const" if w == "const" else "variable", " ".join([*words, w]), t[b].line, line_at(source, t[end].end - 1), "export" in words))
                    functions.append(end)
                i += 2
                continue
        elif w == "export" and nxt is not None and nxt.text == "default" and i + 2 < len(t) and t[i + 2].name and t[i + 2].text not in ("function", "class", "async", "abstract", "interface"):
            default = t[i + 2].text
        elif member and (t[i].name or w == "*") and (t[i - 1].text in ("{", "}", ";") or t[i].line > t[i - 1].line):
            b, words = i, []
            while i < len(t) and t[i].name and t[i].text in modifiers and i + 1 < len(t) and (t[i + 1].name or t[i + 1].text == "*"):
                words.append(t[i].text)
                i += 1
            if t[i].text == "*":
                i += 1
            name = t[i].text
            after = t[i + 1].text if i + 1 < len(t) else ""
            if t[i].name and after in ("(", "<"):
                end = body_end(i + 1)
                kind = "getter" if "get" in words else "setter" if "set" in words else "constructor" if name == "constructor" else "fn"
                hidden = "private" in words or "protected" in words or name.startswith("#")
                shown = " ".join(x for x in words if x in ("get", "set"))
                out.append((name, classes[-1][2], kind, shown, t[b].line, line_at(source, t[end].start), classes[-1][3] and not hidden))
                functions.append(end)
                i = end + 1
                continue
            if t[i].name and after in ("=", ":", ";", "?", "!"):
                hidden = "private" in words or "protected" in words or name.startswith("#")
                j = i + 1
                while j < len(t) and t[j].text not in (";", "}") and t[j].line == t[j - 1].line:
                    j = closing(t, j) + 1 if t[j].text in ("(", "[", "{") else j + 1
                out.append((name, classes[-1][2], "property", "", t[b].line, line_at(source, t[min(j, len(t) - 1)].start if j < len(t) and t[j].text == ";" else t[j - 1].start), classes[-1][3] and not hidden))
                i = j
                continue
        elif w == "=>" and nxt is not None and nxt.text == "{":
            functions.append(closing(t, i + 1))
        i += 1
    return out, default


def depth_zero(t: list[Token], i: int) -> bool:
    depth = 0
    for x in t[:i]:
        depth += (x.text in ("{", "(", "[")) - (x.text in ("}", ")", "]"))
    return depth <= 0


def python_symbols(source: str) -> tuple[list[tuple], list[str] | None]:
    """By indentation, so that files which do not parse still give theirs; lines inside strings and brackets count as none."""
    raw = source.split("\n")
    inside, opened, line = [False] * (len(raw) + 1), 0, 0
    masked = list(source)
    at = 0
    for m in TOKEN["python"].finditer(source):
        for k in range(source.count("\n", at, m.start())):
            inside[line + k + 1] = opened > 0
        line += source.count("\n", at, m.start())
        text = m[0]
        if m.groupdict()["sign"]:
            opened = max(0, opened + (text in "([{") - (text in ")]}"))
        elif not m.groupdict()["name"] and not text[0].isdigit():
            for k in range(text.count("\n")):
                inside[line + k + 1] = True
            masked[m.start() : m.end()] = re.sub(r"[^\n]", "\x00", text)
        line += text.count("\n")
        at = m.end()
    lines = "".join(masked).split("\n")
    comment = [x.lstrip().startswith("#") for x in raw]
    out: list[tuple] = []
    stack: list[tuple[int, str, str, bool]] = []
    decorators: list[tuple[int, str]] = []

    def end_of(n: int, indent: int) -> int:
        end = n
        for j in range(n + 1, len(lines)):
            text = lines[j].strip()
            if not inside[j]:
                if not text or comment[j]:
                    continue
                if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    break
            if text or inside[j]:
                end = j
        return end + 1

    for n, masked_line in enumerate(lines):
        stripped = masked_line.strip()
        if inside[n] or not stripped or comment[n]:
            continue
        indent = len(masked_line) - len(masked_line.lstrip())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        m = re.match(r"(async\s+def|def|class)\s+(\w+)", stripped)
        if stripped.startswith("@"):
            decorators.append((n + 1, stripped[1:]))
            continue
        if m:
            name, is_class = m[2], m[1] == "class"
            owner = stack[-1] if stack else None
            parent = owner[1] if owner and owner[2] == "class" else None
            kind = "class" if is_class else "fn"
            for _, d in decorators:
                if not is_class and re.match(r"(?:\w+\.)?(?:cached_)?property\b", d):
                    kind = "getter"
                elif not is_class and re.match(r"\w+\.setter\b", d):
                    kind = "setter"
            if not is_class and name == "__init__" and parent:
                kind = "constructor"
            public = not name.startswith("_") and (owner is None or owner[2] != "class" or owner[3])
            out.append((name, parent, kind, re.sub(r"\s+", " ", m[1]), decorators[0][0] if decorators else n + 1, end_of(n, indent), public))
            stack.append((indent, name, "class" if is_class else "fn", public))
        elif indent == 0 and (v := re.match(r"([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)", stripped)) and v[1] != "__all__":
            end = n
            while end + 1 < len(lines) and (inside[end + 1] or raw[end].endswith("\\")):
                end += 1
            out.append((v[1], None, "variable", "", n + 1, end + 1, not v[1].startswith("_")))
        decorators = []
    names = re.search(r"^__all__\s*=\s*[\[(]([^\])]*)[\])]", source, re.MULTILINE)
    return out, re.findall(r"['\"]([^'\"]+)['\"]", names[1]) if names else None


# Imports


def _norm(parts: list[str]) -> str | None:
    out: list[str] = []
    for p in parts:
        if p in ("", "."):
            continue
        if p == "..":
            if not out:
                return None
            out.pop()
        else:
            out.append(p)
    return "/".join(out)


def rust_roots(path: str) -> tuple[str, list[str]]:
    """The source root of a file's crate (its nearest src directory, else the top) and the module path of the file."""
    parts = path.split("/")
    dirs = parts[:-1]
    at = max((k for k, d in enumerate(dirs) if d == "src"), default=-1)
    root = "/".join(dirs[: at + 1])
    stem = parts[-1].rsplit(".", 1)[0]
    return root, dirs[at + 1 :] + ([] if stem in ("lib", "main", "mod") else [stem])


def rust_candidates(path: str, segments: list[str]) -> list[tuple[str, int]]:
    root, module = rust_roots(path)
    if segments[0] == "crate":
        base, rest = [], segments[1:]
    elif segments[0] in ("self", "super"):
        base, rest = list(module), list(segments)
        while rest and rest[0] in ("self", "super"):
            if rest.pop(0) == "super" and base:
                base.pop()
    else:
        base, rest = list(module), list(segments)
    out = []
    # A path that starts with a plain name has to name a module here, else it is one of another crate.
    for k in range(len(rest), -1 if segments[0] in ("crate", "self", "super") else 0, -1):
        full = [*([root] if root else []), *base, *rest[:k]]
        left = len(rest) - k
        if k or base:
            out += [("/".join(full) + ".rs", left), ("/".join([*full, "mod.rs"]), left)]
        else:
            out += [("/".join([*full, entry]), left) for entry in ("lib.rs", "main.rs", "mod.rs")]
    return out


def rust_imports(t: list[Token], path: str) -> tuple[list[tuple], list[tuple[int, int]]]:
    out: list[tuple] = []
    spans: list[tuple[int, int]] = []
    i = 0

    def tree(i: int, front: list[str]) -> tuple[int, list[tuple[list[str], str | None, bool]]]:
        segments, found = list(front), []
        while i < len(t):
            w = t[i].text
            if w == "{":
                i += 1
                while i < len(t) and t[i].text != "}":
                    if t[i].text == ",":
                        i += 1
                        continue
                    i, more = tree(i, segments)
                    found += more
                return i + 1, found
            if w == "*":
                return i + 1, [(segments, None, True)]
            if t[i].name:
                segments.append(w)
                i += 1
                if i < len(t) and t[i].text == "::":
                    i += 1
                    continue
                alias = None
                if i < len(t) and t[i].text == "as":
                    alias = t[i + 1].text if i + 1 < len(t) else None
                    i += 2
                if segments and segments[-1] == "self" and len(segments) > 1:
                    segments.pop()
                return i, [(segments, alias, False)]
            if w == "::":
                i += 1
                continue
            return i + 1, found
        return i, found

    while i < len(t):
        w = t[i].text
        if w == "use" and t[i].name:
            passed = i > 0 and (t[i - 1].text == "pub" or t[i - 1].text == ")")
            start = i
            i, found = tree(i + 1, [])
            for segments, alias, glob in found:
                if not segments:
                    continue
                raw = "::".join(segments) + ("::*" if glob else "")
                cands = rust_candidates(path, segments)
                if glob:
                    out.append(([c for c in cands if c[1] == 0], None, None, "glob", passed, t[start].line, raw))
                else:
                    out.append((cands, alias or segments[-1], segments[-1], "path", passed, t[start].line, raw))
            while i < len(t) and t[i].text != ";":
                i += 1
            spans.append((t[start].start, t[min(i, len(t) - 1)].end))
        elif w == "mod" and i + 2 < len(t) and t[i + 1].name and t[i + 2].text == ";":
            name = t[i + 1].text
            out.append(([c for c in rust_candidates(path, ["self", name]) if c[1] == 0], name, name, "namespace", False, t[i].line, f"mod {name}"))
            spans.append((t[i].start, t[i + 2].end))
            i += 2
        i += 1
    return out, spans


EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "d.ts")


def script_candidates(path: str, spec: str) -> list[tuple[str, int]]:
    if not spec.startswith("."):
        return []
    full = _norm([*path.split("/")[:-1], *spec.split("?")[0].split("#")[0].split("/")])
    if full is None:
        return []
    stem = re.sub(r"\.(?:js|jsx|mjs|cjs)$", "", full)
    every = [full, *[f"{full}.{e}" for e in EXTENSIONS], *[f"{stem}.{e}" for e in EXTENSIONS if stem != full], *[f"{full}/index.{e}" for e in EXTENSIONS]]
    return [(x, 0) for x in dict.fromkeys(every)]


def script_imports(t: list[Token], path: str) -> tuple[list[tuple], list[tuple[int, int]]]:
    out: list[tuple] = []
    spans: list[tuple[int, int]] = []
    for i, x in enumerate(t):
        if not x.name or x.text not in ("import", "export", "require") or i and t[i - 1].text == ".":
            continue
        if x.text == "require":
            if i + 3 < len(t) and t[i + 1].text == "(" and t[i + 2].literal is not None:
                spec, b = t[i + 2].literal, i
                while b > 0 and t[b].text not in ("const", "let", "var", ";") and t[b].line == x.line:
                    b -= 1
                left = t[b + 1 : i] if t[b].text in ("const", "let", "var") else []
                cands = script_candidates(path, spec)
                names = [y for y in left if y.name]
                if left and left[0].text == "{":
                    for k, y in enumerate(left):
                        if y.name and (k == 0 or left[k - 1].text in ("{", ",")):
                            local = left[k + 2].text if k + 2 < len(left) and left[k + 1].text == ":" else y.text
                            out.append((cands, local, y.text, "name", False, x.line, spec))
                elif names:
                    out.append((cands, names[0].text, None, "namespace", False, x.line, spec))
                else:
                    out.append((cands, None, None, "side", False, x.line, spec))
                if left:
                    spans.append((t[b].start, t[i + 3].end))
            continue
        j = i + 1
        while j < len(t) and t[j].literal is None and t[j].text not in (";", "(", "=") and not (t[j].text in ("import", "export", "const", "function", "class") and j > i + 1 and t[j].line > x.line):
            j += 1
        if j >= len(t) or t[j].literal is None or x.text == "export" and t[j - 1].text != "from":
            continue
        spec, middle = t[j].literal, t[i + 1 : j]
        cands = script_candidates(path, spec)
        spans.append((x.start, t[j].end))
        passed = x.text == "export"
        if not middle:
            out.append((cands, None, None, "side", False, x.line, spec))
        k = 0
        while k < len(middle):
            y = middle[k]
            if y.text == "from":
                break
            if y.text == "type" and k + 1 < len(middle) and (middle[k + 1].text in ("{", "*") or middle[k + 1].name and middle[k + 1].text != "from"):
                k += 1
                continue
            if y.text == "*":
                if k + 2 < len(middle) and middle[k + 1].text == "as":
                    out.append((cands, middle[k + 2].text, None, "namespace", passed, x.line, spec))
                    k += 3
                else:
                    out.append((cands, None, None, "glob", passed, x.line, spec))
                    k += 1
            elif y.text == "{":
                k += 1
                while k < len(middle) and middle[k].text != "}":
                    if middle[k].name:
                        if middle[k].text == "type" and k + 1 < len(middle) and middle[k + 1].name and middle[k + 1].text != "as":
                            k += 1
                        name = local = middle[k].text
                        if k + 2 < len(middle) and middle[k + 1].text == "as":
                            local = middle[k + 2].text
                            k += 2
                        out.append((cands, local, name, "name", passed, x.line, spec))
                    k += 1
                k += 1
            elif y.name:
                out.append((cands, y.text, "default", "name", passed, x.line, spec))
                k += 1
            else:
                k += 1
    return out, spans


def python_candidates(path: str, module: str, dots: int) -> list[tuple[str, int]]:
    parts = [p for p in module.split(".") if p]
    if dots:
        dirs = path.split("/")[:-1]
        dirs = dirs[: len(dirs) - (dots - 1)] if dots - 1 <= len(dirs) else None
        bases = [] if dirs is None else [dirs]
    else:
        own = path.split("/")[:-1]
        bases = [[], ["src"], *[own[:k] for k in range(len(own), 0, -1)]]
    out = []
    for base in bases:
        full = "/".join([*base, *parts])
        if parts:
            out.append((full + ".py", 0))
        out.append(((full + "/" if full else "") + "__init__.py", 0))
    return out


def python_imports(source: str, path: str) -> tuple[list[tuple], list[tuple[int, int]]]:
    out: list[tuple] = []
    spans: list[tuple[int, int]] = []
    package = path.endswith("__init__.py")
    for m in re.finditer(r"^[ \t]*(?:import[ \t]+(?P<mods>[^\n#;(]+)|from[ \t]+(?P<dots>\.*)(?P<mod>[\w.]*)[ \t]+import[ \t]+(?P<names>\([^)]*\)|[^\n#;]+))", source, re.MULTILINE):
        line = line_at(source, m.start() + len(m[0]) - len(m[0].lstrip()))
        spans.append((m.start(), m.end()))
        if m["mods"]:
            for part in m["mods"].split(","):
                name, _, alias = (p.strip() for p in part.partition(" as "))
                if name:
                    out.append((python_candidates(path, name, 0), alias or name.split(".")[0] if not alias else alias, None, "namespace", False, line, name))
            continue
        dots = len(m["dots"])
        for part in re.sub(r"#[^\n]*", "", m["names"]).strip("() \t\n").split(","):
            name, _, alias = (p.strip() for p in part.strip().partition(" as "))
            if not name:
                continue
            cands = python_candidates(path, m["mod"], dots)
            raw = f"{m['dots']}{m['mod']}"
            if name == "*":
                out.append((cands, None, None, "glob", package, line, raw + ".*"))
                continue
            # A submodule comes before a name of the package itself.
            sub = [(c, 0) for c, _ in python_candidates(path, f"{m['mod']}.{name}" if m["mod"] else name, dots)]
            out.append((sub + [(c, 1) for c, _ in cands], alias or name, name, "path", package, line, raw))
    return out, spans


def go_imports(t: list[Token], path: str) -> tuple[list[tuple], list[tuple[int, int]]]:
    out: list[tuple] = []
    spans: list[tuple[int, int]] = []
    i = 0
    while i < len(t):
        if t[i].text == "import" and t[i].name and i + 1 < len(t):
            end = closing(t, i + 1) if t[i + 1].text == "(" else None
            j = i + 1
            while j < len(t) and (j <= end if end is not None else t[j].line == t[i].line):
                if t[j].literal is not None:
                    spec = t[j].literal
                    before = t[j - 1]
                    local = before.text if before.line == t[j].line and (before.name and before.text != "import" or before.text == ".") else spec.rsplit("/", 1)[-1]
                    out.append(([("go:" + spec, 0)], None if local == "." else local, None, "glob" if local == "." else "namespace", False, t[j].line, spec))
                j += 1
            spans.append((t[i].start, t[min(j, len(t)) - 1].end))
            i = j
            continue
        i += 1
    return out, spans


# Uses

DECLARES = {
    "rust": frozenset("fn struct enum trait type const static mod let mut ref union".split()),
    "script": frozenset("function class interface enum namespace const let var type".split()),
    "python": frozenset(("def", "class")),
    "go": frozenset(("func", "type", "var", "const", "package")),
}


def uses_of(t: list[Token], family: str, spans: list[tuple[int, int]]) -> list[tuple]:
    """Identifiers where they are used, each with the member taken of it; not in imports, not where declared, not behind a dot."""
    out = []
    words, declares, k = KEYWORDS[family], DECLARES[family], 0
    spans = sorted(spans)
    for i, x in enumerate(t):
        while k < len(spans) and spans[k][1] <= x.start:
            k += 1
        if not x.name or x.text in words or k < len(spans) and spans[k][0] <= x.start:
            continue
        before = t[i - 1].text if i else ""
        after = t[i + 1].text if i + 1 < len(t) else ""
        if before in (".", "?.", "::") or before in declares and t[i - 1].name:
            continue
        if family == "go" and before == ")" and after == "(":
            continue
        if after == ":" and before in ("{", ",") and family in ("script", "rust", "go"):
            continue
        if family == "python" and after == "=" and before in ("(", ","):
            continue
        member = t[i + 2].text if after in (".", "?.", "::") and i + 2 < len(t) and t[i + 2].name else None
        out.append((x.text, member, x.line, x.col))
    return out


ABOVE = {"python": re.compile(r"\s*(?:#|@)"), "rust": re.compile(r"\s*(?:///?|//!|/\*|\*|#!?\[|.*\*/\s*$)"), "go": re.compile(r"\s*(?://|/\*|\*|.*\*/\s*$)"), "script": re.compile(r"\s*(?://|/\*|\*|@|.*\*/\s*$)")}


def body_line(lines: list[str], line: int, family: str) -> int:
    """The first line of what belongs to a declaration: comment and attribute lines directly above it."""
    n = line - 1
    while n > 0 and lines[n - 1].strip() and ABOVE[family].match(lines[n - 1]):
        n -= 1
        if family != "python" and lines[n].rstrip().endswith("*/"):
            # The whole block, whatever its lines begin with.
            first = next((k for k in range(n, -1, -1) if "/*" in lines[k]), n)
            n = first
    return n + 1


def facts_of(path: str, source: str, language: str) -> Facts:
    family = FAMILY[language]
    t = tokens_of(source, family)
    # Signs that mean nothing stand at the end, so that looking ahead never fails.
    last = line_at(source, len(source))
    t += [Token("", len(source), len(source), last + k, 1, False) for k in range(1, 5)]
    f = Facts()
    if family == "rust":
        f.symbols = rust_symbols(t, source)
        f.imports, spans = rust_imports(t, path)
    elif family == "go":
        f.symbols = go_symbols(t, source)
        f.imports, spans = go_imports(t, path)
    elif family == "python":
        f.symbols, f.all_names = python_symbols(source)
        f.imports, spans = python_imports(source, path)
    else:
        f.symbols, f.default_name = script_symbols(t, source)
        f.imports, spans = script_imports(t, path)
    lines = source.split("\n")
    f.symbols = [(*x, body_line(lines, x[4], family)) for x in dict.fromkeys(f.symbols)]
    f.uses = uses_of(t, family, spans)
    return f


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rpartition(".")[2].lower()) if "." in path else None


def outward(f: Facts, language: str) -> list[tuple]:
    """The uses that may name something of another file: names an import binds and, behind a whole-module import or in Go, names not the file's own."""
    bound = {x[1] for x in f.imports}
    own = {x[0] for x in f.symbols if x[1] is None}
    open_ = language == "go" or any(x[3] == "glob" for x in f.imports)
    return [u for u in f.uses if u[0] in bound or open_ and u[0] not in own]


def fact_frames(frames: Iterable[pd.DataFrame], characters: int = CHARACTERS) -> Iterator[pd.DataFrame]:
    """The facts of frames of (path, source), put together for about so many characters of source at a time."""
    rows, held = [], 0
    for frame in frames:
        for path, source in frame.itertuples(index=False):
            if path and (language := language_of(path)):
                text = (source or "").lstrip("﻿")
                f = facts_of(path, text, language)
                rows.append((path, language, f.symbols, f.imports, outward(f, language), f.default_name, f.all_names))
                held += len(text) + 100
            if held >= characters:
                yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)


def extract(files: DataFrame, content: str = "content") -> DataFrame:
    """The facts of every code file (path, content); other files and null paths give no row, null content is empty.

    Of the uses only those are kept that may name something of another file (``outward``).
    """
    return files.select("path", content).mapInPandas(fact_frames, FACTS)
