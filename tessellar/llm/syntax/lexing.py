"""Tokens, lexer states and bracket summaries of Rust, Go, JavaScript, TypeScript and Python text.

A lexer starts in a mode (code, or inside a comment, string or template that runs over lines) on a
stack of open brackets and contexts, and ends in another. A chunk of a file is summed up for each
mode it may start in: the mode it ends in, the closing brackets it takes from before and the ones
it leaves open. Neighbouring chunks join to one that is summed up the same way, in any order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

CODE = "code"
PAIRS = {")": "(", "]": "[", "}": "{"}


class Fault(Exception):
    """The text is not valid for its language."""


@dataclass
class Tokens:
    """Tokens as parallel lists. Kinds: i name, n number, s string, c character, l lifetime, t template text, x JSX name,
    y JSX text, r regular expression, o sign, e end; texts of literals are left empty."""

    kinds: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    #: Whether a line ends before the token.
    breaks: list[bool] = field(default_factory=list)

    def add(self, kind: str, text: str, start: int, after_break: bool) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.starts.append(start)
        self.breaks.append(after_break)


@dataclass
class State:
    """Where a lexer stands: its mode, the open brackets and contexts, and what it closed that was open before."""

    mode: str = CODE
    stack: list[str] = field(default_factory=list)
    closed: list[str] = field(default_factory=list)
    #: Set in chunks: what is open before is unknown, so a closing bracket without its opening one is no fault yet.
    partial: bool = False

    def open(self, bracket: str) -> None:
        self.stack.append(bracket)

    def close(self, bracket: str) -> str | None:
        """The bracket that this one closes; None if it was opened before the chunk."""
        if self.stack:
            top = self.stack.pop()
            if top[0] != PAIRS[bracket] and not (bracket == "}" and top == "${"):
                raise Fault(f"{bracket} closes {top}")
            return top
        if not self.partial:
            raise Fault(f"{bracket} closes nothing")
        self.closed.append(bracket)
        return None


NUMBER = r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?\w*|0[oO][0-7_]+\w*|0[bB][01_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?\w*"
NAME = r"[^\W\d]\w*"

RUST = re.compile(
    rf"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*)
    |(?P<raw>(?:b|c)?r(?P<hashes>\#*)")|(?P<string>[bc]?")|(?P<char>b?'(?:[^'\\\n]|\\(?:u\{{[0-9a-fA-F_]+\}}|x[0-9a-fA-F]{{2}}|[nrt0'"\\]))')
    |(?P<life>'{NAME})|(?P<num>{NUMBER})|(?P<name>(?:r\#)?{NAME})
    |(?P<sign>\.\.\.|\.\.=|<<=|::|->|=>|==|!=|<=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|\.\.|[-+*/%^!&|=<>@.,;:\#$?~(){{}}\[\]])""",
    re.VERBOSE,
)
GO = re.compile(
    rf"""(?P<newline>\n)|(?P<space>[ \t\r\f\v]+)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>`)
    |(?P<string>"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[0-7]{{3}}))*")
    |(?P<char>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|[0-7]{{3}}))')
    |(?P<num>\.\d[\d_]*(?:[eE][+-]?\d+)?i?|{NUMBER})|(?P<name>{NAME})
    |(?P<sign><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!().,;:\[\]{{}}~])""",
    re.VERBOSE,
)
SCRIPT = re.compile(
    r"""(?P<space>\s+|﻿)|(?P<line>//[^\n  ]*)|(?P<block>/\*)
    |(?P<string>"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')|(?P<tpl>`)
    |(?P<num>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)(?![\w$])
    |(?P<name>\#?(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<sign>>>>=|\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|\*\*|[-+*%&|^<>=!~?:;,.(){}\[\]@])
    |(?P<slash>/)""",
    re.VERBOSE,
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/(?P<flags>[A-Za-z]*)")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
JSX_TAG = re.compile(
    r"""(?P<space>\s+)|(?P<block>/\*[\s\S]*?\*/)|(?P<line>//[^\n]*)|(?P<string>"[^"]*"|'[^']*')|(?P<name>[^\W\d][\w$-]*|[$][\w$-]*)|(?P<sign>/>|[<>=/:.{])""", re.VERBOSE
)
#: Names after which an expression starts.
BEFORE_OPERAND = frozenset("return typeof case in of delete void throw new else do instanceof await yield default extends".split())
GO_ENDERS = frozenset("break continue fallthrough return ++ -- ) ] }".split())
GO_NO_SEMICOLON = frozenset("case chan const default defer else for func go goto if import interface map package range select struct switch type var".split())


def lex_rust(text: str, state: State, out: Tokens | None = None) -> State:
    pos, n, fresh = 0, len(text), True
    match = RUST.match
    while pos < n:
        if state.mode != CODE:
            if state.mode.startswith("block"):
                depth = int(state.mode[5:])
                for m in re.compile(r"/\*|\*/").finditer(text, pos):
                    depth += 1 if m[0] == "/*" else -1
                    if not depth:
                        pos = m.end()
                        break
                if depth:
                    state.mode = f"block{depth}"
                    return state
            elif state.mode.startswith("raw"):
                end = text.find('"' + "#" * int(state.mode[3:]), pos)
                if end < 0:
                    return state
                pos = end + 1 + int(state.mode[3:])
            else:
                m = re.compile(r'(?:[^"\\]|\\[\s\S])*"').match(text, pos)
                if m is None:
                    return state
                pos = m.end()
            state.mode = CODE
            continue
        m = match(text, pos)
        if m is None:
            raise Fault(f"no token starts with {text[pos]!r}")
        kind, start, pos = m.lastgroup, pos, m.end()
        if kind == "space":
            fresh = fresh or "\n" in m[0]
        elif kind == "line":
            pass
        elif kind == "block":
            state.mode = "block1"
        elif kind == "raw" or kind == "hashes":
            state.mode = f"raw{len(m['hashes'])}"
            if out is not None:
                out.add("s", "", start, fresh)
        elif kind == "string":
            state.mode = "str"
            if out is not None:
                out.add("s", "", start, fresh)
        else:
            word = m[0]
            if kind == "sign":
                if word in "([{":
                    state.open(word)
                elif word in ")]}":
                    state.close(word)
            if out is not None:
                out.add({"char": "c", "life": "l", "num": "n", "name": "i", "sign": "o"}[kind], "" if kind in ("char", "num") else word, start, fresh)
            fresh = False
    return state


def lex_go(text: str, state: State, out: Tokens | None = None) -> State:
    """Go's own semicolons are put in where a line ends after a token that can end a statement."""
    pos, n = 0, len(text)
    ends = False
    match = GO.match
    while pos < n:
        if state.mode != CODE:
            end = text.find("*/" if state.mode == "block" else "`", pos)
            if end < 0:
                return state
            if state.mode == "block":
                if ends and "\n" in text[pos:end] and out is not None:
                    out.add("o", ";", end, True)
                    ends = False
                pos = end + 2
            else:
                pos, ends = end + 1, True
            state.mode = CODE
            continue
        m = match(text, pos)
        if m is None:
            raise Fault(f"no token starts with {text[pos]!r}")
        kind, start, pos = m.lastgroup, pos, m.end()
        if kind == "newline":
            if ends and out is not None:
                out.add("o", ";", start, True)
            ends = False
        elif kind in ("space", "line"):
            pass
        elif kind == "block":
            state.mode = "block"
        elif kind == "raw":
            state.mode = "raw"
            if out is not None:
                out.add("s", "", start, False)
        else:
            word = m[0]
            if kind == "sign":
                if word in "([{":
                    state.open(word)
                elif word in ")]}":
                    state.close(word)
                ends = word in GO_ENDERS
            else:
                ends = kind != "name" or word not in GO_NO_SEMICOLON
            if out is not None:
                out.add({"string": "s", "char": "c", "num": "n", "name": "i", "sign": "o"}[kind], word if kind in ("name", "sign") else "", start, False)
    if ends and out is not None and state.mode == CODE:
        out.add("o", ";", n, True)
    return state


def lex_script(text: str, state: State, out: Tokens | None = None, jsx: bool = False) -> State:
    """JavaScript and TypeScript; contexts on the stack: ` a template, <tag an element's tag, <kids what is in an element."""
    pos, n, fresh = 0, len(text), True
    # Whether an operand may start here, so that / starts a regular expression and < an element.
    operand, last = True, ""
    match = SCRIPT.match
    add = out.add if out is not None else (lambda *a: None)
    stack = state.stack
    while pos < n:
        top = stack[-1] if stack else ""
        if state.mode == "block":
            end = text.find("*/", pos)
            if end < 0:
                return state
            fresh = fresh or "\n" in text[pos:end]
            pos, state.mode = end + 2, CODE
            continue
        if top == "`":
            pos = TEMPLATE.match(text, pos).end()
            if pos >= n:
                return state
            if text[pos] == "`":
                stack.pop()
                add("t", "end", pos, False)
                pos, operand, fresh = pos + 1, False, False
            elif text.startswith("${", pos):
                add("o", "${", pos, False)
                stack.append("${")
                pos, operand, fresh = pos + 2, True, False
            else:
                raise Fault("template ends in a backslash")
            continue
        if top.startswith("<tag"):
            m = JSX_TAG.match(text, pos)
            if m is None:
                raise Fault(f"no part of a tag starts with {text[pos]!r}")
            kind, start, pos, word = m.lastgroup, pos, m.end(), m[0]
            if kind in ("space", "block", "line"):
                continue
            if kind == "name":
                add("x", word, start, False)
            elif kind == "string":
                add("s", "", start, False)
            elif word == "{":
                add("o", "{", start, False)
                stack.append("{")
                operand, fresh = True, False
            elif word in ("/>", ">"):
                closing = top == "<tag/"
                stack.pop()
                add("o", "jsx" + word, start, False)
                if closing:
                    if word == "/>" or not stack or stack.pop() != "<kids":
                        raise Fault("end tag without its start tag")
                elif word == ">":
                    stack.append("<kids")
                operand, fresh = False, False
            elif word == "<":
                raise Fault("< in a tag")
            else:
                add("o", "jsx" + word, start, False)
            continue
        if top == "<kids":
            end = pos
            while end < n and text[end] not in "<{>}":
                end += 1
            if end > pos:
                add("y", "", pos, False)
            if end >= n:
                return state
            if text[end] in ">}":
                raise Fault(f"{text[end]} in the text of an element")
            if text[end] == "{":
                add("o", "{", end, False)
                stack.append("{")
                pos, operand, fresh = end + 1, True, False
            else:
                closing = text.startswith("</", end)
                add("o", "jsx</" if closing else "jsx<", end, False)
                stack.append("<tag/" if closing else "<tag")
                pos = end + (2 if closing else 1)
            continue
        m = match(text, pos)
        if m is None:
            raise Fault(f"no token starts with {text[pos]!r}")
        kind, start, pos, word = m.lastgroup, pos, m.end(), m[0]
        if kind == "space":
            fresh = fresh or "\n" in word
            continue
        if kind == "line":
            continue
        if kind == "block":
            state.mode = "block"
            continue
        if kind == "name":
            add("i", word, start, fresh)
            operand = word in BEFORE_OPERAND and last != "."
        elif kind in ("num", "string"):
            add("n" if kind == "num" else "s", "", start, fresh)
            operand = False
        elif kind == "tpl":
            add("t", "start", start, fresh)
            stack.append("`")
        elif kind == "slash":
            r = REGEX.match(text, start) if operand else None
            if r:
                add("r", "", start, fresh)
                pos, operand = r.end(), False
            else:
                if text.startswith("/=", start):
                    word, pos = "/=", start + 2
                add("o", word, start, fresh)
                operand = True
        elif word == "<" and jsx and operand and (t := re.compile(r"<(?:(?P<name>[^\W\d][\w$.:-]*|[$][\w$.]*)|\s*>)").match(text, start)) and not _generic(text, t):
            add("o", "jsx<", start, fresh)
            stack.append("<tag")
        else:
            if word in "([{":
                state.open(word)
                operand = True
            elif word in ")]}":
                opened = state.close(word)
                operand = word == "}" and opened == "{" and not (len(stack) and stack[-1].startswith("<"))
                if opened == "${":
                    add("o", "}$", start, fresh)
                    fresh = False
                    continue
            else:
                operand = word not in ("++", "--") or operand
            add("o", word, start, fresh)
        fresh, last = False, word
    return state


def _generic(text: str, m: re.Match) -> bool:
    """Whether <T … in operand place begins type parameters of an arrow function rather than an element."""
    name = m["name"]
    if not name:
        return False
    rest = text[m.end() : m.end() + 200]
    if re.match(r"\s*,|\s+extends\s+[^=>]", rest):
        return True
    return re.match(r"\s*>\s*\(", rest) is not None and f"</{name}" not in text[m.end() :]


PYTHON = re.compile(
    r"""(?P<space>[\s\\]+)|(?P<line>\#[^\n]*)|(?P<triple>(?i:[rbuft]{0,2})(?P<quote>'''|\"\"\"))|(?P<string>(?i:[rbuft]{0,2})(?:"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'))|(?P<word>[\w.]+)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<sign>.)""",
    re.VERBOSE,
)


def lex_python(text: str, state: State, out: Tokens | None = None) -> State:
    """Brackets and long strings only; Python's own parser reads the rest."""
    pos, n = 0, len(text)
    while pos < n:
        if state.mode != CODE:
            quote = state.mode[3:]
            m = re.compile(rf"(?:[^\\{quote[0]}]|\\[\s\S]|{quote[0]}(?!{quote[0] * 2}))*{quote}").match(text, pos)
            if m is None:
                return state
            pos, state.mode = m.end(), CODE
            continue
        m = PYTHON.match(text, pos)
        kind, pos = m.lastgroup, m.end()
        if kind in ("triple", "quote"):
            state.mode = "py:" + m["quote"]
        elif kind == "open":
            state.open(m[0])
        elif kind == "close":
            state.close(m[0])
    return state


#: Lexer, keyword arguments, and the modes in which a line of a file may start.
LEXERS = {
    "rust": (lex_rust, {}, (CODE, "block1", "raw0", "raw1", "raw2", "str")),
    "go": (lex_go, {}, (CODE, "block", "raw")),
    "javascript": (lex_script, {"jsx": True}, (CODE, "block")),
    "typescript": (lex_script, {}, (CODE, "block")),
    "tsx": (lex_script, {"jsx": True}, (CODE, "block")),
    "python": (lex_python, {}, (CODE, "py:'''", 'py:"""')),
}


@dataclass
class Summary:
    """What a chunk does when it starts in one mode: the mode it ends in, what it closes of before and leaves open, or its fault."""

    mode: str = CODE
    closed: tuple[str, ...] = ()
    opened: tuple[str, ...] = ()
    fault: str = ""


def joined(first: Summary, second: Summary) -> Summary:
    """What two neighbouring chunks do, ``second`` being what the latter does in the mode the first one ends in. Associative."""
    if first.fault or second.fault:
        return Summary(fault=first.fault or second.fault)
    closed, opened = list(first.closed), list(first.opened)
    for bracket in second.closed:
        if not opened:
            closed.append(bracket)
        elif opened.pop() != PAIRS[bracket]:
            return Summary(fault=f"{bracket} closes nothing of its kind")
    return Summary(second.mode, tuple(closed), (*opened, *second.opened))


class Chunk:
    """A chunk, or several neighbouring ones, as a map from what it may start in to its summary.

    A start is a mode and, where a script has templates or elements open, all that is open: how such
    a chunk reads depends on them. The maps hold every mode a line may start in (of a file's first
    chunk only the one it does start in); any other start is looked up when it is asked for.
    """

    def __init__(self, text: str, language: str, first: bool = False):
        self.text, self.language = text, language
        self.known: dict[tuple, Summary] = {}
        for mode in (CODE,) if first else LEXERS[language][2]:
            self.run(mode)

    def run(self, mode: str, context: tuple[str, ...] = ()) -> Summary:
        if (mode, context) not in self.known:
            lexer, options, _ = LEXERS[self.language]
            state = State(mode=mode, stack=list(context), partial=True)
            try:
                lexer(self.text, state, None, **options)
                self.known[mode, context] = Summary(state.mode, tuple(state.closed), tuple(state.stack))
            except Fault as e:
                self.known[mode, context] = Summary(fault=str(e))
        return self.known[mode, context]


class Chunks:
    """Two neighbours as one."""

    def __init__(self, left: Chunk | Chunks, right: Chunk | Chunks):
        self.left, self.right = left, right
        #: Starts that both sides know already.
        self.known = {start: self._joined(s) for start, s in left.known.items()}

    def _joined(self, s: Summary) -> Summary:
        if s.fault:
            return s
        if any(x[0] in "`<$" for x in s.opened):
            after = self.right.run(s.mode, s.opened)
            return Summary(after.mode, (*s.closed, *after.closed), after.opened, after.fault)
        return joined(s, self.right.run(s.mode))

    def run(self, mode: str, context: tuple[str, ...] = ()) -> Summary:
        if (mode, context) not in self.known:
            self.known[mode, context] = self._joined(self.left.run(mode, context))
        return self.known[mode, context]


def merge(chunks: list[Chunk | Chunks]) -> Chunk | Chunks:
    """Neighbours, at least one, joined pairwise until one is left; any other way of joining gives the same maps."""
    while len(chunks) > 1:
        chunks = [Chunks(*chunks[i : i + 2]) if i + 1 < len(chunks) else chunks[i] for i in range(0, len(chunks), 2)]
    return chunks[0]


def finish(mode: str, stack: list[str]) -> None:
    """The end of a file: nothing may be open."""
    if mode != CODE:
        raise Fault(f"the file ends inside a {mode.rstrip('0123456789').partition(':')[0]}")
    if stack:
        raise Fault(f"{stack[-1]} is never closed")


def tokens_of(text: str, language: str) -> Tokens:
    """All tokens of a whole file, ended by one of kind e; raises Fault."""
    lexer, options, _ = LEXERS[language]
    out, state = Tokens(), State()
    lexer(text, state, out, **options)
    finish(state.mode, state.stack)
    out.add("e", "", len(text), True)
    return out
