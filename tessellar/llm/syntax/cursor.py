"""A place in a token list, with the steps that all grammars share."""

from __future__ import annotations

from tessellar.llm.syntax.lexing import Fault, Tokens


class Cursor:
    """``i`` is the token looked at; ``kind`` and ``text`` describe it."""

    #: Names that cannot name anything in the language.
    RESERVED: frozenset[str] = frozenset()

    def __init__(self, tokens: Tokens):
        self.k, self.t, self.starts, self.breaks = tokens.kinds, tokens.texts, tokens.starts, tokens.breaks
        self.i = 0

    @property
    def text(self) -> str:
        return self.t[self.i]

    @property
    def kind(self) -> str:
        return self.k[self.i]

    def fail(self, wanted: str = "") -> None:
        raise Fault(f"{self.t[self.i] or self.k[self.i]!r} at {self.starts[self.i]}" + (f", where {wanted} is due" if wanted else ""))

    def at(self, *texts: str) -> bool:
        return self.t[self.i] in texts and self.t[self.i] != ""

    def ahead(self, steps: int = 1) -> str:
        j = self.i + steps
        return self.t[j] if j < len(self.t) else ""

    def take(self, text: str) -> bool:
        if self.t[self.i] == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if self.t[self.i] != text:
            self.fail(text)
        self.i += 1

    def name(self) -> str:
        """Any name that is not reserved."""
        word = self.t[self.i]
        if self.k[self.i] != "i" or word in self.RESERVED:
            self.fail("a name")
        self.i += 1
        return word

    def glued(self) -> bool:
        """Whether the next token follows this one (a single sign) without a gap."""
        return self.starts[self.i + 1] == self.starts[self.i] + len(self.t[self.i])

    def tried(self, step) -> bool:
        """Runs a step; if it fails, the place is as before."""
        place = self.i
        try:
            step()
            return True
        except Fault:
            self.i = place
            return False

    def skip_group(self) -> None:
        """Steps over a balanced group that starts here (the lexer has checked the balance)."""
        depth = 0
        while True:
            word = self.t[self.i]
            if self.k[self.i] == "e":
                self.fail("a closing bracket")
            if word in ("(", "[", "{", "${"):
                depth += 1
            elif word in (")", "]", "}", "}$"):
                depth -= 1
            self.i += 1
            if not depth:
                return

    def listed(self, end: str, one, separator: str = ",") -> None:
        """``one`` again and again, separated, up to the closing sign, which is taken; a last separator may stand."""
        while not self.take(end):
            one()
            if not self.take(separator):
                self.need(end)
                return
