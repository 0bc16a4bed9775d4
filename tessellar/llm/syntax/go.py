"""Grammar of Go: declarations, statements, expressions and types."""

from __future__ import annotations

from tessellar.llm.syntax.cursor import Cursor
from tessellar.llm.syntax.lexing import Fault

# Fixed values.
RESERVED = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = frozenset(("=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="))
TYPE_STARTS = frozenset(("*", "[", "(", "func", "struct", "interface", "map", "chan", "<-"))


class Go(Cursor):
    RESERVED = RESERVED
    #: Whether a composite literal may follow a name: not in the heads of if, for and switch.
    literals = True

    def end(self) -> None:
        """The end of a statement: a semicolon, or a closing bracket before which it may be left out."""
        if not self.take(";") and not self.at(")", "}") and self.kind != "e":
            self.fail(";")

    def file(self) -> None:
        self.need("package")
        self.name()
        self.end()
        while self.at("import"):
            self.i += 1
            self.grouped(self.import_spec)
            self.end()
        while self.kind != "e":
            if self.at("func"):
                self.function()
            elif self.at("const", "var", "type"):
                self.declaration()
            else:
                self.fail("a declaration")
            self.end()

    def grouped(self, spec) -> None:
        if self.take("("):
            while not self.take(")"):
                spec()
                self.end()
        else:
            spec()

    def import_spec(self) -> None:
        if self.kind == "i" or self.at("."):
            self.i += 1
        if self.kind != "s":
            self.fail("a path")
        self.i += 1

    def declaration(self) -> None:
        word = self.text
        self.i += 1
        self.grouped(self.type_spec if word == "type" else self.const_spec if word == "const" else self.var_spec)

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def const_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self.k[self.i + 1] == "i" and self.ahead() not in RESERVED and self.ahead(2) != "]":
            self.tried(self.type_parameters)
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while True:
            self.names()
            self.constraint()
            if not self.take(","):
                break
            if self.at("]"):
                break
        self.need("]")

    def constraint(self) -> None:
        self.take("~")
        self.type()
        while self.take("|"):
            self.take("~")
            self.type()

    def function(self) -> None:
        self.need("func")
        if self.at("("):
            self.parameters()
        self.name()
        if self.at("["):
            self.type_parameters()
        self.signature()
        if self.at("{"):
            self.with_literals(self.block)

    def with_literals(self, step) -> None:
        before, self.literals = self.literals, True
        try:
            step()
        finally:
            self.literals = before

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.starts_type():
            self.type()

    def parameters(self) -> None:
        self.need("(")
        self.listed(")", self.parameter)

    def parameter(self) -> None:
        if self.take("..."):
            self.type()
            return
        self.type()
        if self.take("..."):
            self.type()
        elif not self.at(",", ")"):
            self.type()

    def starts_type(self) -> bool:
        return self.kind == "i" and (self.text not in RESERVED or self.text in TYPE_STARTS) or self.kind == "o" and self.text in TYPE_STARTS

    def type(self) -> None:
        word = self.text
        if word == "*":
            self.i += 1
            self.type()
        elif word == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif word == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    self.with_literals(self.expression)
                self.need("]")
            self.type()
        elif word == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif word in ("chan", "<-"):
            if self.take("<-"):
                self.need("chan")
            else:
                self.i += 1
                self.take("<-")
            self.type()
        elif word == "func":
            self.i += 1
            self.signature()
        elif word == "struct":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                self.struct_field()
                self.end()
        elif word == "interface":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                self.interface_element()
                self.end()
        else:
            self.name()
            if self.take("."):
                self.name()
            if self.at("[") and self.ahead() != "]":
                self.tried(self.type_arguments)

    def type_arguments(self) -> None:
        self.need("[")
        self.type()
        while self.take(","):
            if self.at("]"):
                break
            self.type()
        self.need("]")

    def struct_field(self) -> None:
        if self.at("*") or self.kind == "i" and self.ahead() in (".", ";", "}") or self.kind == "i" and self.k[self.i + 1] == "s":
            self.type()
        else:
            self.names()
            self.type()
        if self.kind == "s":
            self.i += 1

    def interface_element(self) -> None:
        if self.kind == "i" and self.ahead() == "(" and self.text not in RESERVED:
            self.i += 1
            self.signature()
        else:
            self.constraint()

    # Statements

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()
            self.end()

    def statement(self) -> None:
        word = self.text
        if self.at(";", "}"):
            return
        if self.kind == "i" and word in RESERVED:
            if word in ("const", "var", "type"):
                self.declaration()
            elif word == "return":
                self.i += 1
                if not self.at(";", "}"):
                    self.expressions()
            elif word in ("break", "continue"):
                self.i += 1
                if self.kind == "i":
                    self.name()
            elif word == "goto":
                self.i += 1
                self.name()
            elif word == "fallthrough":
                self.i += 1
            elif word in ("go", "defer"):
                self.i += 1
                self.expression()
            elif word == "if":
                self.if_statement()
            elif word == "for":
                self.for_statement()
            elif word == "switch":
                self.switch()
            elif word == "select":
                self.i += 1
                self.need("{")
                while not self.take("}"):
                    self.clause(self.simple)
            else:
                self.simple()
            return
        if self.at("{"):
            self.block()
            return
        if self.kind == "i" and self.ahead() == ":":
            self.i += 2
            self.statement()
            return
        self.simple()

    def clause(self, head) -> None:
        if self.take("case"):
            head()
        elif not self.take("default"):
            self.fail("case")
        self.need(":")
        while not self.at("case", "default", "}"):
            self.with_literals(self.statement)
            self.end()

    def simple(self) -> None:
        self.expressions()
        if self.text in ASSIGN:
            self.i += 1
            if self.take("range"):
                self.expression()
            else:
                self.expressions()
        elif self.at("++", "--"):
            self.i += 1
        elif self.take("<-"):
            self.expression()

    def headed(self, step) -> None:
        before, self.literals = self.literals, False
        try:
            step()
        finally:
            self.literals = before

    def if_statement(self) -> None:
        self.need("if")
        if self.at("{"):
            self.fail("a condition")

        def head() -> None:
            if not self.at(";"):
                self.simple()
            if self.take(";"):
                self.simple()

        self.headed(head)
        self.with_literals(self.block)
        if self.take("else"):
            if self.at("if"):
                self.if_statement()
            else:
                self.with_literals(self.block)

    def for_statement(self) -> None:
        self.need("for")

        def head() -> None:
            if self.at("{"):
                return
            if self.take("range"):
                self.expression()
                return
            if not self.at(";"):
                self.simple()
            if self.take(";"):
                if not self.at(";"):
                    self.expression()
                self.need(";")
                if not self.at("{"):
                    self.simple()

        self.headed(head)
        self.with_literals(self.block)

    def switch(self) -> None:
        self.need("switch")

        def head() -> None:
            if self.at("{"):
                return
            if not self.at(";"):
                self.simple()
            if self.take(";") and not self.at("{"):
                self.simple()

        self.headed(head)
        self.need("{")
        while not self.take("}"):
            self.clause(self.cases)

    def cases(self) -> None:
        self.with_literals(self.expression_or_type)
        while self.take(","):
            self.with_literals(self.expression_or_type)

    def expression_or_type(self) -> None:
        place = self.i
        try:
            self.expression()
            if self.at(",", ":"):
                return
        except Fault:
            pass
        self.i = place
        self.type()

    # Expressions

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self, least: int = 1) -> None:
        self.unary()
        while self.kind == "o" and BINARY.get(self.text, 0) >= least:
            rank = BINARY[self.text]
            self.i += 1
            self.expression(rank + 1)

    def unary(self) -> None:
        while self.kind == "o" and self.text in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            if self.at("<-") and self.ahead() == "chan":
                break
            self.i += 1
        self.primary()

    def primary(self) -> None:
        word, kind = self.text, self.kind
        literal = False
        if kind in "nsc":
            self.i += 1
        elif word == "(":
            self.i += 1
            self.with_literals(self.expression_or_parenthesised_type)
            self.need(")")
        elif word == "func":
            self.i += 1
            self.signature()
            if self.at("{"):
                self.with_literals(self.block)
        elif word in ("[", "map", "chan", "struct", "interface", "<-"):
            self.type()
            literal = True
            if self.at("{"):
                self.composite()
        else:
            self.name()
            literal = True
        while True:
            if self.take("."):
                literal = True
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.name()
            elif self.take("["):
                self.with_literals(self.subscript)
                self.need("]")
            elif self.take("("):
                self.with_literals(lambda: self.listed(")", self.argument))
                literal = False
            elif self.at("{") and literal and self.literals:
                self.composite()
                literal = False
            else:
                return

    def expression_or_parenthesised_type(self) -> None:
        place = self.i
        try:
            self.expression()
            if self.at(")"):
                return
        except Fault:
            pass
        self.i = place
        self.type()

    def subscript(self) -> None:
        if not self.at(":"):
            self.expression_or_argument_type()
            while self.take(","):
                if self.at("]"):
                    return
                self.type()
        for _ in range(2):
            if self.take(":") and not self.at("]", ":"):
                self.expression()

    def expression_or_argument_type(self) -> None:
        place = self.i
        try:
            self.expression()
            if self.at("]", ":", ","):
                return
        except Fault:
            pass
        self.i = place
        self.type()

    def argument(self) -> None:
        place = self.i
        try:
            self.expression()
            if self.at(",", ")", "..."):
                self.take("...")
                return
        except Fault:
            pass
        self.i = place
        self.type()

    def composite(self) -> None:
        self.need("{")
        self.with_literals(lambda: self.listed("}", self.element))

    def element(self) -> None:
        self.value()
        if self.take(":"):
            self.value()

    def value(self) -> None:
        if self.at("{"):
            self.composite()
        else:
            self.expression()


def check(tokens) -> None:
    cursor = Go(tokens)
    # The semicolon that a line's end put in before a closing bracket of a list is one the language has there too.
    if cursor.kind == "e":
        return
    try:
        cursor.file()
    except IndexError as e:
        raise Fault(type(e).__name__) from None
