"""Grammar of Rust 2021: items, statements, expressions, patterns and types."""

from __future__ import annotations

from tessellar.llm.syntax.cursor import Cursor
from tessellar.llm.syntax.lexing import Fault

# Reserved words (weak ones are names elsewhere), operators by precedence.
RESERVED = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"
    " async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split()
)
PATH_WORDS = frozenset(("self", "Self", "super", "crate"))
ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<="))
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, "|": 4, "^": 5, "&": 6, "<<": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
BLOCK_STARTS = frozenset(("{", "if", "match", "loop", "while", "for", "unsafe"))
ITEM_STARTS = frozenset(("fn", "struct", "enum", "trait", "impl", "mod", "use", "static", "extern", "type", "pub"))


class Rust(Cursor):
    RESERVED = RESERVED

    def file(self) -> None:
        while self.kind != "e":
            if self.at("#") and self.ahead() == "!":
                self.inner_attribute()
            else:
                self.item()

    def inner_attribute(self) -> None:
        self.need("#")
        self.need("!")
        if not self.at("["):
            self.fail("[")
        self.skip_group()

    def attributes(self) -> None:
        while self.at("#"):
            if self.ahead() == "!":
                self.inner_attribute()
                continue
            self.i += 1
            if not self.at("["):
                self.fail("[")
            self.skip_group()

    def visibility(self) -> bool:
        if not self.take("pub"):
            return False
        if self.at("(") and self.ahead() in ("crate", "self", "super", "in"):
            self.skip_group()
        return True

    # Items

    def item(self) -> None:
        self.attributes()
        public = self.visibility()
        word = self.text
        if self.kind == "e":
            self.fail("an item")
        if word == "const" and self.ahead() not in ("fn", "unsafe", "extern", "async") or word == "static":
            self.constant()
        elif word in ("fn", "const", "async", "extern", "unsafe") or word == "default" and self.ahead() in ("fn", "unsafe", "async", "const", "impl", "type"):
            self.qualified()
        elif word == "use":
            self.i += 1
            self.use_tree()
            self.need(";")
        elif word == "mod":
            self.i += 1
            self.name()
            if not self.take(";"):
                self.need("{")
                self.items_to_brace()
        elif word == "struct" or word == "union" and self.k[self.i + 1] == "i":
            self.struct()
        elif word == "enum":
            self.enum()
        elif word == "trait" or word == "auto" and self.ahead() == "trait":
            self.trait()
        elif word == "impl":
            self.implementation()
        elif word == "type":
            self.alias()
        elif word == "macro_rules" and self.ahead() == "!":
            self.i += 2
            self.name()
            self.macro_group()
        elif not public and self.kind == "i" and (word not in RESERVED or word in PATH_WORDS) or word == "::":
            self.path(expression=False)
            self.need("!")
            if self.kind == "i":
                self.name()
            self.macro_group()
        else:
            self.fail("an item")

    def macro_group(self) -> None:
        brace = self.at("{")
        if not self.at("(", "[", "{"):
            self.fail("the group of a macro")
        self.skip_group()
        if not brace:
            self.need(";")

    def items_to_brace(self) -> None:
        while not self.take("}"):
            self.item()

    def use_tree(self) -> None:
        self.take("::")
        while True:
            if self.take("*"):
                return
            if self.take("{"):
                self.listed("}", self.use_tree)
                return
            if self.text in PATH_WORDS:
                self.i += 1
            else:
                self.name()
            if not self.take("::"):
                break
        if self.take("as") and not self.take("_"):
            self.name()

    def constant(self) -> None:
        self.i += 1
        self.take("mut")
        if not self.take("_"):
            self.name()
        self.need(":")
        self.type()
        if self.take("="):
            self.expression()
        self.need(";")

    def qualified(self) -> None:
        """Functions with their qualifiers, external blocks and crates, unsafe traits and implementations."""
        while self.text in ("const", "async", "unsafe", "extern", "default"):
            word = self.text
            self.i += 1
            if word == "extern":
                if self.kind == "s":
                    self.i += 1
                if self.take("crate"):
                    if not self.take("self"):
                        self.name()
                    if self.take("as") and not self.take("_"):
                        self.name()
                    self.need(";")
                    return
                if self.take("{"):
                    self.items_to_brace()
                    return
        if self.at("trait", "auto"):
            self.trait()
        elif self.at("impl"):
            self.implementation()
        elif self.at("type"):
            self.alias()
        else:
            self.function()

    def function(self) -> None:
        self.need("fn")
        self.name()
        self.generics()
        self.need("(")
        self.listed(")", self.parameter)
        if self.take("->"):
            self.type()
        self.where()
        if not self.take(";"):
            self.block()

    def parameter(self) -> None:
        self.attributes()
        if self.take("..."):
            return
        place = self.i
        if self.take("&"):
            if self.kind == "l":
                self.i += 1
        self.take("mut")
        if self.take("self"):
            if self.take(":"):
                self.type()
            return
        self.i = place
        if not self.tried(self.typed_pattern):
            self.type()

    def typed_pattern(self) -> None:
        self.pattern()
        self.need(":")
        if self.take("..."):
            return
        self.type()

    def generics(self) -> None:
        if not self.take("<"):
            return
        self.listed(">", self.generic_parameter)

    def generic_parameter(self) -> None:
        self.attributes()
        if self.kind == "l":
            self.i += 1
            if self.take(":"):
                self.bounds()
        elif self.take("const"):
            self.name()
            self.need(":")
            self.type()
            if self.take("="):
                self.const_argument()
        else:
            self.name()
            if self.take(":"):
                self.bounds()
            if self.take("="):
                self.type()

    def const_argument(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.take("-")
            if self.kind in "nsc" or self.at("true", "false"):
                self.i += 1
            else:
                self.path(expression=False)

    def bounds(self) -> None:
        while True:
            if self.kind == "l":
                self.i += 1
            elif self.at("(", "?", "for", "~", "<", "::", "async", "const") or self.kind == "i" and (self.text not in RESERVED or self.text in PATH_WORDS):
                self.bound()
            else:
                return
            if not self.take("+"):
                return

    def bound(self) -> None:
        if self.take("("):
            self.bound()
            self.need(")")
            return
        self.take("~")
        self.take("const")
        self.take("async")
        self.take("?")
        self.for_lifetimes()
        self.path(expression=False)

    def for_lifetimes(self) -> None:
        if self.take("for"):
            self.generics()

    def where(self) -> None:
        if not self.take("where"):
            return
        while not self.at("{", ";", "=") and self.kind != "e":
            if self.kind == "l":
                self.i += 1
            else:
                self.for_lifetimes()
                self.type()
            self.need(":")
            self.bounds()
            if not self.take(","):
                return

    def fields(self) -> None:
        self.listed("}", self.named_field)

    def named_field(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        self.need(":")
        self.type()

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def struct(self) -> None:
        self.i += 1
        self.name()
        self.generics()
        self.where()
        if self.take("{"):
            self.fields()
        elif self.take("("):
            self.listed(")", self.tuple_field)
            self.where()
            self.need(";")
        else:
            self.need(";")

    def enum(self) -> None:
        self.i += 1
        self.name()
        self.generics()
        self.where()
        self.need("{")
        self.listed("}", self.variant)

    def variant(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        if self.take("{"):
            self.fields()
        elif self.take("("):
            self.listed(")", self.tuple_field)
        if self.take("="):
            self.expression()

    def trait(self) -> None:
        self.take("auto")
        self.need("trait")
        self.name()
        self.generics()
        if self.take(":"):
            self.bounds()
        self.where()
        if self.take("="):
            self.bounds()
            self.where()
            self.need(";")
            return
        self.need("{")
        self.items_to_brace()

    def implementation(self) -> None:
        self.need("impl")
        if self.at("<") and self.ahead() != "<":
            self.tried(self.generics)
        self.take("const")
        self.take("!")
        self.type()
        if self.take("for"):
            self.type()
        self.where()
        self.need("{")
        while self.at("#") and self.ahead() == "!":
            self.inner_attribute()
        self.items_to_brace()

    def alias(self) -> None:
        self.i += 1
        self.name()
        self.generics()
        if self.take(":"):
            self.bounds()
        self.where()
        if self.take("="):
            self.type()
        self.where()
        self.need(";")

    # Types and paths

    def path(self, expression: bool) -> None:
        """A path; in expressions type arguments need :: before them."""
        if self.take("<"):
            self.type()
            if self.take("as"):
                self.path(expression=False)
            self.need(">")
            self.need("::")
        else:
            self.take("::")
        while True:
            if self.text in PATH_WORDS:
                self.i += 1
            else:
                self.name()
            if not expression and self.at("<"):
                self.type_arguments()
            elif not expression and self.at("(") and self.kind == "o":
                self.i += 1
                self.listed(")", self.type)
                if self.take("->"):
                    self.type_no_bounds()
                return
            if not self.at("::"):
                return
            if self.ahead() in ("{", "*"):
                return
            self.i += 1
            if self.at("<"):
                self.type_arguments()
                if not self.take("::"):
                    return
            elif not expression and self.at("("):
                continue

    def type_arguments(self) -> None:
        self.need("<")
        self.listed(">", self.type_argument)

    def type_argument(self) -> None:
        if self.kind == "l":
            self.i += 1
        elif self.kind in "nsc" or self.at("{", "-", "true", "false"):
            self.const_argument()
        elif self.kind == "i" and self.ahead() in ("=", ":") and self.text not in RESERVED:
            self.name()
            if self.take("="):
                self.const_argument() if self.kind in "nsc" or self.at("{", "-") else self.type()
            else:
                self.i += 1
                self.bounds()
        else:
            self.type()
            if self.take("="):
                self.type()
            elif self.take(":"):
                self.bounds()

    def type(self) -> None:
        self.type_no_bounds()
        while self.at("+"):
            self.i += 1
            self.bounds()

    def type_no_bounds(self) -> None:
        word = self.text
        if self.kind == "l":
            self.fail("a type")
        if word in ("&", "&&"):
            self.i += 1
            if self.kind == "l":
                self.i += 1
            self.take("mut")
            self.type_no_bounds()
        elif word == "*":
            self.i += 1
            if not (self.take("const") or self.take("mut")):
                self.fail("const or mut")
            self.type_no_bounds()
        elif word == "(":
            self.i += 1
            self.listed(")", self.type)
        elif word == "[":
            self.i += 1
            self.type()
            if self.take(";"):
                self.expression()
            self.need("]")
        elif word in ("!", "_"):
            self.i += 1
        elif word in ("impl", "dyn"):
            self.i += 1
            self.bounds()
        elif word == "for":
            self.for_lifetimes()
            self.type_no_bounds()
        elif word in ("fn", "unsafe", "extern"):
            self.take("unsafe")
            if self.take("extern") and self.kind == "s":
                self.i += 1
            self.need("fn")
            self.need("(")
            self.listed(")", self.function_type_parameter)
            if self.take("->"):
                self.type_no_bounds()
        else:
            self.path(expression=False)
            if self.at("!") and self.ahead() in ("(", "[", "{"):
                self.i += 1
                self.skip_group()

    def function_type_parameter(self) -> None:
        self.attributes()
        if self.take("..."):
            return
        if (self.kind == "i" or self.at("_")) and self.ahead() == ":":
            self.i += 2
        self.type()

    # Patterns

    def pattern(self) -> None:
        self.take("|")
        self.pattern_one()
        while self.take("|"):
            self.pattern_one()

    def pattern_one(self) -> None:
        word, kind = self.text, self.kind
        if word in ("_", ".."):
            self.i += 1
            if word == ".." and (self.kind in "nc" or self.kind == "i" and self.text not in RESERVED):
                self.range_end()
        elif word in ("..=", "..."):
            self.i += 1
            self.range_end()
        elif word in ("&", "&&"):
            self.i += 1
            self.take("mut")
            self.pattern_one()
        elif word == "(":
            self.i += 1
            self.listed(")", self.pattern)
        elif word == "[":
            self.i += 1
            self.listed("]", self.pattern)
        elif kind in "nsc" or word in ("-", "true", "false"):
            self.range_end()
            if self.at("..", "..=", "..."):
                self.i += 1
                if self.kind in "nc" or self.at("-") or self.kind == "i" and self.text not in RESERVED:
                    self.range_end()
        elif word in ("ref", "mut"):
            self.take("ref")
            self.take("mut")
            self.name()
            if self.take("@"):
                self.pattern_one()
        elif word == "box":
            self.i += 1
            self.pattern_one()
        elif word == "const" and self.ahead() == "{":
            self.i += 1
            self.block()
        else:
            if kind == "i" and word not in RESERVED and self.ahead() == "@":
                self.i += 2
                self.pattern_one()
                return
            self.path(expression=True)
            if self.take("("):
                self.listed(")", self.pattern)
            elif self.take("{"):
                self.listed("}", self.field_pattern)
            elif self.take("!"):
                if not self.at("(", "[", "{"):
                    self.fail("the group of a macro")
                self.skip_group()
            elif self.at("..", "..=", "..."):
                self.i += 1
                if self.kind in "nc" or self.at("-") or self.kind == "i" and self.text not in RESERVED:
                    self.range_end()

    def range_end(self) -> None:
        self.take("-")
        if self.kind in "nsc" or self.at("true", "false"):
            self.i += 1
        else:
            self.path(expression=True)

    def field_pattern(self) -> None:
        self.attributes()
        if self.take(".."):
            return
        if (self.kind in "in") and self.ahead() == ":" and self.text not in ("ref", "mut"):
            self.i += 2
            self.pattern()
            return
        self.take("box")
        self.take("ref")
        self.take("mut")
        self.name()

    # Statements and expressions

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def statement(self) -> None:
        if self.take(";"):
            return
        self.attributes()
        word = self.text
        if word == "let":
            self.i += 1
            self.pattern()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
                if self.take("else"):
                    self.block()
            self.need(";")
            return
        if self.starts_item():
            self.item()
            return
        block_like = word in BLOCK_STARTS or self.kind == "l" or word in ("async", "const") and self.ahead() in ("{", "move") and not self.closure_ahead()
        if block_like:
            self.operand(False)
            if self.at(".", "?") and not (self.at(".") and self.ahead() == "."):
                self.postfix()
                self.binary_rest(0, False)
                self.assignment_rest(False)
            elif self.take(";") or self.at("}"):
                return
            else:
                return
        else:
            brace_macro = self.is_brace_macro()
            self.expression()
            if brace_macro and self.t[self.i - 1] == "}":
                self.take(";")
                return
        if not self.take(";") and not self.at("}"):
            self.fail(";")

    def closure_ahead(self) -> bool:
        j = self.i + 1
        while self.t[j] == "move":
            j += 1
        return self.t[j] in ("|", "||")

    def is_brace_macro(self) -> bool:
        j = self.i
        while self.k[j] == "i" and self.t[j + 1] == "::":
            j += 2
        return self.k[j] == "i" and self.t[j + 1] == "!" and self.t[j + 2] == "{"

    def starts_item(self) -> bool:
        word, after = self.text, self.ahead()
        if word in ITEM_STARTS:
            return not (word == "extern" and False)
        if word == "const":
            return after != "{" and not self.closure_ahead() and after not in ("move", "|", "||")
        if word == "unsafe":
            return after in ("fn", "impl", "trait", "extern", "auto")
        if word == "async":
            return after in ("fn", "unsafe") or after == "extern"
        if word == "macro_rules":
            return after == "!"
        return word == "union" and self.k[self.i + 1] == "i" and self.t[self.i + 2] in ("{", "<")

    def expression(self, no_struct: bool = False) -> None:
        self.binary(0, no_struct)
        self.assignment_rest(no_struct)

    def assignment_rest(self, no_struct: bool) -> None:
        if self.text in ASSIGN or self.at(">") and self.glued() and self.ahead() == ">" and self.ahead(2) == "=":
            if self.at(">"):
                self.i += 3
            else:
                self.i += 1
            self.expression(no_struct)
        elif self.at("..", "..="):
            closed = self.at("..=")
            self.i += 1
            if self.starts_operand(no_struct):
                self.binary(1, no_struct)
            elif closed:
                self.fail("the end of a range")

    def starts_operand(self, no_struct: bool) -> bool:
        if self.kind in "nscl":
            return True
        if self.kind == "i":
            return self.text not in ("as", "else", "in", "where")
        return self.at("(", "[", "-", "!", "*", "&", "&&", "|", "||", "<", "::") or self.at("{") and not no_struct

    def binary(self, least: int, no_struct: bool) -> None:
        self.unary(no_struct)
        self.binary_rest(least, no_struct)

    def binary_rest(self, least: int, no_struct: bool) -> None:
        while True:
            if self.take("as"):
                self.type_no_bounds()
                continue
            word = self.text
            width = 1
            if word == ">":
                if self.glued() and self.ahead() == ">" and not (self.ahead(2) == "=" and self.starts[self.i + 2] == self.starts[self.i] + 2):
                    rank, width = 7, 2
                elif self.glued() and self.ahead() == ">":
                    return
                else:
                    rank = 3
                    if self.glued() and self.ahead() == "=":
                        width = 2
            else:
                rank = BINARY.get(word, 0) if self.kind == "o" else 0
            if not rank or rank < least:
                return
            self.i += width
            self.binary(rank + 1, no_struct)

    def unary(self, no_struct: bool) -> None:
        word = self.text
        if self.kind == "o":
            if word in ("-", "!", "*"):
                self.i += 1
                self.unary(no_struct)
                return
            if word in ("&", "&&"):
                self.i += 1
                if self.at("raw") and self.ahead() in ("const", "mut"):
                    self.i += 2
                else:
                    self.take("mut")
                self.unary(no_struct)
                return
            if word in ("..", "..="):
                self.i += 1
                if self.starts_operand(no_struct):
                    self.binary(1, no_struct)
                return
            if word == "#":
                self.attributes()
                self.unary(no_struct)
                return
        self.operand(no_struct)
        self.postfix()

    def postfix(self) -> None:
        while True:
            if self.take("?"):
                continue
            if self.at(".") and self.kind == "o":
                self.i += 1
                if self.take("await"):
                    continue
                if self.kind == "n":
                    self.i += 1
                    continue
                self.name()
                if self.at("::"):
                    self.i += 1
                    self.type_arguments()
                continue
            if self.take("("):
                self.listed(")", self.expression)
                continue
            if self.take("["):
                self.expression()
                self.need("]")
                continue
            return

    def operand(self, no_struct: bool) -> None:
        word, kind = self.text, self.kind
        if kind in "nsc" or word in ("true", "false"):
            self.i += 1
        elif kind == "l":
            self.i += 1
            self.need(":")
            if self.at("loop", "while", "for", "{"):
                self.operand(no_struct)
            else:
                self.fail("a loop")
        elif word == "(":
            self.i += 1
            self.attributes()
            self.listed(")", self.expression)
        elif word == "[":
            self.i += 1
            self.attributes()
            if self.take("]"):
                return
            self.expression()
            if self.take(";"):
                self.expression()
                self.need("]")
            elif self.take(","):
                self.listed("]", self.expression)
            else:
                self.need("]")
        elif word == "{":
            self.block()
        elif word == "if":
            self.i += 1
            self.condition()
            self.block()
            if self.take("else"):
                if self.at("if"):
                    self.operand(no_struct)
                else:
                    self.block()
        elif word == "match":
            self.i += 1
            self.expression(True)
            self.need("{")
            while self.at("#") and self.ahead() == "!":
                self.inner_attribute()
            while not self.take("}"):
                self.arm()
        elif word == "while":
            self.i += 1
            self.condition()
            self.block()
        elif word == "loop":
            self.i += 1
            self.block()
        elif word == "for" and self.ahead() != "<":
            self.i += 1
            self.pattern()
            self.need("in")
            self.expression(True)
            self.block()
        elif word in ("unsafe", "const") and self.ahead() == "{":
            self.i += 1
            self.block()
        elif word == "async" and self.ahead() in ("{", "move") and not self.closure_ahead():
            self.i += 1
            self.take("move")
            self.block()
        elif word in ("|", "||", "move", "static", "async", "for", "const"):
            self.closure(no_struct)
        elif word in ("return", "break", "continue", "yield"):
            self.i += 1
            if word in ("break", "continue") and self.kind == "l" and self.ahead() != ":":
                self.i += 1
            if word != "continue" and self.starts_operand(no_struct) or self.at(".."):
                self.expression(no_struct)
        elif word == "let":
            self.i += 1
            self.pattern()
            self.need("=")
            self.binary(3, no_struct)
        elif word == "_":
            self.i += 1
        else:
            self.path(expression=True)
            if self.at("!") and self.ahead() in ("(", "[", "{"):
                self.i += 1
                self.skip_group()
            elif self.at("{") and not no_struct and self.struct_ahead():
                self.i += 1
                self.listed("}", self.field_value)

    def struct_ahead(self) -> bool:
        a, b = self.ahead(1), self.ahead(2)
        return a in ("}", "..", "#") or self.k[self.i + 1] in "in" and b in (":", ",", "}")

    def field_value(self) -> None:
        self.attributes()
        if self.take(".."):
            if not self.at("}"):
                self.expression()
            return
        if self.kind == "n":
            self.i += 1
            self.need(":")
            self.expression()
            return
        self.name()
        if self.take(":"):
            self.expression()

    def condition(self) -> None:
        self.expression(True)

    def arm(self) -> None:
        self.attributes()
        self.pattern()
        if self.take("if"):
            self.expression()
        self.need("=>")
        if self.at("{"):
            # A block is the whole arm unless a call or field of it follows.
            place = self.i
            self.block()
            if self.take(",") or not self.at(".", "?"):
                return
            self.i = place
        self.expression()
        if not self.take(",") and not self.at("}"):
            # An arm that ends in a block needs no comma.
            if self.t[self.i - 1] != "}":
                self.fail(",")

    def closure(self, no_struct: bool) -> None:
        if self.at("for"):
            self.for_lifetimes()
        while self.text in ("move", "static", "async", "const"):
            self.i += 1
        if not self.take("||"):
            self.need("|")
            while not self.take("|"):
                self.attributes()
                self.pattern_one()
                if self.take(":"):
                    self.type()
                if not self.take(","):
                    self.need("|")
                    break
        if self.take("->"):
            self.type_no_bounds()
            self.block()
        else:
            self.expression(no_struct)


def check(tokens) -> None:
    cursor = Rust(tokens)
    try:
        cursor.file()
    except IndexError as e:
        raise Fault(type(e).__name__) from None
