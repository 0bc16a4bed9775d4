"""Grammar of JavaScript (with JSX), TypeScript and TSX."""

from __future__ import annotations

from tessellar.llm.syntax.cursor import Cursor
from tessellar.llm.syntax.lexing import Fault

# Fixed values.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, ">>": 9, ">>>": 9, "<<": 9,
    "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12, "instanceof": 8, "in": 8,
}
ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="))
UNARY = frozenset(("!", "~", "+", "-", "++", "--", "typeof", "void", "delete"))
MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor".split())
TYPE_OPERATORS = frozenset(("keyof", "unique", "readonly", "infer"))


class Script(Cursor):
    RESERVED = RESERVED

    def __init__(self, tokens, typed: bool, jsx: bool):
        super().__init__(tokens)
        self.typed, self.jsx = typed, jsx
        #: For each opening bracket the place of its closing one.
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if self.k[i] == "o":
                if t in ("(", "[", "{", "${"):
                    stack.append(i)
                elif t in (")", "]", "}", "}$") and stack:
                    self.partner[stack.pop()] = i
        self.no_in = False
        #: Inside a declaration without code, where constants have no value.
        self.ambient = False

    def file(self) -> None:
        while self.kind != "e":
            self.statement()

    def end(self) -> None:
        """The end of a statement: a semicolon, or where one may be left out."""
        if self.take(";") or self.at("}") or self.kind == "e" or self.breaks[self.i]:
            return
        self.fail(";")

    # Statements

    def statement(self) -> None:
        word, kind = self.text, self.kind
        if kind == "o":
            if word == "{":
                self.block()
            elif word == ";":
                self.i += 1
            elif word == "@":
                self.decorators()
                self.statement()
            else:
                self.expression_statement()
            return
        if kind != "i":
            self.expression_statement()
            return
        after = self.ahead()
        method = getattr(self, "s_" + word, None)
        if method and word in RESERVED:
            if word == "import" and after in ("(", "."):
                self.expression_statement()
            else:
                method()
            return
        same_line = not self.breaks[self.i + 1]
        if word == "let" and (self.k[self.i + 1] == "i" and after not in ("in", "of", "instanceof") or after in ("[", "{")):
            self.variables()
            self.end()
        elif word == "async" and after == "function" and same_line:
            self.i += 1
            self.s_function()
        elif after == ":" and word not in RESERVED:
            self.i += 2
            self.statement()
        elif self.typed and self.k[self.i + 1] == "i" and same_line and word in ("interface", "type", "declare", "namespace", "module", "abstract", "global") and after not in ("in", "instanceof", "of", "as"):
            self.typed_declaration()
        elif self.typed and word in ("module", "global", "declare") and same_line and (self.k[self.i + 1] == "s" and word == "module" or word == "global" and after == "{"):
            self.typed_declaration()
        else:
            self.expression_statement()

    def expression_statement(self) -> None:
        self.expression()
        self.end()

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def s_var(self) -> None:
        self.variables()
        self.end()

    def s_const(self) -> None:
        if self.ahead() == "enum" and self.typed:
            self.i += 1
            self.s_enum()
            return
        self.variables()
        self.end()

    def variables(self, ambient: bool = False, loop: bool = False) -> None:
        word = self.text
        self.i += 1
        while True:
            pattern = self.at("[", "{")
            self.binding()
            if self.typed:
                if self.at("!") and self.ahead() == ":":
                    self.i += 1
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment()
            elif not ambient and not self.ambient and not (loop and self.at("of", "in")) and (word == "const" or pattern):
                self.fail("=")
            if not self.take(","):
                return

    def binding(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.with_in(self.assignment)
                if not self.at("]"):
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.binding()
                else:
                    short = self.kind == "i"
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not short:
                        self.fail(":")
                    if self.take("="):
                        self.with_in(self.assignment)
                if not self.at("}"):
                    self.need(",")
        else:
            self.name()

    def with_in(self, step) -> None:
        before, self.no_in = self.no_in, False
        try:
            step()
        finally:
            self.no_in = before

    def property_name(self) -> None:
        if self.take("["):
            self.with_in(self.assignment)
            self.need("]")
        elif self.kind in "isn":
            self.i += 1
        else:
            self.fail("a property")

    def s_function(self, ambient: bool = False) -> None:
        self.need("function")
        self.take("*")
        if not self.at("(") and not self.at("<"):
            self.name()
        self.function_rest(ambient)

    def function_rest(self, ambient: bool = False) -> None:
        """Parameters, return type and body; overloads and ambient declarations have none."""
        if self.typed and self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.typed and self.take(":"):
            self.return_type()
        if self.at("{"):
            self.with_in(self.block)
        elif self.typed:
            self.end()
        else:
            self.fail("{")

    def parameters(self) -> None:
        self.need("(")
        self.with_in(lambda: self.listed(")", self.parameter))

    def parameter(self) -> None:
        self.decorators()
        if self.typed:
            while self.text in MODIFIERS and (self.k[self.i + 1] == "i" or self.ahead() in ("{", "[")):
                self.i += 1
            if self.at("this"):
                self.i += 1
                if self.take(":"):
                    self.type()
                return
        self.take("...")
        self.binding()
        if self.typed:
            self.take("?")
            if self.take(":"):
                self.type()
        if self.take("="):
            self.assignment()

    def decorators(self) -> None:
        while self.take("@"):
            if self.at("("):
                self.skip_group()
            else:
                self.i += 1
                while self.take("."):
                    self.i += 1
                if self.at("("):
                    self.skip_group()

    def s_class(self) -> None:
        self.class_expression()

    def class_expression(self) -> None:
        self.need("class")
        if self.kind == "i" and not self.at("extends", "implements") and not self.at("{"):
            self.name()
        if self.typed and self.at("<"):
            self.type_parameters()
        if self.take("extends"):
            self.left_hand()
            if self.typed and self.at("<"):
                self.type_arguments()
        if self.typed and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{")
        while not self.take("}"):
            self.member()

    def member(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        if self.at("static") and self.ahead() == "{":
            self.i += 1
            self.with_in(self.block)
            return
        while self.kind == "i" and self.text in (MODIFIERS if self.typed else ("static", "async", "accessor")) and self.modifies():
            self.i += 1
        self.take("*")
        if self.at("get", "set") and self.modifies():
            self.i += 1
        if self.typed and self.at("[") and self.k[self.i + 1] == "i" and self.ahead(2) == ":":
            self.i += 3
            self.type()
            self.need("]")
            if self.take(":"):
                self.type()
            self.end()
            return
        self.property_name()
        if self.typed:
            if not self.take("?") and self.at("!") and not self.breaks[self.i]:
                self.i += 1
        if self.at("(") or self.typed and self.at("<"):
            self.function_rest()
            return
        if self.typed and self.take(":"):
            self.type()
        if self.take("="):
            self.with_in(self.assignment)
        self.end()

    def modifies(self) -> bool:
        """Whether the name here is a modifier of the member that follows rather than the member's own name."""
        return self.k[self.i + 1] in "isn" or self.ahead() in ("[", "*", "{")

    def condition(self) -> None:
        self.need("(")
        self.with_in(self.expression)
        self.need(")")

    def s_if(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def s_with(self) -> None:
        self.s_while()

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.take(";")

    def s_for(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        before, self.no_in = self.no_in, True
        if self.at("var", "const") or self.at("let") and (self.k[self.i + 1] == "i" or self.ahead() in ("[", "{")):
            self.variables(loop=True)
        elif not self.at(";"):
            self.expression()
        self.no_in = before
        if self.take("of"):
            self.with_in(self.assignment)
        elif self.take("in"):
            self.with_in(self.expression)
        else:
            self.need(";")
            if not self.at(";"):
                self.with_in(self.expression)
            self.need(";")
            if not self.at(")"):
                self.with_in(self.expression)
        self.need(")")
        self.statement()

    def s_return(self) -> None:
        self.i += 1
        if not (self.at(";", "}") or self.kind == "e" or self.breaks[self.i]):
            self.expression()
        self.end()

    def s_throw(self) -> None:
        self.i += 1
        if self.breaks[self.i]:
            self.fail("an expression")
        self.expression()
        self.end()

    def s_break(self) -> None:
        self.i += 1
        if self.kind == "i" and not self.breaks[self.i]:
            self.name()
        self.end()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.i += 1
        self.end()

    def s_try(self) -> None:
        self.i += 1
        self.block()
        some = False
        if self.take("catch"):
            some = True
            if self.take("("):
                self.binding()
                if self.typed and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take("finally"):
            some = True
            self.block()
        if not some:
            self.fail("catch")

    def s_switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.with_in(self.expression)
            elif not self.take("default"):
                self.fail("case")
            self.need(":")
            while not self.at("case", "default", "}"):
                self.statement()

    def s_enum(self) -> None:
        if not self.typed:
            self.fail()
        self.i += 1
        self.name()
        self.need("{")

        def one() -> None:
            self.property_name()
            if self.take("="):
                self.assignment()

        self.listed("}", one)

    def from_clause(self, needed: bool) -> None:
        if not self.take("from"):
            if needed:
                self.fail("from")
            return
        self.module()

    def module(self) -> None:
        if self.kind != "s":
            self.fail("a module")
        self.i += 1
        if self.at("with", "assert") and self.ahead() == "{" and not self.breaks[self.i]:
            self.i += 1
            self.skip_group()

    def specifier(self) -> None:
        if self.typed and self.at("type") and (self.k[self.i + 1] in "is") and not (self.ahead() == "as" and self.ahead(2) != "as"):
            self.i += 1
        if self.kind not in "is":
            self.fail("a name")
        self.i += 1
        if self.take("as"):
            if self.kind not in "is":
                self.fail("a name")
            self.i += 1

    def s_import(self) -> None:
        self.i += 1
        if self.kind == "s":
            self.module()
            self.end()
            return
        if self.typed and self.at("type") and (self.ahead() in ("{", "*") or self.k[self.i + 1] == "i" and self.ahead() != "from"):
            self.i += 1
        if self.kind == "i" and not self.at("{", "*"):
            self.name()
            if self.typed and self.take("="):
                self.left_hand()
                self.end()
                return
            if not self.take(","):
                self.from_clause(True)
                self.end()
                return
        if self.take("*"):
            self.need("as")
            self.name()
        else:
            self.need("{")
            self.listed("}", self.specifier)
        self.from_clause(True)
        self.end()

    def s_export(self) -> None:
        self.i += 1
        if self.take("*"):
            if self.take("as"):
                if self.kind not in "is":
                    self.fail("a name")
                self.i += 1
            self.from_clause(True)
            self.end()
        elif self.at("{") or self.typed and self.at("type") and self.ahead() == "{":
            self.take("type")
            self.need("{")
            self.listed("}", self.specifier)
            self.from_clause(False)
            self.end()
        elif self.typed and self.at("type") and self.ahead() == "*":
            self.i += 1
            self.need("*")
            if self.take("as"):
                self.i += 1
            self.from_clause(True)
            self.end()
        elif self.take("default"):
            if self.at("function"):
                self.s_function()
            elif self.at("async") and self.ahead() == "function":
                self.i += 1
                self.s_function()
            elif self.at("class") or self.at("@"):
                self.decorators()
                self.class_expression()
            elif self.typed and self.at("abstract") and self.ahead() == "class":
                self.i += 1
                self.class_expression()
            elif self.typed and self.at("interface") and self.k[self.i + 1] == "i":
                self.typed_declaration()
            else:
                self.assignment()
                self.end()
        elif self.typed and self.take("="):
            self.expression()
            self.end()
        elif self.typed and self.at("as") and self.ahead() == "namespace":
            self.i += 2
            self.name()
            self.end()
        elif self.at("var", "const", "let", "function", "class", "async", "@") or self.typed and self.at("interface", "type", "enum", "declare", "namespace", "module", "abstract", "import"):
            self.statement()
        else:
            self.fail("a declaration")

    # TypeScript's own declarations

    def typed_declaration(self) -> None:
        word = self.text
        if word == "interface":
            self.i += 1
            self.name()
            if self.at("<"):
                self.type_parameters()
            if self.take("extends"):
                self.type()
                while self.take(","):
                    self.type()
            self.object_type()
        elif word == "type":
            self.i += 1
            self.name()
            if self.at("<"):
                self.type_parameters()
            self.need("=")
            self.type()
            self.end()
        elif word == "abstract":
            self.i += 1
            self.class_expression()
        elif word == "declare":
            self.i += 1
            if self.at("var", "const", "let"):
                if self.ahead() == "enum":
                    self.i += 1
                    self.s_enum()
                else:
                    self.variables(ambient=True)
                    self.end()
            elif self.at("function"):
                self.s_function(ambient=True)
            else:
                before, self.ambient = self.ambient, True
                self.statement()
                self.ambient = before
        else:
            self.i += 1
            if self.kind == "s":
                self.i += 1
            elif word != "global":
                self.name()
                while self.take("."):
                    self.name()
            if self.at("{"):
                self.block()
            else:
                self.end()

    def type_parameters(self) -> None:
        self.need("<")

        def one() -> None:
            while self.at("const", "in", "out") and self.k[self.i + 1] == "i":
                self.i += 1
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()

        self.listed(">", one)

    def type_arguments(self) -> None:
        self.need("<")
        self.listed(">", self.type)

    def return_type(self) -> None:
        if self.at("asserts") and self.k[self.i + 1] == "i" and self.ahead() != "is":
            self.i += 2
            if self.take("is"):
                self.type()
        elif self.kind == "i" and self.ahead() == "is" and not self.breaks[self.i + 1]:
            self.i += 2
            self.type()
        else:
            self.type()

    def type(self) -> None:
        self.union_type()
        if self.at("extends") and not self.breaks[self.i]:
            place = self.i
            self.i += 1
            self.union_type()
            if not self.take("?"):
                self.i = place
                return
            self.type()
            self.need(":")
            self.type()

    def union_type(self) -> None:
        if self.at("|", "&"):
            self.i += 1
        self.one_type()
        while self.at("|", "&"):
            self.i += 1
            self.one_type()

    def one_type(self) -> None:
        word = self.text
        if self.kind == "i" and word in TYPE_OPERATORS and (self.k[self.i + 1] in "is" or self.ahead() in ("(", "[", "{")):
            self.i += 1
            self.one_type()
            if word == "infer" and self.at("extends"):
                self.tried(self.infer_constraint)
            return
        if word == "abstract" and self.ahead() == "new":
            self.i += 1
            word = "new"
        if word == "new" or word == "<":
            self.take("new")
            if self.at("<"):
                self.type_parameters()
            self.parameters()
            self.need("=>")
            self.return_type()
            return
        if word == "(":
            after = self.partner.get(self.i, self.i) + 1
            if self.t[after] == "=>":
                self.parameters()
                self.need("=>")
                self.return_type()
                return
            self.i += 1
            self.type()
            self.need(")")
        elif word == "{":
            self.object_type()
        elif word == "[":
            self.i += 1
            self.listed("]", self.tuple_member)
        elif self.kind in "sn" or word == "-":
            self.take("-")
            self.i += 1
        elif self.kind == "t":
            self.template(self.type)
        elif word == "typeof":
            self.i += 1
            if self.at("import"):
                self.import_type()
            else:
                if self.kind != "i":
                    self.fail("a name")
                self.i += 1
                while self.take("."):
                    self.i += 1
                if self.at("<") and not self.breaks[self.i]:
                    self.type_arguments()
        elif word == "import":
            self.import_type()
        elif self.kind == "i":
            if word in RESERVED and word not in ("this", "null", "void", "true", "false"):
                self.fail("a type")
            self.i += 1
            while self.take("."):
                if self.kind != "i":
                    self.fail("a name")
                self.i += 1
            if self.at("<") and not self.breaks[self.i]:
                self.type_arguments()
        else:
            self.fail("a type")
        while self.at("[") and not self.breaks[self.i]:
            self.i += 1
            if not self.take("]"):
                self.type()
                self.need("]")

    def infer_constraint(self) -> None:
        self.need("extends")
        self.union_type()
        if self.at("?"):
            self.fail()

    def import_type(self) -> None:
        self.need("import")
        self.need("(")
        self.type()
        if self.take(","):
            self.skip_group()
        self.need(")")
        while self.take("."):
            self.i += 1
        if self.at("<"):
            self.type_arguments()

    def tuple_member(self) -> None:
        self.take("...")
        if self.kind == "i" and (self.ahead() == ":" or self.ahead() == "?" and self.ahead(2) == ":"):
            self.i += 1
            self.take("?")
            self.i += 1
        self.type()
        self.take("?")

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.type_member()
            if not self.take(",") and not self.take(";") and not self.at("}") and not self.breaks[self.i]:
                self.fail(";")

    def type_member(self) -> None:
        if self.at("-", "+"):
            self.i += 1
        while self.at("readonly", "get", "set") and (self.k[self.i + 1] in "isn" or self.ahead() == "["):
            self.i += 1
        if self.at("new") and self.ahead() in ("(", "<"):
            self.i += 1
        if not self.at("(", "<"):
            if self.at("[") and self.k[self.i + 1] == "i" and self.ahead(2) in (":", "in"):
                mapped = self.ahead(2) == "in"
                self.i += 3
                self.type()
                if mapped and self.take("as"):
                    self.type()
                self.need("]")
            else:
                self.property_name()
        if self.at("-", "+") and self.ahead() == "?":
            self.i += 1
        self.take("?")
        if self.at("(", "<"):
            if self.at("<"):
                self.type_parameters()
            self.parameters()
            if self.take(":"):
                self.return_type()
        elif self.take(":"):
            self.type()

    # Expressions

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        word, kind = self.text, self.kind
        if kind == "i":
            if word == "async" and not self.breaks[self.i + 1]:
                if self.k[self.i + 1] == "i" and self.ahead(2) == "=>" or self.ahead() in ("(", "<"):
                    if self.tried(self.async_arrow):
                        return
            if word == "yield":
                self.i += 1
                self.take("*")
                if not (self.at(")", "]", "}", ",", ";", ":") or self.kind == "e" or self.breaks[self.i]):
                    self.assignment()
                return
            if self.ahead() == "=>" and word not in RESERVED:
                self.i += 1
                self.arrow_body()
                return
        elif word == "(":
            after = self.t[self.partner[self.i] + 1] if self.i in self.partner else ""
            if after == "=>" or self.typed and after == ":":
                if self.tried(self.arrow) or after == "=>" and self.refuse():
                    return
        elif word == "<" and self.typed:
            if self.tried(self.arrow):
                return
        self.conditional()
        if self.text in ASSIGN and self.kind == "o" or self.at(">") and self.shift_assign():
            self.i += 1
            self.assignment()

    def refuse(self) -> bool:
        self.arrow()
        return True

    def shift_assign(self) -> bool:
        j = self.i
        while self.t[j] == ">" and self.starts[j + 1] == self.starts[j] + 1:
            j += 1
        if j > self.i and self.t[j] in ("=", ">=") and j - self.i in (1, 2, 3):
            self.i = j
            return self.t[j] == ">=" or j - self.i >= 0
        return False

    def async_arrow(self) -> None:
        self.need("async")
        if self.kind == "i":
            self.name()
            self.arrow_body()
        else:
            self.arrow()

    def arrow(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.typed and self.take(":"):
            self.return_type()
        self.arrow_body()

    def arrow_body(self) -> None:
        if self.breaks[self.i]:
            self.fail("=> on the line")
        self.need("=>")
        if self.at("{"):
            self.with_in(self.block)
        else:
            self.assignment()

    def conditional(self) -> None:
        self.binary(1)
        if self.take("?"):
            self.with_in(self.assignment)
            self.need(":")
            self.assignment()

    def operator(self) -> tuple[str, int]:
        """The binary operator here and how many tokens it takes: > is lexed alone."""
        word = self.text
        if word != ">" or self.kind != "o":
            return word, 1
        width = 1
        while width < 3 and self.t[self.i + width] == ">" and self.starts[self.i + width] == self.starts[self.i] + width:
            width += 1
        if self.starts[self.i + width] == self.starts[self.i] + width and self.t[self.i + width] == "=":
            return (">=", 2) if width == 1 else ("", 0)
        return ">" * width, width

    def binary(self, least: int) -> None:
        self.unary()
        while True:
            if self.typed and self.at("as", "satisfies") and not self.breaks[self.i] and self.kind == "i":
                self.i += 1
                if not self.take("const"):
                    self.type()
                continue
            word, width = self.operator()
            if self.kind not in "oi" or word == "in" and self.no_in:
                return
            rank = BINARY.get(word, 0)
            if not rank or rank < least:
                return
            self.i += width
            self.binary(rank if word == "**" else rank + 1)

    def unary(self) -> None:
        word = self.text
        if self.kind == "o" and word in UNARY or self.kind == "i" and word in ("typeof", "void", "delete"):
            self.i += 1
            self.unary()
            return
        if self.kind == "i" and word == "await" and not self.at_operator_after():
            self.i += 1
            self.unary()
            return
        if word == "<" and self.typed and not self.jsx:
            self.type_arguments()
            self.unary()
            return
        self.left_hand()
        if self.at("++", "--") and not self.breaks[self.i]:
            self.i += 1

    def at_operator_after(self) -> bool:
        after = self.ahead()
        return self.k[self.i + 1] == "o" and after in (")", "]", "}", ",", ";", "=", ".", "=>", ":", "?") or self.k[self.i + 1] == "e"

    def left_hand(self) -> None:
        if self.take("new"):
            if self.take("."):
                self.name()
            else:
                self.new_target()
        else:
            self.primary()
        self.suffixes(calls=True)

    def new_target(self) -> None:
        if self.take("new"):
            self.new_target()
        else:
            self.primary()
        self.suffixes(calls=False)
        if self.typed and self.at("<"):
            self.tried(self.type_arguments)
        if self.at("("):
            self.arguments()

    def suffixes(self, calls: bool) -> None:
        while True:
            word = self.text
            if self.kind == "t" and word == "start":
                self.template(self.expression)
            elif self.kind != "o":
                return
            elif word == ".":
                self.i += 1
                if self.kind != "i":
                    self.fail("a name")
                self.i += 1
            elif word == "?.":
                self.i += 1
                if self.at("("):
                    self.arguments()
                elif self.take("["):
                    self.with_in(self.expression)
                    self.need("]")
                elif self.kind == "i":
                    self.i += 1
                elif self.kind != "t":
                    self.fail("a name")
            elif word == "[":
                self.i += 1
                self.with_in(self.expression)
                self.need("]")
            elif word == "(" and calls:
                self.arguments()
            elif word == "!" and self.typed and not self.breaks[self.i]:
                self.i += 1
            elif word == "<" and self.typed and calls:
                if not self.tried(self.call_type_arguments):
                    return
            else:
                return

    def call_type_arguments(self) -> None:
        self.type_arguments()
        if not (self.at("(", ")", "]", ",", ";", ":", "}", ".", "?.", "=", "==", "===") or self.kind in "te" or self.breaks[self.i]):
            self.fail("(")

    def arguments(self) -> None:
        self.need("(")

        def one() -> None:
            self.take("...")
            self.assignment()

        self.with_in(lambda: self.listed(")", one))

    def template(self, inner) -> None:
        self.i += 1
        while not (self.kind == "t" and self.text == "end"):
            self.need("${")
            self.with_in(inner)
            self.need("}$")
        self.i += 1

    def primary(self) -> None:
        word, kind = self.text, self.kind
        if kind in "nsr":
            self.i += 1
        elif kind == "t" and word == "start":
            self.template(self.expression)
        elif kind == "i":
            if word == "function":
                self.s_function()
            elif word == "class":
                self.class_expression()
            elif word == "async" and self.ahead() == "function" and not self.breaks[self.i + 1]:
                self.i += 1
                self.s_function()
            elif word == "import":
                self.i += 1
                if self.take("."):
                    self.i += 1
                elif not self.at("("):
                    self.fail("(")
            elif word in RESERVED and word not in ("this", "super", "null", "true", "false"):
                self.fail("an expression")
            else:
                self.i += 1
        elif word == "(":
            self.i += 1
            self.with_in(self.expression)
            self.need(")")
        elif word == "[":
            self.i += 1
            self.with_in(self.array)
        elif word == "{":
            self.i += 1
            self.with_in(lambda: self.listed("}", self.object_member))
        elif word == "jsx<":
            self.with_in(self.element)
        elif word == "@":
            self.decorators()
            self.class_expression()
        else:
            self.fail("an expression")

    def array(self) -> None:
        while not self.take("]"):
            if self.take(","):
                continue
            self.take("...")
            self.assignment()
            if not self.at("]"):
                self.need(",")

    def object_member(self) -> None:
        if self.take("..."):
            self.assignment()
            return
        if self.at("async") and self.modifies() and not self.breaks[self.i + 1]:
            self.i += 1
        self.take("*")
        if self.at("get", "set") and (self.k[self.i + 1] in "isn" or self.ahead() == "["):
            self.i += 1
        short = self.kind == "i" and self.text not in RESERVED
        self.property_name()
        if self.take(":"):
            self.assignment()
        elif self.at("(") or self.typed and self.at("<"):
            self.function_rest()
        elif short:
            if self.take("="):
                self.assignment()
        else:
            self.fail(":")

    # JSX

    def element_name(self) -> str:
        if self.kind != "x":
            self.fail("an element")
        name = self.text
        self.i += 1
        while self.at("jsx.", "jsx:"):
            name += self.text
            self.i += 1
            if self.kind != "x":
                self.fail("a name")
            name += self.text
            self.i += 1
        return name

    def element(self) -> None:
        self.need("jsx<")
        name = ""
        if not self.at("jsx>"):
            name = self.element_name()
            while not self.at("jsx>", "jsx/>"):
                self.attribute()
            if self.take("jsx/>"):
                return
        self.need("jsx>")
        while True:
            if self.kind == "y":
                self.i += 1
            elif self.take("{"):
                if not self.take("}"):
                    self.take("...")
                    self.expression()
                    self.need("}")
            elif self.at("jsx<"):
                self.element()
            elif self.take("jsx</"):
                closing = "" if self.at("jsx>") else self.element_name()
                self.need("jsx>")
                if closing != name:
                    raise Fault(f"</{closing}> ends <{name}>")
                return
            else:
                self.fail("an end tag")

    def attribute(self) -> None:
        if self.take("{"):
            self.need("...")
            self.assignment()
            self.need("}")
            return
        self.element_name()
        if self.take("jsx="):
            if self.kind == "s":
                self.i += 1
            elif self.take("{"):
                self.expression()
                self.need("}")
            elif self.at("jsx<"):
                self.element()
            else:
                self.fail("a value")


def check(tokens, typed: bool, jsx: bool) -> None:
    cursor = Script(tokens, typed, jsx)
    try:
        cursor.file()
    except IndexError as e:
        raise Fault(type(e).__name__) from None
