"""JavaScript and TypeScript.

Line ends that end a statement have become ``N`` before parsing: a line end counts
between a kind that can end an expression and one that can only begin a statement.
"""

from __future__ import annotations

import re

from .base import PARENS, Fail, Parser, codes, levels
from .lexer import code, name_of

_WORDS = "var let const if else for while do switch case default return break continue function class extends new this super throw try catch finally typeof void delete instanceof in import export null true false yield await async debugger enum"
_ENDERS = "ins)]}" + "".join(code(t) for t in ("++", "--", "return", "break", "continue", "this", "super", "null", "true", "false", "debugger", "yield", "await", "async", "default"))
_STARTERS = "ins@" + "".join(
    code(t) for t in "var let const if for while do switch case default return break continue function class new this super throw try typeof void delete import export null true false yield await async debugger enum keyof interface namespace ++ -- ! ~ ...".split()
)
_KEEP = re.compile(f"(?<=[{re.escape(_ENDERS)}])N(?=[{re.escape(_STARTERS)}])|N")


def end_lines(kinds: str) -> str:
    """Keep the ``N`` that end statements; the others become blanks that the parser drops."""
    return _KEEP.sub(lambda m: "N" if 0 < m.start() and m.end() < len(kinds) and kinds[m.start() - 1] in _ENDERS and kinds[m.end()] in _STARTERS else " ", kinds)


_OPERATOR = re.compile(f"{code('interface')}(?!i)|{code('namespace')}(?![is])|{code('keyof')}(?![is{{\\[(]|{code('typeof')})|{code('is')}(?![isn{{\\[(])|(?<![i{code('this')}]){code('is')}")


def end_typed_lines(kinds: str) -> str:
    """As :func:`end_lines`; the words of type operators are names where no type follows."""
    return end_lines(_OPERATOR.sub("i", kinds))


class Script(Parser):
    binary = levels(
        "= += -= *= /= %= &= |= ^= <<= **= &&= ||= ??=", "?", "??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<<", "+ -", "* / %", "**"
    )
    right = codes("= += -= *= /= %= &= |= ^= <<= **= &&= ||= ??=  **")
    after_simple = codes("else while catch finally")
    memo: dict = {}
    typed = False
    words = codes(_WORDS)

    def expression(self, low: int = 0) -> None:
        self.unary()
        while True:
            op = self.s[self.p]
            level = self.binary.get(op)
            if level is None:
                if self.typed and op == "i" and self.ahead(1) in codes("i { [ const typeof ( n s void null"):
                    if self.attempt(self.type_assertion):
                        continue
                return
            if level < low or self.no_in and op in codes("in") and self.no_in == self.depth:
                return
            self.p += 1
            self.operand(op, level)

    no_in = 0
    depth = 1

    def type_assertion(self) -> None:
        """``as T`` and ``satisfies T``."""
        self.p += 1
        if not self.eat("const"):
            self.type()

    def operand(self, op: str, level: int) -> None:
        if op == "?":
            self.expression(1)
            self.need(":")
            self.expression(1)
        else:
            super().operand(op, level)

    def unary(self) -> None:
        while self.eat_any("+ - ! ~ ++ -- typeof void delete await"):
            pass
        if self.eat("yield"):
            self.eat("*")
            if not self.at_any("; N ) ] } ,"):
                self.expression(1)
            return
        if self.s[self.p] in "(i" or self.at_any("async <"):
            if self.arrow():
                return
        self.primary()
        self.postfix()

    def arrow(self) -> bool:
        c = self.s[self.p]
        if c == "i":
            if self.ahead(1) == code("=>"):
                self.p += 2
                self.arrow_body()
                return True
            return False
        if c == code("async"):
            if self.ahead(1) == "i" and self.ahead(2) == code("=>"):
                self.p += 3
                self.arrow_body()
                return True
            if self.ahead(1) != "(":
                return False
        elif c == "<" and not self.typed:
            return False
        m = PARENS.match(self.s, self.p + (c == code("async")))
        if c == "(" and m is not None and self.s[m.end()] != code("=>") and not (self.typed and self.s[m.end()] == ":"):
            return False
        began = self.p
        try:
            self.eat("async")
            if self.at("<"):
                self.type_parameters()
            self.parameters()
            if self.typed and self.eat(":"):
                self.return_type()
            self.need("=>")
        except Fail:
            self.p = began
            return False
        self.arrow_body()
        return True

    def arrow_body(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.expression(1)

    def primary(self) -> None:
        c = self.s[self.p]
        if c in "ins" or self.at_any("this super null true false"):
            self.p += 1
        elif c == "(":
            self.p += 1
            self.expression()
            while self.eat(","):
                self.expression()
            self.need(")")
        elif c == "[":
            self.p += 1
            while not self.at("]"):
                while self.eat(","):
                    pass
                if self.at("]"):
                    break
                self.eat("...")
                self.expression(1)
                if not self.eat(","):
                    break
            self.need("]")
        elif c == "{":
            self.p += 1
            self.comma_list(self.property, "}")
        elif self.at("function") or self.at("async") and self.ahead(1) == code("function"):
            self.function(False)
        elif self.eat("async"):
            pass
        elif self.at("class"):
            self.class_(False)
        elif self.eat("new"):
            if self.eat("."):
                return self.name()
            self.eat("new")
            self.primary()
            while True:
                if self.eat("."):
                    self.member_name()
                elif self.at("["):
                    self.balanced()
                else:
                    break
            if self.typed and self.at("<"):
                self.attempt(self.type_arguments)
            if self.at("("):
                self.arguments()
        elif self.eat("import"):
            if self.eat("."):
                self.name()
            elif not self.at("("):
                raise Fail(f"expected '(', found {name_of(self.s[self.p])}")
        elif self.at("@"):
            self.decorators()
            self.class_(False)
        else:
            raise Fail(f"expected an expression, found {name_of(c)}")

    def member_name(self) -> None:
        if self.s[self.p] == "i" or self.s[self.p] in self.words:
            self.p += 1
        else:
            raise Fail(f"expected a name, found {name_of(self.s[self.p])}")

    def postfix(self) -> None:
        while True:
            c = self.s[self.p]
            if c == "(":
                self.arguments()
            elif c == ".":
                self.p += 1
                self.member_name()
            elif c == "[":
                self.p += 1
                self.expression()
                while self.eat(","):
                    self.expression()
                self.need("]")
            elif self.eat("?."):
                if self.at("("):
                    self.arguments()
                elif not self.at("["):
                    self.member_name()
            elif c == "s" and self.s[self.p - 1] in "i)]":
                if not self.template_next:
                    return
                self.p += 1
            elif self.eat_any("++ --"):
                pass
            elif self.typed and c == "!" and self.ahead(1) not in "=i(":
                self.p += 1
            elif self.typed and c == "<" and self.attempt(self.generic_call):
                pass
            else:
                return

    template_next = True

    def generic_call(self) -> None:
        self.type_arguments()
        if not self.at("("):
            raise Fail("no call")

    def arguments(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.eat("...")
            self.expression(1)
            if not self.eat(","):
                break
        self.need(")")

    def property(self) -> None:
        if self.eat("..."):
            return self.expression(1)
        while self.at("*") or (self.at("async") or self.s[self.p] == "i") and (self.ahead(1) in "isn[*" or self.ahead(1) in self.words):
            self.p += 1
        self.property_name()
        if self.eat(":"):
            self.expression(1)
        elif self.at("(") or self.typed and self.at("<"):
            self.method_tail()
        elif self.eat("="):
            self.expression(1)

    def property_name(self) -> None:
        if self.eat("["):
            self.expression()
            self.need("]")
        elif self.s[self.p] in "isn" or self.s[self.p] in self.words:
            self.p += 1
        else:
            raise Fail(f"expected a name, found {name_of(self.s[self.p])}")

    # functions and classes
    def parameters(self) -> None:
        self.need("(")
        self.comma_list(self.parameter, ")")

    def parameter(self) -> None:
        self.decorators()
        while self.typed and (self.s[self.p] == "i" or self.at("keyof")) and (self.ahead(1) in "i{[" or self.ahead(1) == code("keyof")):
            self.p += 1
        self.eat("...")
        self.binding()
        if self.typed:
            self.eat("?")
            if self.eat(":"):
                self.type()
        if self.eat("="):
            self.expression(1)

    def binding(self) -> None:
        if self.at("{"):
            self.p += 1
            self.comma_list(self.binding_property, "}")
        elif self.eat("["):
            while not self.at("]"):
                while self.eat(","):
                    pass
                if self.at("]"):
                    break
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.expression(1)
                if not self.eat(","):
                    break
            self.need("]")
        elif not self.eat_any("this async await yield"):
            self.name()

    def binding_property(self) -> None:
        if self.eat("..."):
            return self.binding()
        self.property_name()
        if self.eat(":"):
            self.binding()
        if self.eat("="):
            self.expression(1)

    def function(self, named: bool) -> None:
        self.eat("async")
        self.need("function")
        self.eat("*")
        if self.s[self.p] == "i":
            self.p += 1
        elif named:
            self.name()
        self.method_tail()

    def method_tail(self) -> None:
        if self.typed and self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.typed and self.eat(":"):
            self.return_type()
        if self.typed and self.at_any("; N }") and not self.at("{"):
            return
        self.block()

    def decorators(self) -> None:
        while self.eat("@"):
            if self.at("("):
                self.balanced()
                continue
            self.name()
            while self.eat("."):
                self.member_name()
            if self.at("("):
                self.arguments()
            self.eat("N")

    def class_(self, named: bool) -> None:
        self.need("class")
        if self.s[self.p] == "i":
            self.p += 1
        elif named:
            self.name()
        if self.typed and self.at("<"):
            self.type_parameters()
        if self.eat("extends"):
            self.unary()
            if self.typed and self.at("<"):
                self.type_arguments()
        if self.typed and self.s[self.p] == "i":
            self.p += 1
            self.type()
            while self.eat(","):
                self.type()
        self.block("member")

    def member(self) -> None:
        if self.eat_any("; N"):
            return
        self.decorators()
        if self.s[self.p] == "i" and self.ahead(1) == "{":
            self.p += 1
            return self.block()
        while self.at("*") or (self.s[self.p] == "i" or self.at_any("async keyof")) and (self.ahead(1) in "isn[*{" or self.ahead(1) in self.words):
            self.p += 1
        if self.typed and self.at("[") and self.ahead(1) == "i" and self.ahead(2) == ":":
            self.balanced()
            self.need(":")
            self.type()
            return self.end()
        self.property_name()
        if self.typed:
            self.eat_any("? !")
        if self.at("(") or self.typed and self.at("<"):
            return self.method_tail()
        if self.typed and self.eat(":"):
            self.type()
        if self.eat("="):
            self.expression(1)
        self.end()

    # statements
    def end(self) -> None:
        if not self.eat_any("; N") and not self.at_any("} END"):
            raise Fail(f"expected ';', found {name_of(self.s[self.p])}")

    def sub(self) -> None:
        self.eat("N")
        if self.at_any("} END"):
            raise Fail(f"expected a statement, found {name_of(self.s[self.p])}")
        self.statement()

    def statement(self) -> None:
        c = self.s[self.p]
        if c == "{":
            self.block()
        elif self.eat_any("; N"):
            pass
        elif self.at_any("var let const"):
            self.p += 1
            if self.typed and self.at("enum"):
                return self.enum()
            self.variables()
            self.end()
        elif self.eat("if"):
            self.condition()
            self.sub()
            began = self.p
            self.eat_any("N")
            if self.eat("else"):
                self.sub()
            else:
                self.p = began
        elif self.eat("while"):
            self.condition()
            self.sub()
        elif self.eat("do"):
            self.sub()
            self.eat("N")
            self.need("while")
            self.condition()
            self.eat_any("; N")
        elif self.eat("for"):
            self.eat("await")
            self.for_head()
            self.sub()
        elif self.eat("switch"):
            self.condition()
            self.block("case_or_statement")
        elif self.eat("return"):
            if not self.at_any("; N } END"):
                self.expression()
                while self.eat(","):
                    self.expression()
            self.end()
        elif self.eat("throw"):
            self.expression()
            self.end()
        elif self.eat_any("break continue"):
            if self.s[self.p] == "i":
                self.p += 1
            self.end()
        elif self.eat("debugger"):
            self.end()
        elif self.eat("try"):
            self.block()
            plain = True
            if self.eat("catch"):
                plain = False
                if self.eat("("):
                    self.binding()
                    if self.typed and self.eat(":"):
                        self.type()
                    self.need(")")
                self.block()
            if self.eat("finally"):
                plain = False
                self.block()
            if plain:
                raise Fail(f"expected 'catch' or 'finally', found {name_of(self.s[self.p])}")
        elif self.at("function") or self.at("async") and self.ahead(1) == code("function"):
            self.function(True)
        elif self.at("class"):
            self.class_(True)
        elif self.at("@"):
            self.decorators()
            self.eat("N")
            self.statement()
        elif self.at("import") and self.ahead(1) not in "(.":
            self.import_()
        elif self.eat("export"):
            self.export()
        elif c == "i" and self.ahead(1) == ":":
            self.p += 2
        elif self.at_any("case default"):
            self.case_or_statement()
        elif self.typed and self.typed_statement():
            pass
        else:
            self.expression()
            while self.eat(","):
                self.expression()
            self.end()

    def typed_statement(self) -> bool:
        return False

    def variables(self) -> None:
        while True:
            self.binding()
            if self.typed:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.expression(1)
            if not self.eat(","):
                return

    def for_head(self) -> None:
        self.need("(")
        began = self.p
        if self.eat_any("var let const"):
            self.binding()
            if self.typed and self.eat(":"):
                self.type()
            if self.eat("in") or self.s[self.p] == "i":
                if self.s[self.p] == "i" and self.s[self.p - 1] != code("in"):
                    self.p += 1
                self.expression()
                return self.need(")")
            self.p = began + 1
            self.variables()
        elif not self.at(";"):
            self.expression(13)
            if self.eat("in") or self.s[self.p] == "i":
                if self.s[self.p] == "i" and self.s[self.p - 1] != code("in"):
                    self.p += 1
                self.expression()
                return self.need(")")
            self.p = began
            self.expression()
            while self.eat(","):
                self.expression()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
            while self.eat(","):
                self.expression()
        self.need(")")

    def case_or_statement(self) -> None:
        if self.eat("case"):
            self.expression()
            self.need(":")
        elif self.eat("default"):
            self.need(":")
        else:
            self.statement()

    def import_(self) -> None:
        self.need("import")
        if self.s[self.p] == "s":
            self.p += 1
            return self.end()
        if self.typed and self.s[self.p] == "i" and self.ahead(1) in "i{*" and self.ahead(2) != "s":
            self.p += 1
        if self.s[self.p] == "i":
            self.p += 1
            if self.typed and self.eat("="):
                self.expression()
                return self.end()
            self.eat(",")
        if self.at("{"):
            self.p += 1
            self.comma_list(self.specifier, "}")
        elif self.eat("*"):
            self.name()
            self.name()
        if self.s[self.p] != "i":
            raise Fail(f"expected 'from', found {name_of(self.s[self.p])}")
        self.p += 1
        self.source()

    def source(self) -> None:
        if self.s[self.p] != "s":
            raise Fail(f"expected a string, found {name_of(self.s[self.p])}")
        self.p += 1
        if self.s[self.p] == "i" and self.ahead(1) == "{":
            self.p += 1
            self.balanced()
        self.end()

    def specifier(self) -> None:
        for _ in range(4):
            if self.s[self.p] in "is" or self.s[self.p] in self.words:
                self.p += 1
            elif _ == 0:
                raise Fail(f"expected a name, found {name_of(self.s[self.p])}")

    def export(self) -> None:
        if self.eat("default"):
            if self.at("function") or self.at("async") and self.ahead(1) == code("function"):
                return self.function(False)
            if self.at("class"):
                return self.class_(False)
            if self.typed and (self.at("interface") or self.s[self.p] == "i" and (self.ahead(1) == "i" or self.ahead(1) == code("class"))):
                return self.statement()
            self.expression()
            return self.end()
        if self.at("{") or self.typed and self.s[self.p] == "i" and self.ahead(1) == "{":
            self.eat_any("i")
            self.p += 1
            self.comma_list(self.specifier, "}")
            if self.s[self.p] == "i" and self.ahead(1) == "s":
                self.p += 1
                return self.source()
            return self.end()
        if self.eat("*"):
            if self.s[self.p] == "i" and self.ahead(1) == "i":
                self.p += 2
            self.name()
            return self.source()
        if self.typed and self.eat("="):
            self.expression()
            return self.end()
        if not self.at_any("var let const function class async @ enum interface namespace") and not (self.typed and self.s[self.p] == "i"):
            raise Fail(f"expected a declaration, found {name_of(self.s[self.p])}")
        self.statement()

    def top(self) -> None:
        self.statement()


class TypeScript(Script):
    memo: dict = {}
    typed = True

    def type(self) -> None:
        self.eat_any("| &")
        while True:
            self.type_operand()
            if not self.eat_any("| &"):
                break
        if self.eat("extends"):
            self.type()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def return_type(self) -> None:
        self.type()  # also: asserts x is T
        if self.eat("is"):
            self.type()

    def type_operand(self) -> None:
        while self.eat_any("keyof typeof"):
            pass
        if self.at("(") or self.at("<") or self.at("new"):
            self.eat("new")
            if not self.attempt(self.function_type):
                self.need("(")
                self.type()
                self.need(")")
        elif self.at("{"):
            self.object_type()
        elif self.eat("["):
            while not self.at("]"):
                self.eat("...")
                if self.s[self.p] == "i" and self.ahead(1) in ":?":
                    self.p += 1
                    self.eat("?")
                    self.eat(":")
                self.type()
                self.eat("?")
                if not self.eat(","):
                    break
            self.need("]")
        elif self.eat("-"):
            self.need_number()
        elif self.s[self.p] in "sn" or self.at_any("this null true false void"):
            self.p += 1
        elif self.eat("import"):
            self.balanced()
            while self.eat("."):
                self.member_name()
        else:
            self.name()
            while self.eat("."):
                self.member_name()
            if self.at("<"):
                self.type_arguments()
        while self.at("["):
            self.p += 1
            if not self.at("]"):
                self.type()
            self.need("]")

    def need_number(self) -> None:
        if self.s[self.p] != "n":
            raise Fail("expected a number")
        self.p += 1

    def function_type(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        self.need("=>")
        self.return_type()

    def type_arguments(self) -> None:
        self.need("<")
        while not self.at(">"):
            self.type()
            if not self.eat(","):
                break
        self.need(">")

    def type_parameters(self) -> None:
        self.need("<")
        while not self.at(">"):
            self.eat("const")
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                break
        self.need(">")

    def object_type(self) -> None:
        self.need("{")
        while not self.at("}"):
            self.type_member()
            if not self.eat_any("; , N") and not self.at("}"):
                raise Fail(f"expected ';', found {name_of(self.s[self.p])}")
            while self.eat_any("; , N"):
                pass
        self.p += 1

    def type_member(self) -> None:
        self.eat_any("+ -")
        while (self.s[self.p] == "i" or self.at("keyof")) and (self.ahead(1) in "is[n" or self.ahead(1) in self.words):
            self.p += 1
        if self.eat("["):
            self.name()
            if self.eat(":") or self.eat("in"):
                self.type()
            while not self.at("]"):
                if self.at_any("END ; { }"):
                    raise Fail("expected ']'")
                self.p += 1
            self.need("]")
        elif self.eat("new") or self.at_any("( <"):
            pass
        else:
            self.property_name()
        self.eat_any("+ -")
        self.eat("?")
        if self.at_any("( <"):
            if self.at("<"):
                self.type_parameters()
            self.parameters()
            if self.eat(":"):
                self.return_type()
        elif self.eat(":"):
            self.type()

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.at("}"):
            self.property_name()
            if self.eat("="):
                self.expression(1)
            if not self.eat(","):
                break
        self.need("}")

    def typed_statement(self) -> bool:
        if self.at("enum"):
            self.enum()
        elif self.eat("interface"):
            self.name()
            if self.at("<"):
                self.type_parameters()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            self.object_type()
        elif self.eat("namespace"):
            if self.s[self.p] == "s":
                self.p += 1
            else:
                self.name()
                while self.eat("."):
                    self.member_name()
            if self.at("{"):
                self.block()
            else:
                self.end()
        else:
            return self.s[self.p] == "i" and self.attempt(self.declaration)
        return True

    def declaration(self) -> None:
        """``type``, ``declare``, ``abstract`` and ``global``: words that are names elsewhere."""
        if self.ahead(1) in codes("class function const let var enum async interface namespace"):
            self.p += 1
            if self.at_any("let var"):
                self.p += 1
                self.variables()
                return self.end()
            return self.statement()
        if self.ahead(1) != "i":
            raise Fail("no declaration")
        self.p += 1
        if self.s[self.p] == "i" and self.ahead(1) == "i":
            self.p += 1  # declare type x
        elif self.ahead(1) == "{":
            self.p += 1  # declare global
            return self.block()
        self.name()
        if self.at("<"):
            self.type_parameters()
        self.need("=")
        self.type()
        self.end()
