"""Go.  Line ends that end a statement have become ``N`` before parsing, by Go's own rule."""

from __future__ import annotations

import re

from .base import Fail, Parser, codes, levels
from .lexer import code, name_of

_ENDERS = "ins)]}" + "".join(code(t) for t in ("++", "--", "return", "break", "continue", "fallthrough"))
_KEEP = re.compile(f"(?<![{re.escape(_ENDERS)}])N")


def end_lines(kinds: str) -> str:
    """Line ends count after names, literals, closing brackets and a few words; the others become blanks."""
    return _KEEP.sub(" ", kinds)


class Go(Parser):
    binary = levels("||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^")
    memo: dict = {}
    literals = True  # composite literals are not allowed in the heads of if, for and switch

    def unary(self) -> None:
        while self.eat_any("+ - ! ^ * & <- ~"):
            pass
        self.primary()
        while True:
            c = self.s[self.p]
            if c == "(":
                self.p += 1
                self.bracketed(self.arguments_tail)
            elif c == "[":
                self.p += 1
                self.bracketed(self.index_tail)
            elif c == ".":
                self.p += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                else:
                    self.name()
            elif c == "{" and self.literals and self.s[self.p - 1] in "i]}":
                began = self.p
                if not self.attempt(self.composite):
                    self.p = began
                    return
            else:
                return

    def bracketed(self, rule) -> None:
        before, self.literals = self.literals, True
        try:
            rule()
        finally:
            self.literals = before

    def arguments_tail(self) -> None:
        while not self.at(")"):
            self.expression()
            self.eat("...")
            if not self.eat(","):
                break
        self.eat("N")
        self.need(")")

    def index_tail(self) -> None:
        while not self.at("]"):
            if not self.eat(":"):
                self.expression()
                self.eat(",")
        self.need("]")

    def primary(self) -> None:
        c = self.s[self.p]
        if c in "ins":
            self.p += 1
        elif c == "(":
            self.p += 1
            self.bracketed(self.expression)
            self.need(")")
        elif self.eat("func"):
            self.signature()
            if self.at("{"):
                self.bracketed(self.block)
        elif self.at_any("[ map struct chan interface"):
            self.type()
            if self.at("{"):
                self.composite()
        else:
            raise Fail(f"expected an expression, found {name_of(c)}")

    def composite(self) -> None:
        self.need("{")
        self.bracketed(self.elements)

    def elements(self) -> None:
        while not self.at("}"):
            self.element()
            if self.eat(":"):
                self.element()
            if not self.eat(","):
                break
        if self.at("N"):
            raise Fail("expected ',', found end of line")
        self.need("}")

    def element(self) -> None:
        self.composite() if self.at("{") else self.expression()

    # types
    def type(self) -> None:
        while self.eat_any("* <- ~"):
            pass
        if self.eat("["):
            if not self.at("]"):
                if not self.eat("..."):
                    self.expression()
            self.need("]")
            self.type()
        elif self.eat("map"):
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif self.eat("chan"):
            self.eat("<-")
            self.type()
        elif self.eat("func"):
            self.signature()
        elif self.eat("struct"):
            self.need("{")
            while not self.at("}"):
                self.field()
                if not self.eat_any("; N") and not self.at("}"):
                    raise Fail(f"expected end of line, found {name_of(self.s[self.p])}")
            self.p += 1
        elif self.eat("interface"):
            self.need("{")
            while not self.at("}"):
                if self.s[self.p] == "i" and self.ahead(1) == "(":
                    self.p += 1
                    self.signature()
                else:
                    self.type()
                    while self.eat("|"):
                        self.type()
                if not self.eat_any("; N") and not self.at("}"):
                    raise Fail(f"expected end of line, found {name_of(self.s[self.p])}")
            self.p += 1
        elif self.eat("("):
            self.type()
            self.need(")")
        else:
            self.name()
            if self.eat("."):
                self.name()
            if self.at("[") and self.ahead(1) not in "]n":
                began = self.p
                if not self.attempt(self.type_list):
                    self.p = began

    def type_list(self) -> None:
        self.need("[")
        while True:
            self.type()
            if not self.eat(","):
                break
        self.need("]")

    def field(self) -> None:
        if self.eat("*") or self.s[self.p] == "i" and self.ahead(1) in "sN};.":
            self.name()
            if self.eat("."):
                self.name()
        else:
            self.name()
            while self.eat(","):
                self.name()
            self.type()
        if self.s[self.p] == "s":
            self.p += 1

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.at_any("i * [ map chan func struct interface <-"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        while not self.at(")"):
            if self.s[self.p] == "i" and self.ahead(1) not in ",).[" or self.s[self.p] == "i" and self.ahead(1) == "[" and self.ahead(2) in "]n":
                self.p += 1
            self.eat("...")
            if not self.attempt(self.type):
                self.name()
                self.eat("...")
                self.type()
            if not self.eat(","):
                break
        self.eat("N")
        self.need(")")

    # statements
    def end(self) -> None:
        if not self.eat_any("; N") and not self.at_any("} END )"):
            raise Fail(f"expected end of line, found {name_of(self.s[self.p])}")

    def simple(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()
        if self.eat_any("++ --"):
            return
        if self.eat("<-"):
            return self.expression()
        if self.eat_any(":= = += -= *= /= %= &= |= ^= <<= >>= &^="):
            if self.eat("range"):
                return self.expression()
            self.expression()
            while self.eat(","):
                self.expression()

    def head(self) -> None:
        before, self.literals = self.literals, False
        try:
            if not self.at_any("{ ;"):
                if self.eat("range"):
                    self.expression()
                elif self.eat("var"):
                    self.variable()
                else:
                    self.simple()
            while self.eat(";"):
                if not self.at_any("{ ;"):
                    self.simple()
        finally:
            self.literals = before

    def body(self) -> None:
        before, self.literals = self.literals, True
        try:
            self.block()
        finally:
            self.literals = before

    def statement(self) -> None:
        c = self.s[self.p]
        if c == "{":
            self.body()
        elif self.eat_any("; N"):
            pass
        elif self.eat("if"):
            if self.at("{"):
                raise Fail("expected a condition, found '{'")
            self.head()
            self.body()
            if self.eat("else"):
                if self.at("if"):
                    return self.statement()
                self.body()
            self.end()
        elif self.eat("for"):
            self.head()
            self.body()
            self.end()
        elif self.eat_any("switch select"):
            self.head()
            self.block("case_or_statement")
            self.end()
        elif self.eat("return"):
            if not self.at_any("; N }"):
                self.expression()
                while self.eat(","):
                    self.expression()
            self.end()
        elif self.eat_any("go defer"):
            self.expression()
            self.end()
        elif self.eat_any("break continue goto fallthrough"):
            if self.s[self.p] == "i":
                self.p += 1
            self.end()
        elif self.at_any("var const type"):
            self.declaration()
        elif self.at_any("case default"):
            self.case_or_statement()
        elif c == "i" and self.ahead(1) == ":":
            self.p += 2
            self.eat("N")
        else:
            self.simple()
            self.end()

    def case_or_statement(self) -> None:
        if self.eat("case"):
            while True:
                if not self.attempt(self.case_simple):
                    self.type()
                if not self.eat(","):
                    break
            self.need(":")
        elif self.eat("default"):
            self.need(":")
        else:
            self.statement()

    def case_simple(self) -> None:
        self.simple()
        if not self.at_any(": ,"):
            raise Fail("no expression")

    def declaration(self) -> None:
        kind = self.s[self.p]
        self.p += 1
        one = self.type_spec if kind == code("type") else self.variable
        if self.eat("("):
            while not self.at(")"):
                if self.at("END"):
                    raise Fail("expected ')', found end of file")
                one()
                if not self.eat_any("; N") and not self.at(")"):
                    raise Fail(f"expected end of line, found {name_of(self.s[self.p])}")
            self.p += 1
        else:
            one()
        self.end()

    def variable(self) -> None:
        self.name()
        while self.eat(","):
            self.name()
        if not self.at_any("= ; N )"):
            self.type()
        if self.eat("="):
            self.expression()
            while self.eat(","):
                self.expression()

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self.ahead(1) == "i" and self.ahead(2) in "i,*[" + code("interface"):
            self.type_parameters()
        self.eat("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.at("]"):
            self.name()
            while self.eat(","):
                self.name()
            self.type()
            while self.eat("|"):
                self.type()
            if not self.eat(","):
                break
        self.need("]")

    def top(self) -> None:
        if self.eat_any("; N"):
            return
        if self.eat("package"):
            self.name()
            self.end()
        elif self.eat("import"):
            if self.eat("("):
                while not self.at(")"):
                    self.import_spec()
                    if not self.eat_any("; N") and not self.at(")"):
                        raise Fail(f"expected end of line, found {name_of(self.s[self.p])}")
                self.p += 1
            else:
                self.import_spec()
            self.end()
        elif self.eat("func"):
            if self.at("("):
                self.parameters()
            self.name()
            if self.at("["):
                self.type_parameters()
            self.signature()
            if self.at("{"):
                self.block()
            self.end()
        elif self.at_any("var const type"):
            self.declaration()
        else:
            raise Fail(f"expected a declaration, found {name_of(self.s[self.p])}")

    def import_spec(self) -> None:
        self.eat(".")
        if self.s[self.p] == "i":
            self.p += 1
        if self.s[self.p] != "s":
            raise Fail(f"expected a string, found {name_of(self.s[self.p])}")
        self.p += 1
