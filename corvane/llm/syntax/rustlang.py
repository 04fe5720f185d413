"""Rust."""

from __future__ import annotations

from .base import Fail, Parser, codes, levels
from .lexer import code, name_of


class Rust(Parser):
    binary = levels("= += -= *= /= %= &= |= ^= <<=", ".. ..=", "||", "&&", "== != < > <= >=", "|", "^", "&", "<<", "+ -", "* / %")
    right = codes("= += -= *= /= %= &= |= ^= <<=")
    after_simple = codes("else")
    memo: dict = {}
    structs = True  # struct literals are not allowed in the heads of if, while, match and for
    block_like = codes("if match loop while for unsafe {")

    # types
    def type(self) -> None:
        while self.eat("&") or self.eat("&&"):
            self.eat("'a")
            self.eat("mut")
        if self.eat("*"):
            if not self.eat_any("const mut"):
                raise Fail(f"expected 'const' or 'mut', found {name_of(self.s[self.p])}")
            self.type()
        elif self.eat("["):
            self.type()
            if self.eat(";"):
                self.free(self.expression)
            self.need("]")
        elif self.eat("("):
            self.comma_list(self.type, ")")
        elif self.eat_any("! _"):
            pass
        elif self.eat_any("impl dyn"):
            self.bounds()
        elif self.at_any("fn unsafe extern for"):
            if self.eat("for"):
                self.generics()
                if not self.at_any("fn unsafe extern"):
                    return self.type()
            self.eat("unsafe")
            if self.eat("extern") and self.s[self.p] == "s":
                self.p += 1
            self.need("fn")
            self.need("(")
            self.comma_list(self.fn_type_argument, ")")
            if self.eat("->"):
                self.type()
        elif self.at("<"):
            self.qualified_self()
        else:
            self.type_path()

    def fn_type_argument(self) -> None:
        if self.s[self.p] in codes("i _") and self.ahead(1) == ":":
            self.p += 2
        self.type()

    def qualified_self(self) -> None:
        self.need("<")
        self.type()
        if self.eat("as"):
            self.type()
        self.need(">")
        while self.eat("::"):
            self.segment()

    def segment(self) -> None:
        if not self.eat_any("i self Self super crate"):
            raise Fail(f"expected a name, found {name_of(self.s[self.p])}")

    def type_path(self) -> None:
        self.eat("::")
        while True:
            self.segment()
            if self.at("::") and self.ahead(1) == "<":
                self.p += 1
            if self.at("<"):
                self.generic_arguments()
            elif self.at("(") :
                self.p += 1
                self.comma_list(self.type, ")")
                if self.eat("->"):
                    self.type()
            if not self.eat("::"):
                break
        if self.at("!"):
            self.p += 1
            self.balanced()

    def generic_arguments(self) -> None:
        self.need("<")
        while not self.at(">"):
            if self.eat("'a"):
                pass
            elif self.s[self.p] in "ns" or self.at("{"):
                self.unary()
            else:
                self.type()
                if self.eat("="):
                    self.type()
                elif self.eat(":"):
                    self.bounds()
            if not self.eat(","):
                break
        self.need(">")

    def bounds(self) -> None:
        while True:
            self.eat("?")
            if not self.eat("'a"):
                if self.at("("):
                    self.p += 1
                    self.bounds()
                    self.need(")")
                else:
                    self.type()
            if not self.eat("+"):
                return

    def generics(self) -> None:
        self.need("<")
        while not self.at(">"):
            self.attributes()
            if self.eat("'a"):
                pass
            else:
                self.eat("const")
                self.name()
            if self.eat(":"):
                self.bounds()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                break
        self.need(">")

    def where(self) -> None:
        if self.eat("where"):
            while not self.at_any("{ ; ="):
                if not self.eat("'a"):
                    self.type()
                self.need(":")
                self.bounds()
                if not self.eat(","):
                    break

    # patterns
    def pattern(self) -> None:
        self.eat("|")
        while True:
            self.pattern_one()
            if not self.eat("|"):
                return

    def pattern_one(self) -> None:
        if self.eat("&") or self.eat("&&"):
            self.eat("mut")
            return self.pattern_one()
        if self.eat_any("_ .."):
            return
        if self.at_any("ref mut"):
            self.eat("ref")
            self.eat("mut")
            self.name()
            if self.eat("@"):
                self.pattern_one()
            return
        if self.eat("("):
            return self.comma_list(self.pattern, ")")
        if self.eat("["):
            return self.comma_list(self.pattern, "]")
        if self.at_any("n s - true false"):
            self.eat("-")
            self.p += 1
        else:
            if self.s[self.p] == "i" and self.eat("i") and self.eat("@"):
                return self.pattern_one()
            if self.s[self.p - 1] == "i" and self.at("!"):
                self.p += 1
                return self.balanced()
            if self.s[self.p - 1] != "i" or self.at_any("::"):
                if self.s[self.p - 1] == "i" and self.at("::"):
                    self.p += 1
                self.expression_path()
            if self.eat("("):
                self.comma_list(self.pattern, ")")
            elif self.at("{"):
                self.p += 1
                self.comma_list(self.field_pattern, "}")
        if self.eat_any("..= .."):
            if self.at_any("n s - i"):
                self.eat("-")
                self.p += 1

    def field_pattern(self) -> None:
        self.attributes()
        if self.eat(".."):
            return
        if self.s[self.p] in "in" and self.ahead(1) == ":":
            self.p += 2
            return self.pattern()
        self.pattern_one()

    def expression_path(self) -> None:
        if self.at("<"):
            return self.qualified_self()
        self.eat("::")
        while True:
            self.segment()
            if self.at("::") and self.ahead(1) == "<":
                self.p += 1
                self.generic_arguments()
            if not self.eat("::"):
                return

    # expressions
    def free(self, rule) -> None:
        before, self.structs = self.structs, True
        try:
            rule()
        finally:
            self.structs = before

    def head(self) -> None:
        before, self.structs = self.structs, False
        try:
            self.expression()
        finally:
            self.structs = before

    def operand(self, op: str, level: int) -> None:
        if op in codes(".. ..="):
            if not self.at_any(") ] } ; , =>") and not (self.at("{") and not self.structs):
                self.expression(level + 1)
        else:
            super().operand(op, level)

    def unary(self) -> None:
        while True:
            if self.eat_any("- ! *"):
                pass
            elif self.eat("&") or self.eat("&&"):
                self.eat("mut")
            else:
                break
        if self.at_any(".. ..="):
            self.p += 1
            if not self.at_any(") ] } ; ,"):
                self.expression(3)
            return
        self.primary()
        self.postfix()

    def postfix(self) -> None:
        while True:
            c = self.s[self.p]
            if c == "(":
                self.p += 1
                self.free(lambda: self.comma_list(self.expression, ")"))
            elif c == "[":
                self.p += 1
                self.free(self.expression)
                self.need("]")
            elif c == ".":
                self.p += 1
                if self.eat("await") or self.s[self.p] == "n":
                    if self.s[self.p] == "n":
                        self.p += 1
                    continue
                self.name()
                if self.at("::"):
                    self.p += 1
                    self.generic_arguments()
            elif c == "?":
                self.p += 1
            elif self.eat("as"):
                self.type()
            else:
                return

    def primary(self) -> None:
        self.attributes()
        c = self.s[self.p]
        if c in "ns" or self.at_any("true false"):
            self.p += 1
        elif c == "i" or self.at_any("self Self super crate :: <"):
            self.expression_path()
            if self.at("!") and self.ahead(1) in "([{":
                self.p += 1
                self.balanced()
            elif self.at("{") and self.structs and self.struct_ahead():
                self.p += 1
                self.free(lambda: self.comma_list(self.struct_field, "}"))
        elif c == "(":
            self.p += 1
            self.free(lambda: self.comma_list(self.expression, ")"))
        elif c == "[":
            self.p += 1
            self.free(self.array)
        elif c == "{":
            self.body()
        elif self.eat("unsafe") or self.at("async") and self.ahead(1) == "{" and self.eat("async"):
            self.body()
        elif self.at_any("move | || async"):
            self.closure()
        elif self.eat("if"):
            self.if_()
        elif self.eat("match"):
            self.head()
            self.need("{")
            self.free(self.arms)
        elif self.eat("loop"):
            self.body()
        elif self.eat("while"):
            self.if_head()
            self.body()
        elif self.eat("for"):
            self.pattern()
            self.need("in")
            self.head()
            self.body()
        elif self.eat("'a"):
            if self.eat(":"):
                self.primary()
        elif self.eat_any("return break"):
            self.eat("'a")
            if not self.at_any("; } ) , ] =>"):
                self.expression()
        elif self.eat("continue"):
            self.eat("'a")
        elif self.eat("let"):
            self.pattern()
            self.need("=")
            self.expression(5)
        elif self.eat("_"):
            pass
        else:
            raise Fail(f"expected an expression, found {name_of(c)}")

    def struct_ahead(self) -> bool:
        a, b = self.ahead(1), self.ahead(2)
        return a == "}" or a in "in" and b in ":,}" or a == code("..") or a == "#"

    def struct_field(self) -> None:
        self.attributes()
        if self.eat(".."):
            return self.expression()
        if not self.eat_any("i n"):
            raise Fail(f"expected a name, found {name_of(self.s[self.p])}")
        if self.eat(":"):
            self.expression()

    def array(self) -> None:
        if self.eat("]"):
            return
        self.expression()
        if self.eat(";"):
            self.expression()
            return self.need("]")
        if self.eat(","):
            return self.comma_list(self.expression, "]")
        self.need("]")

    def closure(self) -> None:
        self.eat("async")
        self.eat("move")
        if not self.eat("||"):
            self.need("|")
            while not self.at("|"):
                self.pattern_one()
                if self.eat(":"):
                    self.type()
                if not self.eat(","):
                    break
            self.need("|")
        if self.eat("->"):
            self.type()
            return self.body()
        self.expression()

    def if_(self) -> None:
        self.if_head()
        self.body()
        if self.eat("else"):
            if self.eat("if"):
                self.if_()
            else:
                self.body()

    def if_head(self) -> None:
        if self.at("{"):
            raise Fail("expected a condition, found '{'")
        self.head()

    def arms(self) -> None:
        while not self.at("}"):
            self.attributes()
            self.pattern()
            if self.eat("if"):
                self.expression()
            self.need("=>")
            braces = self.at("{")
            self.expression()
            if not self.eat(",") and not self.at("}") and not (braces and self.s[self.p - 1] == "}"):
                raise Fail(f"expected ',', found {name_of(self.s[self.p])}")
        self.need("}")

    def body(self) -> None:
        self.free(self.block)

    # items and statements
    def attributes(self) -> None:
        while self.at("#") and (self.ahead(1) == "[" or self.ahead(1) == "!" and self.ahead(2) == "["):
            self.p += 1
            self.eat("!")
            self.balanced()

    def statement(self) -> None:
        if self.eat(";"):
            return
        self.attributes()
        if self.eat("let"):
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expression()
                if self.eat("else"):
                    self.body()
            self.need(";")
            return
        if self.item_ahead():
            return self.item()
        if self.s[self.p] in self.block_like or self.s[self.p] == code("'a"):
            self.primary()
            if self.at_any(". ?"):
                self.postfix()
                self.rest()
            self.eat(";")
            return
        self.expression()
        self.rest()

    def rest(self) -> None:
        if not self.eat(";") and not self.at("}") and not (self.s[self.p - 1] == "}" and self.fast):
            raise Fail(f"expected ';', found {name_of(self.s[self.p])}")

    def item_ahead(self) -> bool:
        c = self.s[self.p]
        if c in codes("fn struct enum impl trait mod use const static type extern pub"):
            return True
        if c == code("unsafe"):
            return self.ahead(1) in codes("fn impl trait extern")
        if c == code("async"):
            return self.ahead(1) in codes("fn unsafe") 
        return c == "i" and self.ahead(1) == "!" and self.ahead(2) == "i"

    def item(self) -> None:
        self.attributes()
        if self.eat("pub") and self.at("("):
            self.balanced()
        while self.at_any("unsafe async const extern") and (self.ahead(1) in codes("fn unsafe async extern impl trait") or self.at("extern") and self.ahead(1) == "s" and self.ahead(2) == code("fn")):
            self.p += 1
            if self.s[self.p] == "s":
                self.p += 1
        if self.eat("fn"):
            self.name()
            if self.at("<"):
                self.generics()
            self.need("(")
            self.comma_list(self.parameter, ")")
            if self.eat("->"):
                self.type()
            self.where()
            if not self.eat(";"):
                self.body()
        elif self.eat("struct"):
            self.name()
            if self.at("<"):
                self.generics()
            self.where()
            if self.eat("("):
                self.comma_list(self.tuple_field, ")")
                self.where()
                self.need(";")
            elif not self.eat(";"):
                self.need("{")
                self.comma_list(self.field, "}")
        elif self.eat("enum"):
            self.name()
            if self.at("<"):
                self.generics()
            self.where()
            self.need("{")
            self.comma_list(self.variant, "}")
        elif self.eat("impl"):
            if self.at("<"):
                self.generics()
            self.eat("!")
            self.type()
            if self.eat("for"):
                self.type()
            self.where()
            self.block("member")
        elif self.eat("trait"):
            self.name()
            if self.at("<"):
                self.generics()
            if self.eat(":"):
                if not self.at_any("{ where"):
                    self.bounds()
            self.where()
            self.block("member")
        elif self.eat("mod"):
            self.name()
            if not self.eat(";"):
                self.block("top")
        elif self.eat("use"):
            self.use_tree()
            self.need(";")
        elif self.eat_any("const static"):
            self.eat("mut")
            if not self.eat("_"):
                self.name()
            self.need(":")
            self.type()
            if self.eat("="):
                self.expression()
            self.need(";")
        elif self.eat("type"):
            self.name()
            if self.at("<"):
                self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.type()
            self.need(";")
        elif self.eat("extern"):
            if self.s[self.p] == "s":
                self.p += 1
            if self.eat("crate"):
                self.name()
                if self.eat("as"):
                    self.p += 1
                return self.need(";")
            self.block("member")
        elif self.s[self.p] == "i" and self.ahead(1) == "!":
            self.p += 2
            if self.s[self.p] == "i":
                self.p += 1
            braces = self.at("{")
            self.balanced()
            if not braces:
                self.need(";")
        elif self.s[self.p] == "i" and self.ahead(1) == "i":
            self.p += 2  # union U { .. }
            if self.at("<"):
                self.generics()
            self.need("{")
            self.comma_list(self.field, "}")
        else:
            raise Fail(f"expected an item, found {name_of(self.s[self.p])}")

    member = item

    def top(self) -> None:
        began = self.p
        self.attributes()
        if self.p > began and self.at_any("END }"):
            return
        self.item()

    def parameter(self) -> None:
        self.attributes()
        if self.at("&") or self.at("self") or self.at("mut") and self.ahead(1) == code("self"):
            if self.attempt(self.receiver):
                return
        if self.eat("..."):
            return
        self.pattern_one()
        self.need(":")
        self.type()

    def receiver(self) -> None:
        if self.eat("&"):
            self.eat("'a")
        self.eat("mut")
        self.need("self")
        if self.eat(":"):
            self.type()

    def field(self) -> None:
        self.attributes()
        if self.eat("pub") and self.at("("):
            self.balanced()
        self.name()
        self.need(":")
        self.type()

    def tuple_field(self) -> None:
        self.attributes()
        if self.eat("pub") and self.at("(") and self.ahead(1) in codes("crate super self in"):
            self.balanced()
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.name()
        if self.eat("("):
            self.comma_list(self.tuple_field, ")")
        elif self.eat("{"):
            self.comma_list(self.field, "}")
        if self.eat("="):
            self.expression()

    def use_tree(self) -> None:
        self.eat("::")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                return self.comma_list(self.use_tree, "}")
            self.segment()
            if not self.eat("::"):
                break
        if self.eat("as"):
            if not self.eat("_"):
                self.name()
