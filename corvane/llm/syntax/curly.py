"""C, C++ and Java."""

from __future__ import annotations

import re

from .base import PARENS, Fail, Parser, codes, levels
from .lexer import code, name_of

_LEVELS = levels("= += -= *= /= %= &= |= ^= <<=", "?", "||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<<", "+ -", "* / %")


class C(Parser):
    binary = _LEVELS
    right = codes("= += -= *= /= %= &= |= ^= <<=")
    after_simple = codes("else while catch finally")
    memo: dict = {}
    specs = codes(
        "const volatile static extern register auto inline restrict signed unsigned void char short int long float double bool _Bool size_t typedef"
        " constexpr virtual explicit friend mutable typename"
    )
    base_types = codes("void char short int long float double bool _Bool size_t signed unsigned auto")
    prefixes = codes("+ - ! ~ * & && ++ --")
    cpp = False

    # expressions
    def unary(self) -> None:
        while True:
            if self.s[self.p] in self.prefixes:
                self.p += 1
            elif self.eat("sizeof"):
                if self.at("(") and self.attempt(self.cast):
                    if not self.starts_operand():
                        return
                    continue
            elif self.at("(") and self.attempt(self.cast_before_operand):
                if self.at("{"):
                    self.initializer()
                    break
            else:
                self.primary()
                break
        self.postfix()

    def starts_operand(self) -> bool:
        return self.s[self.p] in codes("i n s ( sizeof this new nullptr true false static_cast")

    def cast(self) -> None:
        self.need("(")
        self.type_name()
        self.need(")")

    def cast_before_operand(self) -> None:
        self.cast()
        if not (self.starts_operand() or self.at_any("! ~ {") or self.s[self.p - 2] in codes("* void char int long float double size_t unsigned") and self.at_any("& * - +")):
            raise Fail("no cast")

    def type_name(self) -> None:
        self.specifiers()
        while self.eat_any("* & && const volatile"):
            pass
        if self.at("(") and self.ahead(1) == "*":
            self.p += 2
            self.need(")")
            self.balanced()
        while self.at("["):
            self.balanced()

    def primary(self) -> None:
        c = self.s[self.p]
        if c == "s":
            while self.s[self.p] in "si" and (c == "s" or self.s[self.p] == "s"):
                if self.s[self.p] == "i" and self.ahead(1) != "s":
                    break
                self.p += 1
        elif c == "n":
            self.p += 1
        elif c == "i" or self.cpp and c in codes("::"):
            self.qualified(True)
        elif c == "(":
            self.p += 1
            if self.at("{"):
                self.block()
            else:
                self.expression()
                while self.eat(","):
                    self.expression()
            self.need(")")
        elif c == "{":
            self.initializer()
        else:
            self.special_primary()

    def special_primary(self) -> None:
        if self.s[self.p] in self.base_types:  # int(x), and macros that take types
            self.type_name()
            return
        if self.cpp:
            if self.eat_any("this nullptr"):
                return
            if self.eat_any("static_cast dynamic_cast const_cast reinterpret_cast"):
                self.need("<")
                self.type_name()
                self.need(">")
                self.condition_body()
                return
            if self.eat("new"):
                if self.at("("):
                    self.balanced()
                self.type_name()
                if self.at("("):
                    self.arguments()
                elif self.at("{"):
                    self.initializer()
                return
            if self.eat("delete"):
                if self.eat("["):
                    self.need("]")
                self.unary()
                return
            if self.eat("throw"):
                if not self.at_any("; ) ,"):
                    self.expression()
                return
            if self.at("["):
                self.balanced()
                if self.at("("):
                    self.parameters()
                while self.eat_any("mutable noexcept constexpr"):
                    pass
                if self.eat("->"):
                    self.type_name()
                self.block()
                return
            if self.eat("operator"):
                self.operator_name()
                return
        raise Fail(f"expected an expression, found {name_of(self.s[self.p])}")

    def operator_name(self) -> None:
        if self.at("("):
            self.p += 1
            self.need(")")
        elif self.at("["):
            self.p += 1
            self.need("]")
        elif self.s[self.p] == "i" or self.s[self.p] in self.specs:
            self.type_name()
        else:
            self.p += 1
            while self.at_any("> >= ="):
                self.p += 1

    def qualified(self, expr: bool) -> None:
        """A name, in C++ with scopes and template arguments."""
        if not self.cpp:
            self.name()
            return
        self.eat("::")
        while True:
            if self.eat("~"):
                pass
            if self.eat("operator"):
                self.operator_name()
                return
            self.eat("template")
            self.name()
            if self.at("<"):
                began = self.p
                ok = self.attempt(self.template_arguments)
                if ok and expr and not self.at_any(":: ( { ) , ; > ]"):
                    self.p = began
            if not self.eat("::"):
                return

    def template_arguments(self) -> None:
        self.need("<")
        while not self.at(">"):
            if not self.attempt(self.template_type):
                self.expression(9)
            self.eat("...")
            if not self.eat(","):
                break
        self.need(">")

    def template_type(self) -> None:
        self.type_name()
        if self.at("("):
            self.balanced()
        if not self.at_any("> , ..."):
            raise Fail("no type")

    def arguments(self) -> None:
        self.need("(")
        self.comma_list(self.argument, ")")

    def argument(self) -> None:
        if self.s[self.p] in self.base_types or self.at_any("struct const unsigned"):
            self.type_name()
            return
        self.expression()
        self.eat("...")

    def initializer(self) -> None:
        self.need("{")
        self.comma_list(self.initializer_item, "}")

    def initializer_item(self) -> None:
        while self.at_any(". ["):
            if self.eat("."):
                self.name()
            else:
                self.p += 1
                self.expression()
                self.need("]")
            if not self.at_any(". ["):
                self.need("=")
        self.expression()
        self.eat("...")

    def postfix(self) -> None:
        while True:
            c = self.s[self.p]
            if c == "(":
                self.arguments()
            elif c == "[":
                self.p += 1
                self.expression()
                self.need("]")
            elif c == ".":
                self.p += 1
                self.qualified(True)
            elif self.eat("->"):
                self.qualified(True)
            elif self.eat_any("++ --"):
                pass
            elif c == "{" and self.cpp and self.s[self.p - 1] in "i>" :
                began = self.p
                if not self.attempt(self.initializer):
                    self.p = began
                    return
            else:
                return

    # declarations
    def specifiers(self) -> None:
        typed = False
        while True:
            c = self.s[self.p]
            if c in self.specs:
                typed = typed or c in self.base_types
                self.p += 1
            elif self.at_any("struct union enum") or self.cpp and self.at("class"):
                self.aggregate()
                typed = True
            elif self.cpp and self.eat("decltype"):
                self.balanced()
                typed = True
            elif (c == "i" or self.cpp and self.at("::")) and not typed:
                self.qualified(False)
                typed = True
            elif c == "[" and self.ahead(1) == "[":
                self.balanced()
            else:
                break
        if not typed:
            raise Fail(f"expected a type, found {name_of(self.s[self.p])}")

    def aggregate(self) -> None:
        enum = self.at("enum")
        self.p += 1
        if enum:
            self.eat_any("class struct")
        if self.s[self.p] == "i":
            self.qualified(False)
            self.eat("final")
        if self.cpp and self.at(":") :
            self.p += 1
            while True:
                self.eat("virtual")
                self.eat_any("public private protected")
                self.eat("virtual")
                if self.s[self.p] in self.specs:
                    self.specifiers()
                else:
                    self.qualified(False)
                if not self.eat(","):
                    break
        if self.at("{"):
            if enum:
                self.p += 1
                self.comma_list(self.enumerator, "}")
            else:
                self.block("member")

    def enumerator(self) -> None:
        self.name()
        if self.eat("="):
            self.expression()

    def member(self) -> None:
        if self.cpp and self.eat_any("public private protected"):
            self.need(":")
            return
        if self.eat(";"):
            return
        self.declaration()

    def declarator(self) -> None:
        while self.eat_any("* & && const volatile restrict"):
            pass
        self.eat("...")
        if self.at("(") and self.ahead(1) in codes("* & ^ i"):
            self.p += 1
            self.declarator()
            self.need(")")
        elif self.s[self.p] == "i" or self.cpp and self.at_any("~ operator ::"):
            self.qualified(False)
        while self.at_any("[ ("):
            if self.at("["):
                self.p += 1
                if not self.at("]"):
                    self.expression()
                self.need("]")
            elif not self.attempt(self.parameters):
                if not self.cpp:
                    self.parameters()
                self.arguments()

    def parameters(self) -> None:
        self.need("(")
        self.comma_list(self.parameter, ")")

    def parameter(self) -> None:
        if self.eat("..."):
            return
        self.specifiers()
        self.declarator()
        if self.eat("="):
            self.expression(1)

    def declaration(self) -> None:
        """Anything that declares: up to ``;`` or a function's body."""
        if self.cpp:
            if self.eat("template"):
                self.need("<")
                depth = 1
                while depth:
                    if self.at("<"):
                        depth += 1
                    elif self.at(">"):
                        depth -= 1
                    elif self.at_any("END ; { }"):
                        raise Fail("expected '>'")
                    self.p += 1
                return self.declaration()
            if self.eat("using"):
                self.eat("namespace")
                self.qualified(False)
                if self.eat("="):
                    self.type_name()
                return self.need(";")
            if self.at("namespace") or self.at("inline") and self.ahead(1) in codes("namespace"):
                self.eat("inline")
                self.p += 1
                if self.s[self.p] == "i":
                    self.qualified(False)
                return self.block("declaration_or_macro")
            if self.at("extern") and self.ahead(1) == "s":
                self.p += 2
                if self.at("{"):
                    return self.block("declaration_or_macro")
        if self.cpp and self.at_any("~ operator") or self.cpp and self.constructor_ahead():
            while self.eat_any("explicit inline constexpr virtual"):
                pass
            self.qualified(False)
            self.parameters()
            return self.function_tail()
        if self.cpp and self.at_any("virtual explicit inline constexpr") and self.ahead(1) in codes("~"):
            self.p += 1
            return self.declaration()
        self.specifiers()
        if self.eat(";"):
            return
        first = True
        while True:
            began = self.p
            self.declarator()
            if self.p == began and not self.at(":"):
                raise Fail(f"expected a name, found {name_of(self.s[self.p])}")
            if first and self.s[self.p - 1] in ")" or self.at_any("override noexcept final"):
                if self.cpp and self.at_any("{ : -> const noexcept override final try & &&") or self.at("{"):
                    return self.function_tail()
            first = False
            if self.eat("="):
                if self.cpp and self.eat_any("default delete"):
                    pass
                elif self.at("{"):
                    self.initializer()
                else:
                    self.expression(1)
            elif self.cpp and self.at("{"):
                self.initializer()
            elif self.eat(":"):
                self.expression(1)
            if not self.eat(","):
                break
        self.need(";")

    def constructor_ahead(self) -> bool:
        k = self.p
        while self.s[k] in codes("explicit inline constexpr"):
            k += 1
        return self.s[k] == "i" and (self.s[k + 1] == "(" and self.s[k + 2] in codes(") i const int double float char bool long unsigned size_t auto std")
            and self.attempt_constructor(k))

    def attempt_constructor(self, k: int) -> bool:
        began, self.p = self.p, k + 1
        try:
            self.parameters()
            return self.at_any("{ : noexcept") or self.at(";") and self.s[k + 2] != ")" or self.at("=")
        except Fail:
            return False
        finally:
            self.p = began

    def function_tail(self) -> None:
        while self.eat_any("const noexcept override final volatile & &&"):
            if self.at("(") and self.s[self.p - 1] in codes("noexcept"):
                self.balanced()
        if self.eat("->"):
            self.type_name()
        if self.eat("try"):
            pass
        if self.eat(":"):
            while True:
                self.qualified(False)
                self.arguments() if self.at("(") else self.initializer()
                if not self.eat(","):
                    break
        if self.at("{"):
            self.block()
            while self.cpp and self.at("catch"):
                self.p += 1
                self.balanced()
                self.block()
            return
        if self.eat("="):
            if not self.eat_any("default delete"):
                if self.s[self.p] != "n":
                    raise Fail("expected 'default' or 'delete'")
                self.p += 1
        self.need(";")

    # statements
    def declaration_or_macro(self) -> None:
        if self.eat(";"):
            return
        self.declaration()

    top = declaration_or_macro

    def sub(self) -> None:
        if self.at("{"):
            self.block()
        elif self.s[self.p] == "}" or self.s[self.p] == "\0":
            raise Fail(f"expected a statement, found {name_of(self.s[self.p])}")
        else:
            self.statement()

    def statement(self) -> None:
        if self.at("{"):
            self.block()
        elif self.eat(";"):
            pass
        elif self.eat("if"):
            self.eat("constexpr")
            self.if_condition()
            self.sub()
            if self.eat("else"):
                self.sub()
        elif self.eat("while"):
            self.if_condition()
            self.sub()
        elif self.eat("for"):
            self.for_head()
            self.sub()
        elif self.eat("do"):
            self.sub()
            self.need("while")
            self.condition()
            self.need(";")
        elif self.eat("switch"):
            self.condition()
            self.block("case_or_statement")
        elif self.eat("return"):
            if not self.at(";"):
                self.expression()
                while self.eat(","):
                    self.expression()
            self.need(";")
        elif self.eat_any("break continue"):
            self.need(";")
        elif self.eat("goto"):
            self.name()
            self.need(";")
        elif self.at_any("case default"):
            self.case_or_statement()
        elif self.s[self.p] == "i" and self.ahead(1) == ":" :
            self.p += 2
        elif not self.special_statement():
            self.declaration_or_expression()

    def if_condition(self) -> None:
        if not self.known_shape("condition_body", PARENS):
            if not self.attempt(self.condition_body):
                self.need("(")
                self.specifiers()
                self.declarator()
                if self.eat("="):
                    self.expression()
                if self.eat(";"):
                    self.expression()
                self.need(")")

    def special_statement(self) -> bool:
        if self.cpp and self.eat("try"):
            self.block()
            if not self.at("catch"):
                raise Fail(f"expected 'catch', found {name_of(self.s[self.p])}")
            while self.eat("catch"):
                self.need("(")
                self.parameter()
                self.need(")")
                self.block()
            return True
        return False

    def for_head(self) -> None:
        self.need("(")
        if self.cpp and self.attempt(self.range_head):
            return
        if not self.eat(";"):
            self.declaration_or_expression()
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
            while self.eat(","):
                self.expression()
        self.need(")")

    def range_head(self) -> None:
        self.specifiers()
        while self.eat_any("& && * const"):
            pass
        if self.at("["):
            self.balanced()
        else:
            self.name()
        self.need(":")
        self.expression()
        self.need(")")

    def case_or_statement(self) -> None:
        if self.eat("case"):
            self.expression(3)
            if self.eat("..."):
                self.expression(3)
            self.need(":")
        elif self.eat("default"):
            self.need(":")
        else:
            self.statement()

    def declaration_or_expression(self) -> None:
        began = self.p
        try:
            self.declaration()
            return
        except Fail as e:
            far, reason = self.p, e
        self.p = began
        try:
            self.expression()
            while self.eat(","):
                self.expression()
            self.need(";")
        except Fail:
            if far > self.p:
                self.p = far
                raise reason from None
            raise


class Cpp(C):
    binary = levels("= += -= *= /= %= &= |= ^= <<=", "?", "||", "&&", "|", "^", "&", "== !=", "< > <= >= <=>", "<<", "+ -", "* / %", ".* ->*")
    memo: dict = {}
    cpp = True

    def special_primary(self) -> None:
        if self.at("typename"):
            self.p += 1
            self.qualified(True)
            return
        super().special_primary()


_RECORD = re.compile(f"{code('record')}(?!i[(<])")


def plain_names(kinds: str) -> str:
    """``record`` is a word of the language only before a name and its components."""
    return _RECORD.sub("i", kinds)


class Java(Parser):
    binary = levels("= += -= *= /= %= &= |= ^= <<=", "?", "||", "&&", "|", "^", "&", "== !=", "< > <= >= instanceof", "<<", "+ -", "* / %")
    right = codes("= += -= *= /= %= &= |= ^= <<=")
    after_simple = codes("else while catch finally")
    memo: dict = {}
    modifiers = codes("public private protected static final abstract synchronized native transient volatile strictfp default")

    def operand(self, op: str, level: int) -> None:
        if op in codes("instanceof"):
            self.eat("final")
            self.type()
            if self.s[self.p] == "i":
                self.p += 1
            elif self.at("("):
                self.balanced()
        else:
            super().operand(op, level)

    # types
    def annotations(self) -> None:
        while self.at("@") and self.ahead(1) == "i":
            self.p += 1
            self.name()
            while self.eat("."):
                self.name()
            if self.at("("):
                self.balanced()

    def type(self) -> None:
        self.annotations()
        self.name()
        self.type_arguments_if()
        while self.at(".") and self.ahead(1) == "i":
            self.p += 1
            self.name()
            self.type_arguments_if()
        while self.at("[") and self.ahead(1) == "]":
            self.p += 2

    def type_arguments_if(self) -> None:
        if self.eat("<"):
            while not self.at(">"):
                self.annotations()
                if self.eat("?"):
                    if self.eat_any("extends super"):
                        self.type()
                else:
                    self.type()
                    while self.eat("&"):
                        self.type()
                if not self.eat(","):
                    break
            self.need(">")

    def type_parameters_if(self) -> None:
        if self.eat("<"):
            while True:
                self.name()
                if self.eat("extends"):
                    self.type()
                    while self.eat("&"):
                        self.type()
                if not self.eat(","):
                    break
            self.need(">")

    # expressions
    def unary(self) -> None:
        while self.eat_any("+ - ! ~ ++ --"):
            pass
        if self.at("("):
            if self.attempt(self.lambda_):
                return
            if self.attempt(self.cast):
                return
        self.primary()
        while True:
            c = self.s[self.p]
            if c == "(":
                self.arguments()
            elif c == "[":
                self.p += 1
                if not self.eat("]"):
                    self.expression()
                    self.need("]")
            elif c == ".":
                self.p += 1
                self.type_arguments_if()
                if self.eat("new"):
                    self.creation()
                elif not self.eat_any("class this super"):
                    self.name()
            elif self.eat("::"):
                if not self.eat("new"):
                    self.name()
            elif not self.eat_any("++ --"):
                return

    def lambda_(self) -> None:
        self.need("(")
        if not self.at(")"):
            while True:
                self.eat("final")
                if self.s[self.p] == "i" and self.ahead(1) in ",)":
                    self.p += 1
                else:
                    self.type()
                    self.eat("...")
                    self.name()
                if not self.eat(","):
                    break
        self.need(")")
        self.need("->")
        self.lambda_body()

    def lambda_body(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.expression()

    def cast(self) -> None:
        self.need("(")
        self.type()
        while self.eat("&"):
            self.type()
        self.need(")")
        if not self.at_any("i n s ( ! ~ new this super true false null switch"):
            raise Fail("no cast")
        self.unary()

    def primary(self) -> None:
        c = self.s[self.p]
        if c == "i":
            self.p += 1
            if self.at("->"):
                self.p += 1
                self.lambda_body()
            elif self.at("<"):
                began = self.p
                if not self.attempt(self.type_arguments_if) or not self.at("::"):
                    self.p = began
        elif c in "ns" or self.at_any("this super true false null"):
            self.p += 1
        elif c == "(":
            self.p += 1
            self.expression()
            self.need(")")
        elif self.eat("new"):
            self.creation()
        elif self.eat("switch"):
            self.condition()
            self.block("case_or_statement")
        else:
            raise Fail(f"expected an expression, found {name_of(c)}")

    def creation(self) -> None:
        self.annotations()
        self.name()
        self.type_arguments_if()
        while self.eat("."):
            self.name()
            self.type_arguments_if()
        if self.at("["):
            while self.eat("["):
                if not self.at("]"):
                    self.expression()
                self.need("]")
            if self.at("{"):
                self.array()
        else:
            self.arguments()
            if self.at("{"):
                self.block("member")

    def array(self) -> None:
        self.need("{")
        self.comma_list(self.value, "}")

    def value(self) -> None:
        if self.at("{"):
            self.array()
        else:
            self.expression()

    def arguments(self) -> None:
        self.need("(")
        if not self.eat(")"):
            while True:
                self.expression()
                if not self.eat(","):
                    break
            self.need(")")

    # statements
    def sub(self) -> None:
        self.block() if self.at("{") else self.statement()

    def statement(self) -> None:
        if self.at("{"):
            self.block()
        elif self.eat(";"):
            pass
        elif self.eat("if"):
            self.condition()
            self.sub()
            if self.eat("else"):
                self.sub()
        elif self.eat("while"):
            self.condition()
            self.sub()
        elif self.eat("for"):
            self.need("(")
            if not self.attempt(self.each_head):
                if not self.eat(";"):
                    self.local_or_expression()
                if not self.at(";"):
                    self.expression()
                self.need(";")
                if not self.at(")"):
                    self.expression()
                    while self.eat(","):
                        self.expression()
                self.need(")")
            self.sub()
        elif self.eat("do"):
            self.sub()
            self.need("while")
            self.condition()
            self.need(";")
        elif self.at("switch"):
            self.expression()
            self.eat(";")
        elif self.eat("return"):
            if not self.at(";"):
                self.expression()
            self.need(";")
        elif self.eat("throw"):
            self.expression()
            self.need(";")
        elif self.eat("assert"):
            self.expression()
            if self.eat(":"):
                self.expression()
            self.need(";")
        elif self.eat_any("break continue"):
            if self.s[self.p] == "i":
                self.p += 1
            self.need(";")
        elif self.eat("try"):
            if self.eat("("):
                while not self.at(")"):
                    if not self.attempt(self.resource):
                        self.expression()
                    if not self.eat(";"):
                        break
                self.need(")")
                plain = False
            else:
                plain = True
            self.block()
            while self.eat("catch"):
                plain = False
                self.need("(")
                self.eat("final")
                self.type()
                while self.eat("|"):
                    self.type()
                self.name()
                self.need(")")
                self.block()
            if self.eat("finally"):
                plain = False
                self.block()
            if plain:
                raise Fail(f"expected 'catch' or 'finally', found {name_of(self.s[self.p])}")
        elif self.at("synchronized") and self.ahead(1) == "(":
            self.p += 1
            self.condition()
            self.block()
        elif self.s[self.p] == "i" and self.ahead(1) == ":":
            self.p += 2
        elif self.at_any("case default"):
            self.case_or_statement()
        elif self.at_any("class interface enum abstract static record") or self.at("final") and self.ahead(1) in codes("class"):
            self.member()
        else:
            self.local_or_expression()

    def resource(self) -> None:
        self.eat("final")
        self.type()
        self.name()
        self.need("=")
        self.expression()

    def each_head(self) -> None:
        self.eat("final")
        self.type()
        self.name()
        self.need(":")
        self.expression()
        self.need(")")

    def case_or_statement(self) -> None:
        if self.eat("default"):
            pass
        elif self.eat("case"):
            while True:
                if not self.eat("default"):
                    self.expression(3)
                    if self.s[self.p] == "i":
                        self.p += 1
                if not self.eat(","):
                    break
        else:
            return self.statement()
        if self.eat("->"):
            if self.at("{"):
                self.block()
            elif self.at("throw"):
                self.statement()
            else:
                self.expression()
                self.need(";")
        else:
            self.need(":")

    def local_or_expression(self) -> None:
        began = self.p
        try:
            self.local()
            return
        except Fail as e:
            far, reason = self.p, e
        self.p = began
        try:
            self.expression()
            while self.eat(","):
                self.expression()
            self.need(";")
        except Fail:
            if far > self.p:
                self.p = far
                raise reason from None
            raise

    def local(self) -> None:
        self.eat("final")
        self.annotations()
        self.type()
        self.variables()

    def variables(self) -> None:
        while True:
            self.name()
            while self.eat("["):
                self.need("]")
            if self.eat("="):
                self.value()
            if not self.eat(","):
                break
        self.need(";")

    # declarations
    def member(self) -> None:
        if self.eat(";"):
            return
        while True:
            self_at = self.p
            self.annotations()
            if self.s[self.p] in self.modifiers and not (self.at("default") and self.ahead(1) in ":-"):
                self.p += 1
            if self.p == self_at:
                break
        if self.at("{"):
            self.block()
        elif self.at_any("class interface enum") or self.at("@") and self.ahead(1) in codes("interface"):
            self.type_declaration()
        elif self.at("record"):
            self.record()
        else:
            self.type_parameters_if()
            if self.s[self.p] == "i" and self.ahead(1) == "(":
                self.p += 1
                self.method_tail()
            else:
                self.type()
                if self.s[self.p] == "i" and self.ahead(1) == "(":
                    self.p += 1
                    self.method_tail()
                else:
                    self.variables()

    def record(self) -> None:
        self.p += 2
        self.type_parameters_if()
        self.formals()
        if self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.block("member")

    def formals(self) -> None:
        self.need("(")
        if not self.eat(")"):
            while True:
                self.annotations()
                self.eat("final")
                self.type()
                self.eat("...")
                if not self.eat_any("this"):
                    self.name()
                while self.eat("["):
                    self.need("]")
                if not self.eat(","):
                    break
            self.need(")")

    def method_tail(self) -> None:
        self.formals()
        while self.eat("["):
            self.need("]")
        if self.eat("throws"):
            self.type()
            while self.eat(","):
                self.type()
        if self.eat("default"):
            self.value()
        if self.at("{"):
            self.block()
        else:
            self.need(";")

    def type_declaration(self) -> None:
        self.eat("@")
        enum = self.at("enum")
        self.p += 1
        self.name()
        self.type_parameters_if()
        while self.eat_any("extends implements") or self.s[self.p] == "i" and self.ahead(1) == "i":
            self.type()
            while self.eat(","):
                self.type()
        if enum:
            self.need("{")
            while not self.at_any("; }"):
                self.annotations()
                self.name()
                if self.at("("):
                    self.arguments()
                if self.at("{"):
                    self.block("member")
                if not self.eat(","):
                    break
            if self.eat(";"):
                while not self.at("}"):
                    if self.at("END"):
                        raise Fail("expected '}', found end of file")
                    self.step("member")
            self.need("}")
        else:
            self.block("member")

    def top(self) -> None:
        began = self.p
        self.annotations()
        if self.eat("package"):
            self.name()
            while self.eat("."):
                self.name()
            self.need(";")
        elif self.eat("import"):
            self.eat("static")
            self.name()
            while self.eat("."):
                if not self.eat("*"):
                    self.name()
            self.need(";")
        elif self.eat(";"):
            pass
        else:
            self.p = began
            self.member_of_file()

    def member_of_file(self) -> None:
        while True:
            began = self.p
            self.annotations()
            if self.s[self.p] in self.modifiers:
                self.p += 1
            if self.p == began:
                break
        if self.at("record"):
            self.record()
        elif self.s[self.p] == "i" and self.ahead(1) in codes("class interface"):
            self.p += 1
            self.type_declaration()
        elif self.at_any("class interface enum @"):
            self.type_declaration()
        else:
            raise Fail(f"expected a class, found {name_of(self.s[self.p])}")
