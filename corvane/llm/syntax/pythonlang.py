"""Python 3: logical lines are parsed (once per shape), then a stack of blocks checks how they nest."""

from __future__ import annotations

import re

from .base import MEMO_LIMIT, Fail, Parser, codes, levels
from .lexer import END, code, name_of

_LINE = re.compile("[^N]*N?")
_OPEN, _SHUT = "([{", ")]}"


class Line(Parser):
    """One logical line."""

    binary = levels("or", "and", "in not is < > <= >= == !=", "|", "^", "&", "<< >>", "+ -", "* / // % @")
    memo: dict = {}

    def name(self) -> None:
        if not self.eat_any("i match case type"):
            raise Fail(f"expected a name, found {name_of(self.s[self.p])}")

    # expressions
    def test(self) -> None:
        if self.eat("lambda"):
            while not self.at(":"):
                self.eat_any("* ** /")
                if self.s[self.p] in codes("i match case type"):
                    self.p += 1
                    if self.eat("="):
                        self.test()
                if not self.eat(","):
                    break
            self.need(":")
            return self.test()
        self.expression(1)
        if self.eat("if"):
            self.expression(1)
            self.need("else")
            self.test()

    def operand(self, op: str, level: int) -> None:
        if op == code("not"):
            self.need("in")
        elif op == code("is"):
            self.eat("not")
        self.expression(level + 1)

    def expression(self, low: int = 1) -> None:
        if low <= 2 and self.at("not") or low == 3 and self.at("not"):
            self.p += 1
            self.expression(3)
        else:
            self.unary()
        while True:
            op = self.s[self.p]
            level = self.binary.get(op)
            if level is None or level < low:
                return
            self.p += 1
            self.operand(op, level)

    def unary(self) -> None:
        while self.eat_any("+ - ~"):
            pass
        self.eat("await")
        self.atom()
        while True:
            c = self.s[self.p]
            if c == "(":
                self.p += 1
                while not self.at(")"):
                    if self.eat_any("* **"):
                        self.test()
                    else:
                        self.named()
                        if self.eat("="):
                            self.test()
                        elif self.at_any("for async"):
                            self.comprehension()
                    if not self.eat(","):
                        break
                self.need(")")
            elif c == "[":
                self.p += 1
                while True:
                    if not self.at_any(": ] ,"):
                        self.eat("*")
                        self.named()
                    while self.eat(":"):
                        if not self.at_any(": ] ,"):
                            self.test()
                    if not self.eat(",") or self.at("]"):
                        break
                if self.s[self.p - 1] == "[":
                    raise Fail("expected an index, found ']'")
                self.need("]")
            elif c == ".":
                self.p += 1
                self.name()
            elif c == code("**"):
                self.p += 1
                return self.unary()
            else:
                return

    def named(self) -> None:
        self.test()
        if self.at(":=") and self.s[self.p - 1] in codes("i match case type"):
            self.p += 1
            self.test()

    def star(self) -> None:
        if self.eat("*"):
            self.expression(4)
        else:
            self.named()

    def comprehension(self) -> None:
        while self.at_any("for async"):
            self.eat("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.expression(1)
            while self.eat("if"):
                self.expression(1)

    def targets(self) -> None:
        while True:
            self.eat("*")
            self.expression(4)
            if not self.eat(",") or self.at("in"):
                return

    def atom(self) -> None:
        c = self.s[self.p]
        if c == "s":
            while self.s[self.p] == "s":
                self.p += 1
        elif c == "n" or c in codes("i match case type True False None ..."):
            self.p += 1
        elif c == "(":
            self.p += 1
            if self.at("yield"):
                self.yield_()
            elif not self.at(")"):
                self.star()
                if self.at_any("for async"):
                    self.comprehension()
                else:
                    while self.eat(",") and not self.at(")"):
                        self.star()
            self.need(")")
        elif c == "[":
            self.p += 1
            if not self.at("]"):
                self.star()
                if self.at_any("for async"):
                    self.comprehension()
                else:
                    while self.eat(",") and not self.at("]"):
                        self.star()
            self.need("]")
        elif c == "{":
            self.p += 1
            while not self.at("}"):
                if self.eat("**"):
                    self.expression(4)
                else:
                    self.star()
                    if self.eat(":"):
                        self.test()
                    if self.at_any("for async"):
                        self.comprehension()
                        break
                if not self.eat(","):
                    break
            self.need("}")
        else:
            raise Fail(f"expected an expression, found {name_of(c)}")

    def yield_(self) -> None:
        self.need("yield")
        if self.eat("from"):
            self.test()
        elif not self.at_any(") ; = N END"):
            self.tests()

    def tests(self) -> None:
        while True:
            self.star()
            if not self.eat(",") or self.at_any("= ) ; : N END"):
                return

    # lines
    def line(self) -> str:
        """What the line is: ``.`` for a plain statement, else the word that opens a block; ``word+`` if its body is on the line."""
        word = ""
        self.eat("async") if self.ahead(1) in codes("def for with") else None
        if self.eat("@"):
            self.named()
            self.finish()
            return "@"
        if self.eat("def"):
            word = "def"
            self.name()
            if self.at("["):
                self.balanced()
            self.need("(")
            while not self.at(")"):
                if self.eat_any("* **"):
                    if self.at(","):
                        self.p += 1
                        continue
                elif self.eat("/"):
                    if not self.eat(","):
                        break
                    continue
                self.name()
                if self.eat(":"):
                    self.eat("*")
                    self.test()
                if self.eat("="):
                    self.test()
                if not self.eat(","):
                    break
            self.need(")")
            if self.eat("->"):
                self.tests()
        elif self.eat("class"):
            word = "class"
            self.name()
            if self.at("["):
                self.balanced()
            if self.at("("):
                self.p -= 1
                self.s = self.s[: self.p] + "i" + self.s[self.p + 1 :]
                self.unary()
        elif self.at_any("if elif while"):
            word = "if" if self.at("if") else "elif" if self.at("elif") else "while"
            self.p += 1
            self.named()
        elif self.eat("else"):
            word = "else"
        elif self.eat("try"):
            word = "try"
        elif self.eat("finally"):
            word = "finally"
        elif self.eat("except"):
            word = "except"
            self.eat("*")
            if not self.at(":"):
                self.tests()
                if self.eat("as"):
                    self.name()
        elif self.eat("for"):
            word = "for"
            self.targets()
            self.need("in")
            self.tests()
        elif self.eat("with"):
            word = "with"
            if not self.attempt(self.with_parens):
                while True:
                    self.test()
                    if self.eat("as"):
                        self.expression(4)
                    if not self.eat(","):
                        break
        elif self.at_any("match case"):
            began = self.p
            soft = "match" if self.at("match") else "case"
            if not self.attempt(self.simple_line):
                self.p = began + 1
                if soft == "match":
                    self.tests()
                else:
                    self.case_pattern()
                self.need(":")
                self.finish()
                return soft
            return "."
        if not word:
            self.simple_line()
            return "."
        self.need(":")
        if self.at_any("N END"):
            self.finish()
            return word
        self.simple_line()
        return word + "+"

    def case_pattern(self) -> None:
        depth = 0
        while not (self.at(":") and not depth):
            if self.at_any("END X"):
                raise Fail(f"expected ':', found {name_of(self.s[self.p])}")
            depth += (self.s[self.p] in _OPEN) - (self.s[self.p] in _SHUT)
            self.p += 1

    def with_parens(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.test()
            if self.eat("as"):
                self.expression(4)
            if not self.eat(","):
                break
        self.need(")")
        if not self.at(":"):
            raise Fail("no parentheses around items")

    def finish(self) -> None:
        self.eat("N")
        if self.s[self.p] != END:
            raise Fail(f"expected end of line, found {name_of(self.s[self.p])}")

    def simple_line(self) -> None:
        while True:
            self.small()
            if not self.eat(";") or self.at_any("N END"):
                break
        self.finish()

    def small(self) -> None:
        if self.eat_any("pass break continue"):
            return
        if self.eat("return"):
            if not self.at_any("; N END"):
                self.tests()
        elif self.eat("raise"):
            if not self.at_any("; N END"):
                self.test()
                if self.eat("from"):
                    self.test()
        elif self.eat_any("global nonlocal"):
            self.name()
            while self.eat(","):
                self.name()
        elif self.eat("del"):
            self.tests()
        elif self.eat("assert"):
            self.test()
            if self.eat(","):
                self.test()
        elif self.eat("import"):
            while True:
                self.dotted()
                if self.eat("as"):
                    self.name()
                if not self.eat(","):
                    break
        elif self.eat("from"):
            while self.eat_any(". ..."):
                pass
            if not self.at("import"):
                self.dotted()
            self.need("import")
            if self.eat("*"):
                return
            parens = self.eat("(")
            while True:
                self.name()
                if self.eat("as"):
                    self.name()
                if not self.eat(",") or self.at(")"):
                    break
            if parens:
                self.need(")")
        elif self.at("type") and self.ahead(1) == "i" and self.ahead(2) in "=[":
            self.p += 2
            if self.at("["):
                self.balanced()
            self.need("=")
            self.test()
        elif self.at("yield"):
            self.yield_()
        else:
            self.tests()
            if self.eat(":"):
                self.test()
                if self.eat("="):
                    self.value()
            elif self.eat_any("+= -= *= /= //= %= @= &= |= ^= >>= <<= **="):
                self.value()
            else:
                while self.eat("="):
                    self.value()

    def value(self) -> None:
        self.yield_() if self.at("yield") else self.tests()

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()


_NEXT = {
    "else": {"if", "elif", "for", "while", "except"}, "elif": {"if", "elif"}, "except": {"try", "except"}, "finally": {"try", "except", "else"},
}
_MEMO: dict[str, tuple[str, int, str]] = {}


def _shape(kinds: str) -> tuple[str, int, str]:
    """What a logical line is, and if it is wrong, where and why."""
    out = _MEMO.get(kinds)
    if out is None:
        run = Line(kinds, False)
        try:
            out = (run.line(), 0, "")
        except Fail as e:
            out = ("!", run.p, str(e))
        except RecursionError:
            out = (".", 0, "")
        if len(kinds) < 400:
            if len(_MEMO) >= MEMO_LIMIT:
                _MEMO.clear()
            _MEMO[kinds] = out
    return out


def _width(line_end: str) -> int:
    tail = line_end[line_end.rfind("\n") + 1 :]
    return len(tail.replace("\r", "").replace("\f", "").expandtabs(8)) if "#" not in tail else -1


def parse(tokens: list[str], kinds: str) -> list[tuple[int, str]]:
    """All syntax errors as (token position, message)."""
    errors: list[tuple[int, str]] = []
    # (indentation, whether clauses may follow and which, by the last statement)
    stack: list[list] = [[0, ""]]
    indent, opened, at, n = 0, False, 0, len(kinds)
    if kinds[:1] == "N":
        indent = max(0, _width(tokens[0]))
        at = 1
    while at < n:
        began = at
        end = kinds.find("N", at)
        end = n if end < 0 else end
        line = kinds[at:end]
        depth = line.count("(") + line.count("[") + line.count("{") - line.count(")") - line.count("]") - line.count("}")
        while depth > 0 and end < n:
            more = kinds.find("N", end + 1)
            more = n if more < 0 else more
            part = kinds[end + 1 : more]
            depth += part.count("(") + part.count("[") + part.count("{") - part.count(")") - part.count("]") - part.count("}")
            line += part
            end = more
        what, where, why = _shape(line)
        if what == "!":
            errors.append((_position(kinds, began, where), why))
            if depth > 0:  # a bracket stays open: take up again at the next line
                end = kinds.find("N", began)
                end = n if end < 0 else end
            what = "."
            for word in ("def", "class", "if", "elif", "else", "for", "while", "try", "except", "finally", "with"):
                if line.startswith(code(word)) or line.startswith(code("async") + code(word)):
                    what = word
                    break
        if opened:
            if indent > stack[-1][0]:
                stack.append([indent, ""])
            else:
                errors.append((began, "expected an indented block"))
        elif indent > stack[-1][0]:
            errors.append((began, "unexpected indent"))
            stack.append([indent, ""])
        while indent < stack[-1][0]:
            if stack[-1][1] in ("try", "try+"):
                errors.append((began, "expected 'except' or 'finally'"))
            if stack[-1][1] == "@":
                errors.append((began, "expected 'def' or 'class' after a decorator"))
            stack.pop()
            if not stack or indent > stack[-1][0]:
                errors.append((began, "the indentation matches no outer block"))
                stack.append([indent, ""])
        top = stack[-1]
        word = what.rstrip("+")
        before = top[1].rstrip("+")
        if word in _NEXT:
            if before not in _NEXT[word] or word == "finally" and before == "else" and not top[2:]:
                errors.append((began, f"'{word}' without its beginning"))
        elif before == "try":
            errors.append((began, "expected 'except' or 'finally'"))
        if before == "@" and word not in ("@", "def", "class"):
            errors.append((began, "expected 'def' or 'class' after a decorator"))
        del top[2:]
        if word == "except" or word == "else" and before == "except":
            top.append(True)
        top[1] = what
        opened = what not in (".", "@") and not what.endswith("+")
        if end >= n:
            break
        indent = _width(tokens[end])
        if indent < 0:
            indent = 0
        at = end + 1
    if opened:
        errors.append((n, "expected an indented block, found end of file"))
    elif any(s[1] in ("try", "try+") for s in stack):
        errors.append((n, "expected 'except' or 'finally', found end of file"))
    elif stack[-1][1] == "@":
        errors.append((n, "expected 'def' or 'class', found end of file"))
    return errors


def _position(kinds: str, began: int, where: int) -> int:
    """The token of the ``where``-th kind of a logical line, line ends inside it not counted."""
    at = began
    while at < len(kinds):
        if kinds[at] != "N":
            if where == 0:
                return at
            where -= 1
        elif where == 0:
            return at
        at += 1
    return at
