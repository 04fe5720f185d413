"""What the parsers share: the cursor, precedence climbing, panic mode and the memory of statement shapes."""

from __future__ import annotations

import re

from .lexer import END, code, name_of

MEMO_LIMIT = 200_000
LONGEST_SHAPE = 400

_IN = r"[^;N(){}\0]"
_P1 = rf"\((?:{_IN}|\{{{_IN}*+\}})*+\)"
_P2 = rf"\((?:{_IN}|\{{{_IN}*+\}}|{_P1})*+\)"
_P3 = rf"\((?:{_IN}|\{{{_IN}*+\}}|{_P2})*+\)"
_BR = rf"\{{(?:{_IN}|{_P2}|\{{{_IN}*+\}})*+\}}"
SIMPLE = re.compile(rf"(?:{_IN}|{_P3}|{_BR})*+[;N]")
PARENS = re.compile(_P3)


class Fail(Exception):
    """A syntax error at the cursor."""


class Parser:
    """A cursor over a kind string.  Languages derive from it and add statements."""

    binary: dict[str, int] = {}
    right: frozenset[str] = frozenset()
    prefix: frozenset[str] = frozenset()
    after_simple: frozenset[str] = frozenset()
    memo: dict[tuple[str, str], bool]

    def __init__(self, kinds: str, fast: bool = True):
        self.s, self.p, self.fast = kinds + END, 0, fast
        self.errors: list[tuple[int, str]] = []

    # cursor
    def at(self, token: str) -> bool:
        return self.s[self.p] == code(token)

    def at_any(self, tokens: str) -> bool:
        return self.s[self.p] in _codes(tokens)

    def ahead(self, n: int) -> str:
        return self.s[min(self.p + n, len(self.s) - 1)]

    def eat(self, token: str) -> bool:
        if self.s[self.p] == code(token):
            self.p += 1
            return True
        return False

    def eat_any(self, tokens: str) -> bool:
        if self.s[self.p] in _codes(tokens):
            self.p += 1
            return True
        return False

    def need(self, token: str) -> None:
        if self.s[self.p] != code(token):
            raise Fail(f"expected '{token}', found {name_of(self.s[self.p])}")
        self.p += 1

    def name(self) -> None:
        if self.s[self.p] != "i":
            raise Fail(f"expected a name, found {name_of(self.s[self.p])}")
        self.p += 1

    def attempt(self, rule) -> bool:
        """Run ``rule``; go back to where it began if it fails."""
        began = self.p
        try:
            rule()
            return True
        except Fail:
            self.p = began
            return False

    def balanced(self) -> None:
        """Skip one bracketed group, whatever is inside."""
        shut = {"(": ")", "[": "]", "{": "}"}
        stack = [shut[self.s[self.p]]] if self.s[self.p] in shut else []
        if not stack:
            raise Fail(f"expected a bracket, found {name_of(self.s[self.p])}")
        self.p += 1
        while stack:
            c = self.s[self.p]
            if c in shut:
                stack.append(shut[c])
            elif c in ")]}":
                if c != stack.pop():
                    raise Fail("brackets don't match")
            elif c == END or c == "X":
                raise Fail(f"expected '{stack[-1]}', found {name_of(c)}")
            self.p += 1

    def comma_list(self, rule, shut: str) -> None:
        """``rule`` separated by commas (one may trail) up to the bracket ``shut``, which is consumed."""
        while not self.at(shut):
            rule()
            if not self.eat(","):
                break
        self.need(shut)

    # expressions
    def expression(self, low: int = 0) -> None:
        self.unary()
        binary = self.binary
        while True:
            op = self.s[self.p]
            level = binary.get(op)
            if level is None or level < low:
                return
            self.p += 1
            self.operand(op, level)

    def operand(self, op: str, level: int) -> None:
        if op == "?":
            self.expression(1)
            self.need(":")
            self.expression(1)
        elif op == ">":
            while self.s[self.p] == ">" or self.at(">="):
                self.p += 1
            self.expression(level + 1)
        else:
            self.expression(level if op in self.right else level + 1)

    def unary(self) -> None:
        raise NotImplementedError

    # statements
    def statement(self) -> None:
        raise NotImplementedError

    def known_shape(self, rule: str, shape: re.Pattern) -> bool:
        """Skip what ``shape`` matches here if ``rule`` is known to accept such token kinds."""
        if not self.fast:
            return False
        m = shape.match(self.s, self.p)
        if m is None or m.end() - self.p > LONGEST_SHAPE or self.s[m.end()] in self.after_simple:
            return False
        key = (rule, m.group())
        good = self.memo.get(key)
        if good is None:
            if len(self.memo) >= MEMO_LIMIT:
                self.memo.clear()
            good = self.memo[key] = type(self)(key[1], False).accepts(rule)
        if good:
            self.p = m.end()
        return good

    def accepts(self, rule: str) -> bool:
        run = getattr(self, rule)
        try:
            while self.s[self.p] != END:
                run()
        except (Fail, RecursionError):
            return False
        return not self.errors

    def step(self, rule: str) -> None:
        """One statement, known or parsed; after an error, panic: go on behind the next end of a statement."""
        if self.known_shape(rule, SIMPLE):
            return
        began = self.p
        try:
            getattr(self, rule)()
            if self.p == began:
                raise Fail(f"unexpected {name_of(self.s[self.p])}")
        except Fail as e:
            if not self.fast:
                raise
            self.errors.append((self.p, str(e)))
            depth = 0
            self.p = max(self.p, began)
            while (c := self.s[self.p]) != END:
                if c in "({[":
                    depth += 1
                elif c in ")]" and depth:
                    depth -= 1
                elif c == "}":
                    if not depth:
                        if self.p == began:
                            self.p += 1
                        return
                    depth -= 1
                    if not depth:
                        self.p += 1
                        return
                elif c in ";N" and not depth:
                    self.p += 1
                    return
                self.p += 1

    def block(self, rule: str = "statement") -> None:
        self.need("{")
        while self.s[self.p] != "}":
            if self.s[self.p] == END:
                raise Fail("expected '}', found end of file")
            self.step(rule)
        self.p += 1

    def condition(self) -> None:
        """A parenthesised expression."""
        if not self.known_shape("condition_body", PARENS):
            self.condition_body()

    def condition_body(self) -> None:
        self.need("(")
        self.expression()
        while self.eat(","):
            self.expression()
        self.need(")")

    def file(self, rule: str = "statement") -> None:
        while self.s[self.p] != END:
            if self.s[self.p] == "}":
                self.errors.append((self.p, "unexpected '}'"))
                self.p += 1
                continue
            try:
                self.step(rule)
            except Fail as e:  # the end of the file came inside a block
                self.errors.append((self.p, str(e)))
                return


_SETS: dict[str, frozenset[str]] = {}


def _codes(tokens: str) -> frozenset[str]:
    out = _SETS.get(tokens)
    if out is None:
        out = _SETS[tokens] = frozenset(t if t in ("i", "n", "s", "N", "X") else END if t == "END" else code(t) for t in tokens.split())
    return out


def levels(*rows: str) -> dict[str, int]:
    """Operator kinds to precedence; the first row binds least."""
    return {code(t): k for k, row in enumerate(rows, 1) for t in row.split()}


codes = _codes
