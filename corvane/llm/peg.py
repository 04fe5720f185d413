"""A small packrat parser: parsing-expression grammars written as text, memoised per rule and offset.

Notation: ``Rule <- A B / C``; ``*``, ``+``, ``?``, ``&``, ``!`` as usual; ``'text'`` a
literal; ``~re~`` a regular expression; parentheses group.  ``name:Rule`` captures the
source span of what ``Rule`` matched under ``name``.  Every rule at every offset is
tried once, so parsing is linear in the text; captures keep source offsets.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:(?P<rule>\w+)\s*<-|(?P<cap>\w+):|(?P<name>\w+)|'(?P<lit>(?:[^'\\]|\\.)*)'|~(?P<re>(?:[^~\\]|\\.)*)~|(?P<op>[*+?&!/()]))")

Span = tuple[str, int, int]


class Grammar:
    """A compiled grammar; :meth:`match` gives the end and the captures, or None."""

    def __init__(self, text: str):
        self.rules: dict[str, tuple] = {}
        tokens, at = [], 0
        text = re.sub(r"(?m)^\s*#.*$", "", text).strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"bad grammar at {text[at : at + 20]!r}")
            tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self._t, self._k = tokens, 0
        while self._k < len(tokens):
            kind, name = self._next()
            if kind != "rule":
                raise ValueError(f"expected a rule, found {name!r}")
            self.rules[name] = self._choice()
        self._ids = {name: k for k, name in enumerate(self.rules)}

    def _peek(self) -> tuple[str, str]:
        return self._t[self._k] if self._k < len(self._t) else ("end", "")

    def _next(self) -> tuple[str, str]:
        self._k += 1
        return self._t[self._k - 1]

    def _choice(self) -> tuple:
        options = [self._sequence()]
        while self._peek() == ("op", "/"):
            self._next()
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("choice", options)

    def _sequence(self) -> tuple:
        parts = []
        while self._peek()[0] in ("name", "lit", "re", "cap") or self._peek()[0] == "op" and self._peek()[1] in "&!(":
            parts.append(self._prefixed())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def _prefixed(self) -> tuple:
        kind, value = self._peek()
        if kind == "cap":
            self._next()
            return ("cap", value, self._prefixed())
        if kind == "op" and value in "&!":
            self._next()
            return ("ahead", value == "&", self._prefixed())
        kind, value = self._next()
        if kind == "op":
            out = self._choice()
            if self._next() != ("op", ")"):
                raise ValueError("expected ')'")
        elif kind == "lit":
            out = ("re", re.compile(re.escape(value.replace("\\'", "'"))))
        elif kind == "re":
            out = ("re", re.compile(value.replace("\\~", "~"), re.S))
        else:
            out = ("rule", value)
        while self._peek()[0] == "op" and self._peek()[1] in "*+?":
            out = ("repeat", self._next()[1], out)
        return out

    def match(self, text: str, rule: str, at: int = 0) -> tuple[int, list[Span]] | None:
        return _Run(self, text).apply(("rule", rule), at)


class _Run:
    def __init__(self, grammar: Grammar, text: str):
        self.rules, self.text = grammar.rules, text
        self.memo: dict[tuple[str, int], tuple[int, list[Span]] | None] = {}

    def apply(self, e: tuple, at: int) -> tuple[int, list[Span]] | None:
        kind = e[0]
        if kind == "re":
            m = e[1].match(self.text, at)
            return None if m is None else (m.end(), [])
        if kind == "rule":
            key = (e[1], at)
            if key in self.memo:
                return self.memo[key]
            self.memo[key] = None  # left recursion fails instead of looping
            out = self.memo[key] = self.apply(self.rules[e[1]], at)
            return out
        if kind == "seq":
            spans: list[Span] = []
            for part in e[1]:
                got = self.apply(part, at)
                if got is None:
                    return None
                at = got[0]
                spans += got[1]
            return at, spans
        if kind == "choice":
            for option in e[1]:
                got = self.apply(option, at)
                if got is not None:
                    return got
            return None
        if kind == "cap":
            got = self.apply(e[2], at)
            return None if got is None else (got[0], [(e[1], at, got[0]), *got[1]])
        if kind == "ahead":
            return (at, []) if (self.apply(e[2], at) is not None) == e[1] else None
        spans, n = [], 0
        while not (e[1] == "?" and n):
            got = self.apply(e[2], at)
            if got is None or got[0] == at and n:
                break
            at, n = got[0], n + 1
            spans += got[1]
        return None if e[1] == "+" and not n else (at, spans)
