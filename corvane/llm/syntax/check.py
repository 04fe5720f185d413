"""One file's verdict."""

from __future__ import annotations

import re
import sys
from typing import NamedTuple

from . import curly, golang, lexer, pythonlang, rustlang, script
from .prepare import bad_regex, prepare

sys.setrecursionlimit(max(sys.getrecursionlimit(), 8000))


class Verdict(NamedTuple):
    """``valid``; the number of errors; the first one's line and message; all of them as ``line: message``."""

    valid: bool | None
    n_errors: int
    line: int | None
    cause: str | None
    errors: list[str]


_PARSERS = {
    "javascript": (lexer.JS, script.Script, script.end_lines),
    "typescript": (lexer.TS, script.TypeScript, script.end_typed_lines),
    "java": (lexer.JAVA, curly.Java, curly.plain_names),
    "c": (lexer.C, curly.C, None),
    "cpp": (lexer.CPP, curly.Cpp, None),
    "go": (lexer.GO, golang.Go, golang.end_lines),
    "rust": (lexer.RUST, rustlang.Rust, None),
}
LANGUAGES = ("python", *_PARSERS, "markdown")
_GO_PACKAGE = re.compile(r"\s*+(?:(?://[^\n]*\n|/\*.*?\*/)\s*+)*+package\b", re.S)


def check(code: str, lang: str) -> Verdict | None:
    """Whether ``code`` is valid ``lang``; None for a language without a parser.  Markdown always is valid.

    A text nested too deep to parse keeps the errors found before and those of its brackets, which are
    matched without recursion; ``valid`` is None where there are none.
    """
    if lang == "markdown":
        return Verdict(True, 0, None, None, [])
    if lang != "python" and lang not in _PARSERS:
        return None
    if code.startswith("\ufeff"):
        code = code[1:]
    places, deep, early, marked = None, False, [], ""
    if lang == "python":
        lex = lexer.PYTHON
        code = "\n" + code  # the first line's indentation counts as well
        tokens = lex.tokens(code)
        kinds = lex.kind_string(tokens)
        try:
            found = pythonlang.parse(tokens, kinds)
        except RecursionError:
            found, deep = [], True
    else:
        lex, parser, end_lines = _PARSERS[lang]
        if "\r" in code:
            code = code.replace("\r\n", "\n").replace("\r", "\n")
        code, early = prepare(code, lang)
        tokens = lex.tokens(code)
        kinds = lex.kind_string(tokens)
        if end_lines is not None:
            marked = end_lines(kinds)
            kinds = marked.replace(" ", "")
        run = parser(kinds)
        try:
            if lang == "go" and kinds and not _GO_PACKAGE.match(code):
                run.errors.append((0, "expected 'package'"))
            run.file("top")
        except RecursionError:
            deep = True
        found = run.errors
    if deep and (p := _unmatched(kinds)) is not None:
        found = [*found, (p, "brackets don't match")]
    if found and marked:
        places = [k for k, c in enumerate(marked) if c != " "] + [len(marked)]
        found = [(places[min(p, len(places) - 1)], why) for p, why in found]
    if lang in ("javascript", "typescript") and "(" in code:
        found = [*found, *((k, "groups of a regular expression don't match") for k, t in enumerate(tokens) if t[:1] == "/" and len(t) > 2 and t[1] not in "/*" and bad_regex(t))]
    if not found and not early:
        return Verdict(None if deep else True, 0, None, None, [])
    found = sorted(set(found))
    lines = lex.lines_of(code, [p for p, _ in found])
    if lang == "python":
        lines = [n - 1 or 1 for n in lines]
    all_errors = sorted([*zip(lines, [why for _, why in found]), *early], key=lambda e: e[0])
    return Verdict(False, len(all_errors), all_errors[0][0], all_errors[0][1], [f"{n}: {why}" for n, why in all_errors])


def _unmatched(kinds: str) -> int | None:
    """Where brackets first don't match."""
    shut, stack = {"(": ")", "[": "]", "{": "}"}, []
    for k, c in enumerate(kinds):
        if c in shut:
            stack.append(shut[c])
        elif c in ")]}" and (not stack or stack.pop() != c):
            return k
    return len(kinds) if stack else None
