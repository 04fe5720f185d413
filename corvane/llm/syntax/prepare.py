"""What is taken out of a text before it is lexed: constructs that need more than a token's look-around.

Everything is replaced by blanks of the same length (line ends stay), so lines and offsets
stay true.  Each step runs only on texts that hold its mark.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_NOT_NEWLINE = re.compile(r"[^\n]")


def _blank(text: str) -> str:
    return _NOT_NEWLINE.sub(" ", text)


def _put(text: str, a: int, b: int, word: str = "") -> str:
    """``text`` with a..b blank but for ``word`` at its beginning, if it fits."""
    gap = _blank(text[a:b])
    if word and "\n" not in gap[: len(word)] and len(word) <= len(gap):
        gap = word + gap[len(word) :]
    return text[:a] + gap + text[b:]


_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[()\[\]{}]", re.S)
_SHUT = {"(": ")", "[": "]", "{": "}"}


def _end_of_group(text: str, at: int) -> int:
    """The offset behind the bracket that closes the one at ``at``; -1 if none does."""
    stack: list[str] = []
    for m in _TOKEN.finditer(text, at):
        c = m.group()
        if c in _SHUT:
            stack.append(_SHUT[c])
        elif c in (")", "]", "}"):
            if not stack or stack.pop() != c:
                return -1
            if not stack:
                return m.end()
    return -1


def _groups(text: str, head: re.Pattern, word: str = "", from_name: bool = True) -> str:
    """Blank every bracketed group that ``head`` (which ends at the bracket) introduces, with its head or without."""
    at = 0
    while (m := head.search(text, at)) is not None:
        end = _end_of_group(text, m.end() - 1)
        if end < 0:
            return text
        start = m.start() if from_name else m.end() - 1
        text = _put(text, start, end, word)
        at = start + max(1, len(word))
    return text


# --- C and C++ ---------------------------------------------------------------------------------

_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b[ \t]*(.*)")


def conditionals(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text of one branch of every conditional, and (line, message) of directives that don't nest."""
    errors: list[tuple[int, str]] = []
    stack: list[list] = []  # [line, taking this branch, one was taken, else was seen]
    out = []
    inside = False  # a comment over several lines
    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        m = None if inside else _DIRECTIVE.match(line)
        if m is None:
            bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|//.*", "", line) if not inside else line
            inside = (bare.rfind("/*") > bare.rfind("*/")) if not inside else ("*/" not in line or line.rfind("/*") > line.rfind("*/"))
            out.append(line if all(s[1] for s in stack) else " " * len(line))
            continue
        kind, rest = m.group(1), m.group(2).strip()
        if kind in ("if", "ifdef", "ifndef"):
            take = not (kind == "if" and re.match(r"(?:0|false)\b", rest))
            stack.append([n, take, take, False])
        elif not stack:
            errors.append((n, f"#{kind} without #if"))
        elif kind == "endif":
            stack.pop()
        elif stack[-1][3]:
            errors.append((n, f"#{kind} after #else"))
        else:
            stack[-1][3] = kind == "else"
            stack[-1][1] = not stack[-1][2]
            stack[-1][2] = True
        out.append(" " * len(line))
    errors += [(s[0], "#if without #endif") for s in stack]
    return "\n".join(out), sorted(errors)


_ATTRIBUTE = re.compile(r"\b(?:__attribute__|__attribute|__declspec|_Alignas|alignas|__nonnull|__attribute_\w+__)\s*\(")
_ASM = re.compile(r"\b(?:__asm__|__asm|asm)\s*(?:__volatile__|volatile|goto|inline)?\s*(?:__volatile__|volatile|goto|inline)?\s*\(")
_GENERIC = re.compile(r"\b_Generic\s*\(")
_EACH = re.compile(r"\b\w*(?:for_?each|FOR_?EACH)\w*(?=\s*\()")
_EXTENSION = re.compile(r"\b(?:__extension__|__restrict__|__restrict|__inline__|__inline|_Noreturn|__volatile__|__const)\b")
_OLD_STYLE = re.compile(r"(?<=\))[ \t]*\n(?:[ \t]*(?:const |unsigned |struct )*\w+[ \t*]+\w+(?:\[\])?(?:[ \t]*,[ \t*]*\w+)*[ \t]*;[ \t]*\n)+(?=[ \t]*\{)")
_REQUIRES_BODY = re.compile(r"\brequires\s*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)\s*)?\{")
_ONE = r"(?:\([^()]*\)|!?[A-Za-z_][\w:]*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>)?(?:::\w+)?)"
_REQUIRES = re.compile(rf"\brequires\s+{_ONE}(?:\s*(?:&&|\|\|)\s*{_ONE})*")
_GENERIC_LAMBDA = re.compile(r"(?<=\])\s*<[^<>(){};]*(?:<[^<>(){};]*>[^<>(){};]*)*>(?=\s*\()")


def _c(text: str, cpp: bool) -> tuple[str, list[tuple[int, str]]]:
    errors: list[tuple[int, str]] = []
    if "#" in text and re.search(r"(?m)^[ \t]*#[ \t]*(?:if|el|endif)", text):
        text, errors = conditionals(text)
    if "__" in text or "alignas" in text or "_Alignas" in text or "_Noreturn" in text:
        text = _EXTENSION.sub(lambda m: _blank(m.group()), _groups(text, _ATTRIBUTE))
    if "asm" in text:
        text = _groups(text, _ASM, "0")
    if "_Generic" in text:
        text = _groups(text, _GENERIC, "0")
    if "each" in text or "EACH" in text:
        text = _EACH.sub(lambda m: "while".ljust(len(m.group())) if len(m.group()) >= 5 else m.group(), text)
    if cpp:
        if "requires" in text:
            text = _REQUIRES.sub(lambda m: _blank(m.group()), _groups(text, _REQUIRES_BODY, "1"))
        if "concept" in text:
            text = re.sub(r"\bconcept(?=\s+\w+\s*=)", "auto   ", text)
        if "co_" in text:
            text = re.sub(r"\bco_return\b", "return   ", re.sub(r"\bco_(?:await|yield)\b", lambda m: " " * len(m.group()), text))
        if "]" in text:
            text = _GENERIC_LAMBDA.sub(lambda m: _blank(m.group()), text)
    elif ";" in text:
        text = _OLD_STYLE.sub(lambda m: _blank(m.group()), text)
    return text, errors


# --- Java, Rust --------------------------------------------------------------------------------

_PERMITS = re.compile(r"\bpermits\s+[\w.]+(?:\s*,\s*[\w.]+)*(?=\s*\{)")
_RECORD_PATTERN = re.compile(r"(?:\binstanceof|\bcase)\s+(?:final\s+)?[A-Z][\w.]*(?:<[^<>]*>)?\s*\(")


def _java(text: str) -> str:
    if "sealed" in text:
        text = _PERMITS.sub(lambda m: _blank(m.group()), re.sub(r"\b(?:non-)?sealed\b(?=\s+\w)", lambda m: " " * len(m.group()), text))
    if ("instanceof" in text or "case" in text) and _RECORD_PATTERN.search(text):
        at = 0
        while (m := _RECORD_PATTERN.search(text, at)) is not None:
            end = _end_of_group(text, m.end() - 1)
            if end < 0:
                break
            text = _put(text, m.end() - 1, end, " r")
            at = m.end()
    return text


_COMMENT_MARK = re.compile(r"/\*|\*/")


def _rust(text: str) -> str:
    if "use<" in text:
        text = re.sub(r"\+\s*use<[^<>]*>", lambda m: _blank(m.group()), text)
    if text.count("/*") < 2:
        return text
    at = 0
    while (m := re.compile(r"//[^\n]*|\"(?:[^\"\\]|\\.)*\"|/\*", re.S).search(text, at)) is not None:
        at = m.end()
        if m.group() != "/*":
            continue
        depth = 1
        for k in _COMMENT_MARK.finditer(text, at):
            depth += 1 if k.group() == "/*" else -1
            at = k.end()
            if not depth:
                break
        if depth:
            return text
        text = text[: m.start()] + _blank(text[m.start() : at]) + text[at:]
    return text


# --- JavaScript and TypeScript -----------------------------------------------------------------

_OPEN_TAG = re.compile(r"<(?P<name>[A-Za-z][\w.:-]*)?(?=[\s/>{])|<(?P<empty>)>")
_WHERE_TAG = re.compile(r"(?:[(,=:?\[{};]|&&|\|\||\?\?|=>|\breturn|\bdefault|^)\s*(?=<(?:[A-Za-z]|>))", re.M)
_ATTRIBUTES = re.compile(r"\s*(?:(?P<end>/?>)|(?P<brace>\{)|[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?P<value>\{)))?)")


def _element(text: str, at: int) -> int:
    """The offset behind a JSX element; -1 if there is none."""
    open_names: list[str] = []
    while True:
        m = _OPEN_TAG.match(text, at)
        if m is None:
            return -1
        name, at = m.group("name") or "", m.end()
        while True:
            a = _ATTRIBUTES.match(text, at)
            if a is None or a.end() == at:
                return -1
            at = a.end()
            if a.group("end"):
                break
            if a.group("brace") or a.group("value"):
                at = _end_of_group(text, at - 1)
                if at < 0:
                    return -1
        if a.group("end") == ">":
            open_names.append(name)
        while open_names:  # children
            k = re.compile(r"[<{]").search(text, at)
            if k is None:
                return -1
            at = k.start()
            if k.group() == "{":
                at = _end_of_group(text, at)
                if at < 0:
                    return -1
                continue
            shut = re.compile(r"</\s*([\w.:-]*)\s*>").match(text, at)
            if shut is None:
                break  # another element
            if shut.group(1) != open_names.pop():
                return -1
            at = shut.end()
        if not open_names:
            return at


def jsx(text: str) -> str:
    """Every well-formed JSX element as a string literal."""
    at = 0
    while (m := _WHERE_TAG.search(text, at)) is not None:
        end = _element(text, m.end())
        if end > 0 and end - m.end() >= 2:
            gap = list(_blank(text[m.end() : end]))
            gap[0] = "0"
            text = text[: m.end()] + "".join(gap) + text[end:]
            at = end
        else:
            at = m.end() + 1
    return text


_INFER = re.compile(r"(\binfer\s+\w+)(\s+extends\s+[\w.]+(?:<[^<>]*>)?(?:\[\])*)")
_ASSERTION = re.compile(r"((?:[=(,:?\[]|\breturn)\s*)(<[A-Za-z][\w.]*(?:<[\w.,\s]*>)?(?:\[\])*>)(?=\s*[\w$({\[])")
_CLASS_CHARS = re.compile(r"\\.|\[(?:[^\]\\]|\\.)*\]", re.S)


def _script(text: str, typed: bool) -> str:
    if text.startswith("#!"):
        text = _put(text, 0, text.find("\n") if "\n" in text else len(text))
    if ("</" in text or "/>" in text) and _WHERE_TAG.search(text):
        text = jsx(text)
    if typed and "<" in text:
        text = _ASSERTION.sub(lambda m: m.group(1) + _blank(m.group(2)), text)
    if typed and "infer" in text:
        text = _INFER.sub(lambda m: m.group(1) + _blank(m.group(2)), text)
    return text


def bad_regex(token: str) -> bool:
    """Whether a regular expression's groups don't match."""
    depth = 0
    for c in _CLASS_CHARS.sub("", token):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return True
    return depth != 0


_STEPS: dict[str, Callable[[str], tuple[str, list[tuple[int, str]]]]] = {
    "c": lambda t: _c(t, False),
    "cpp": lambda t: _c(t, True),
    "java": lambda t: (_java(t), []),
    "rust": lambda t: (_rust(t), []),
    "javascript": lambda t: (_script(t, False), []),
    "typescript": lambda t: (_script(t, True), []),
}


def prepare(code: str, lang: str) -> tuple[str, list[tuple[int, str]]]:
    """The text to lex, and (line, message) of errors found on the way."""
    step = _STEPS.get(lang)
    return (code, []) if step is None else step(code)
