"""Lexers: a file becomes a list of tokens and a string of token kinds, one character per token.

The parsers work on the kind string.  Names, numbers and strings are the kinds ``i``,
``n`` and ``s``; every keyword and operator has a character of its own; ``X`` is
something that is no token (a stray quote, an unfinished comment, a malformed number);
``N`` is a line end that ends a statement.  Because kinds forget names and values, the
same statement shape is the same string in all files, and shapes are parsed only once.
"""

from __future__ import annotations

import re

_CODES: dict[str, str] = {}
END = "\0"


def code(token: str) -> str:
    """The kind character of a keyword or operator."""
    if len(token) == 1 and (not token.isalnum() and token != "_" or token in "insNX"):
        return token
    return _CODES.setdefault(token, chr(0x100 + len(_CODES)))


def name_of(kind: str) -> str:
    """What a kind is called in a message."""
    known = {"i": "name", "n": "number", "s": "string", "X": "invalid character", "N": "end of line", END: "end of file"}
    return known.get(kind) or next((f"'{t}'" for t, c in _CODES.items() if c == kind), f"'{kind}'")


class _Kinds(dict):
    """Token text to kind; words, numbers and strings are added as they occur, up to a bound."""

    LIMIT = 200_000

    def __init__(self, fixed: dict[str, str], number: re.Pattern, quotes: str):
        super().__init__(fixed)
        self.number, self.quotes = number, quotes

    def __missing__(self, token: str) -> str:
        first = token[0]
        if first == "\n" or first == "\r":
            kind = "N"
        elif first.isdigit() or first == "." and len(token) > 1 and token[1].isdigit():
            kind = "n" if self.number.fullmatch(token) else "X"
        elif first in self.quotes and len(token) > 1 or len(token) > 2 and token[-1] in self.quotes or token[-1:] == "#" and '"' in token:
            kind = "s"
        elif first == "/" and len(token) > 2:
            kind = "s"
        elif first.isidentifier() or first in "$":
            kind = "i"
        elif first == "'" and len(token) > 1:
            kind = "s" if len(token) > 2 and token[-1] == "'" else code("'a")
        elif first == "#" and len(token) > 1:
            kind = "i"
        else:
            kind = "X"
        if len(self) < self.LIMIT and len(token) < 60:
            self[token] = kind
        return kind


class Lexer:
    """One language's tokens."""

    def __init__(self, keywords: str, operators: str, skip: str, literal: str, number: str, quotes: str = "\"'`", as_name: str = "", word: str = r"[^\W\d]\w*", lines: bool = False, first: str = "", same: dict[str, str] | None = None):
        ops = sorted(operators.split(), key=len, reverse=True)
        fixed = {t: code(t) for t in keywords.split() + ops} | dict.fromkeys(as_name.split(), "i") | {"": ""} | (same or {})
        newline = r"\n\s*+|" if lines else ""
        self.pattern = re.compile(
            rf"(?:{skip})*+({first}{newline}{literal}|{word}|\.?\d(?:[eEpP][+-](?=\d)|\w|'(?=\w)|\.(?![.]|[A-Za-df-z_]\w|e[A-Za-z_]))*|" + "|".join(map(re.escape, ops)) + r"|[^\s]|\Z)", re.S
        )
        self.kinds = _Kinds(fixed, re.compile(number), quotes)

    def tokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def kind_string(self, tokens: list[str]) -> str:
        return "".join(map(self.kinds.__getitem__, tokens))

    def lines_of(self, text: str, wanted: list[int]) -> list[int]:
        """Line numbers (from 1) of the tokens with these positions, which ascend."""
        out, k, line, last = [], 0, 1, 0
        for pos, m in enumerate(self.pattern.finditer(text)):
            while k < len(wanted) and wanted[k] == pos:
                line += text.count("\n", last, m.start(1))
                last = m.start(1)
                out.append(line)
                k += 1
            if k == len(wanted):
                return out
        return out + [text.count("\n") + 1] * (len(wanted) - k)


_C_SKIP = r"\s|//[^\n]*|/\*.*?\*/"
_C_OPS = "{ } ( ) [ ] ; , . -> ++ -- + - * / % & | ^ ! ~ < > <= >= == != && || << <<= ? : = += -= *= /= %= &= |= ^= :: ... @ #"
_DQ, _SQ = r'"(?:[^"\\\n]|\\.)*+"', r"'(?:[^'\\\n]|\\.)*+'"
_NUM_C = r"0[xX][\da-fA-F_']+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?[uUlLfF]*|0[bB][01_']+[uUlL]*|(?:\d[\d_']*)?\.?\d[\d_']*\.?(?:[eE][+-]?\d+)?[uUlLfFdDzZ]*"

C_KEYWORDS = "if else for while do switch case default return break continue goto struct union enum typedef sizeof"
C_SPECS = "const volatile static extern register auto inline restrict signed unsigned void char short int long float double bool _Bool size_t"
CPP_KEYWORDS = (
    C_KEYWORDS + " class namespace using template typename public private protected virtual override final new delete this throw try catch"
    " operator friend explicit constexpr noexcept static_cast dynamic_cast const_cast reinterpret_cast nullptr mutable decltype co_return co_await"
)
_C_DIRECTIVE = r"|#[ \t]*(?:include|define|if|ifdef|ifndef|elif|else|endif|pragma|undef|error|line|warning)\b(?:[^\n\\]|\\.)*+"
_C_STR = r"(?:L|u8|u|U)?" + _DQ + r"|(?:L|u8|u|U)?" + _SQ

C = Lexer(C_KEYWORDS + " " + C_SPECS, _C_OPS, _C_SKIP + _C_DIRECTIVE, _C_STR, _NUM_C, "\"'")
CPP = Lexer(CPP_KEYWORDS + " " + C_SPECS, _C_OPS + " .* ->* <=>", _C_SKIP + _C_DIRECTIVE, r'R"([^(\s]*)\(.*?\)\2"|'.replace(r"\2", r"(?:\w*)").replace("([^(\\s]*)", r"[^(\s]*") + _C_STR, _NUM_C, "\"'")
JAVA = Lexer(
    "if else for while do switch case default return break continue class interface enum new this super throw try catch finally instanceof import package"
    " public private protected static final abstract synchronized native transient volatile strictfp assert throws extends implements true false null",
    _C_OPS, _C_SKIP, r'"""(?:[^"\\]|\\.|"(?!""))*+"""|' + _DQ + "|" + _SQ, _NUM_C, "\"'", as_name="int long short byte char boolean float double void var sealed", same={"record": code("record")},
)
_REGEX = r"(?:(?<=[(,=:\[!&|?{};\n])|(?<=[(,=:\[!&|?{};>] )|(?<=return ))/(?![*/ =])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*|"
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`(?:[^`\\]|\\.)*+`)*+\})*+`|"
_JS_SKIP = r"[^\S\n]|//[^\n]*|/\*.*?\*/"
_JS_KEYWORDS = (
    "var let const if else for while do switch case default return break continue function class extends new this super throw try catch finally typeof void"
    " delete instanceof in import export null true false yield await async debugger"
)
_NUM_JS = r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?n?"
_JS_OPS = _C_OPS + " => === !== ** **= ?. ?? ??= &&= ||="
JS = Lexer(_JS_KEYWORDS, _JS_OPS, _JS_SKIP, _TEMPLATE + _DQ + "|" + _SQ, _NUM_JS, word=r"[^\W\d][\w$]*|\$[\w$]*|#[^\W\d]\w*", lines=True, first=_REGEX)
TS = Lexer(
    _JS_KEYWORDS + " enum", _JS_OPS, _JS_SKIP, _TEMPLATE + _DQ + "|" + _SQ, _NUM_JS, word=r"[^\W\d][\w$]*|\$[\w$]*|#[^\W\d]\w*", lines=True, first=_REGEX,
    same=dict.fromkeys(("keyof", "readonly", "unique", "infer", "asserts"), code("keyof"))
    | {"is": code("is"), "interface": code("interface"), "namespace": code("namespace"), "module": code("namespace")},
)
GO = Lexer(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "{ } ( ) [ ] ; , . ++ -- + - * / % & | ^ ! < > <= >= == != && || << >> &^ : = := += -= *= /= %= &= |= ^= <<= >>= &^= <- ... ~",
    r"[^\S\n]|//[^\n]*|/\*.*?\*/", r"`[^`]*+`|" + _DQ + "|" + _SQ, r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?i?", lines=True,
)
RUST = Lexer(
    "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait"
    " true false type unsafe use where while",
    "{ } ( ) [ ] ; , . -> => + - * / % & | ^ ! < > <= >= == != && || << <<= ? : = += -= *= /= %= &= |= ^= :: ... .. ..= @ # $ _",
    r"\s|//[^\n]*|/\*.*?\*/", r'b?r"[^"]*"|b?r#".*?"#|b?r##".*?"##|b?"(?:[^"\\]|\\.)*+"|b?\'(?:[^\'\\\n]|\\(?:[^u\n]|u\{[^}\n]*\}|x\w\w))\'|\'[^\W\d]\w*(?!\')',
    r"0x[\da-fA-F_]+(?:[ui]\w+)?|0b[01_]+(?:[ui]\w+)?|0o[0-7_]+(?:[ui]\w+)?|\d[\d_]*(?:\.\d[\d_]*)?\.?(?:[eE][+-]?\d+)?_?(?:[uif](?:8|16|32|64|128|size))?(?:\.\d+)*", "\"",
)
_PY_STR = r"(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|(?!\"\"\")\"(?:[^\"\\\n]|\\.)*+\"|(?!''')'(?:[^'\\\n]|\\.)*+')"
PYTHON = Lexer(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass"
    " raise return try while with yield match case type",
    "{ } ( ) [ ] ; , . -> + - * ** / // % @ & | ^ ~ < > <= >= == != << >> : := = += -= *= /= //= %= @= &= |= ^= >>= <<= **= ... `",
    r"[ \t\f\r]|\\\r?\n|#[^\n]*", r"(?:\n[ \t\r\f]*+(?:#[^\n]*)?+)++|" + _PY_STR,
    r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|0[0_]*|[1-9][\d_]*[jJ]?|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?[jJ]?", "\"'",
)
