"""Problem 6: functions paired with their documentation.

A packrat grammar of the file's language is tried wherever a function can begin, from the
comment directly above; its captures (documentation, name, code) keep source offsets, and
that is how functions are extracted from a file, whether or not a table knows them
(:func:`extract`, :func:`extracted_functions`).  The functions of a table are those extracted at their lines; where none was, the
grammar is tried on the lines themselves.  A semantic action turns the captures into a pair;
a filter drops documentation that says nothing beyond the function's name and signature.

Only narrow rows and each file's current text are shuffled, once, by file; the functions
of one file stay together.  Code is attached afterwards, to documented functions only.

Defined results: null chunk ids, line numbers outside the file and null code give no
pair; a docstring is preferred to a comment if both inform; repeated rows give one pair;
a chunk id with several contents keeps the greatest; functions without current source
give no pair.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .current import KEY
from .peg import Grammar

FUNCTION_TYPES = (
    "function_definition", "decorated_definition", "function_declaration", "method_definition", "method_declaration", "function_item",
    "lexical_declaration", "variable_declaration", "arrow_function", "export_statement", "constructor_declaration", "generator_function_declaration",
)

_COMMON = r"""
Space    <- ~[\s]*~
Block    <- ~/\*(?:(?!\*/).)*\*/~
Slash    <- ~//[^\n]*(?:\n[ \t]*//[^\n]*)*~
Above    <- Space doc:(Block / Slash)
String   <- ~"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'~
Round    <- '(' (~[^()"'/]+~ / Round / String / Block / Slash / ~["'/]~)* ')'
Square   <- '[' (~[^\[\]"']+~ / Square / String / ~["']~)* ']'
Angle    <- '<' (~[^<>(){};=-]+~ / Angle / Round / ~->|=>|=|-~)* '>'
Rest     <- ~.*~
"""

GRAMMARS = {
    "python": Grammar(r"""
Unit      <- Hash? Space Decorator* code:Def
Hash      <- Space doc:~#[^\n]*(?:\n[ \t]*#[^\n]*)*~
Space     <- ~\s*~
Gap       <- ~(?:[ \t\f\n]|\\\n|#[^\n]*)*~
Decorator <- '@' ~[^\n(]*~ Round? ~[^\n]*\n~ Gap
Def       <- ~(?:async\s+)?def\s+~ name:~\w+~ Gap Square? Gap Round Gap Returns? ':' Gap Docstring? Rest
Returns   <- '->' (Round / Square / String / ~[^:()\[\]"'\n]+~)*
Docstring <- ~[rRuUbB]{0,2}~ (inner:Triple / inner:Single) ~[ \t]*(?:[;#\n]|$)~
Triple    <- ~\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''~
Single    <- String
String    <- ~"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'~
Round     <- '(' (~[^()"'#]+~ / ~#[^\n]*~ / Round / Triple / String / ~["']~)* ')'
Square    <- '[' (~[^\[\]"']+~ / Square / String / ~["']~)* ']'
Rest      <- ~.*~
"""),
    "javascript": Grammar(_COMMON + r"""
Unit      <- Above? Space Decorator* code:Function
Decorator <- '@' ~[\w.]+~ Round? Space
Export    <- ~(?:export\s+)?(?:default\s+)?(?:declare\s+)?~
Function  <- Export (Named / Bound / Method)
Named     <- ~(?:async\s+)?function\b\s*\*?\s*~ name:~[\w$]*~ Space Angle? Space Round Rest
Bound     <- ~(?:const|let|var)\s+~ name:~[\w$]+~ Space Type? '=' !~[=>]~ Space (~(?:async\s+)?function\b~ Rest / Arrow)
Type      <- ':' (Round / Angle / Square / ~=>~ / ~[^=()<>\[\];]+~)+
Arrow     <- ~(?:async\b\s*)?~ Angle? Space (Round Space Type2? / ~[\w$]+\s*~) '=>' Rest
Type2     <- ':' (!'=>' (Round / Angle / Square / ~\{[^{}]*\}~ / ~[^=()<>\[\]{};]~))+ Space
Method    <- Modifier* !~(?:class|interface|enum|type|namespace|module|import|if|for|while|switch|return|catch|new)\b~ name:(~[#\w$]+~ / Square / String) ~[?!]?\s*~ Angle? Space Round Rest
Modifier  <- ~(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\b\s+(?=[\w$#\[*"'])|\*\s*)~
"""),
    "java": Grammar(_COMMON + r"""
Unit      <- Above? Space code:Function
Mark      <- '@' ~[\w.]+~ Space Round? Space
Function  <- (Mark / ~(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\b\s*~)* Angle? Space
             !~(?:class|interface|enum|record|new|return|throw)\b~ (Type Space)? name:~\w+~ Space Round Rest
Type      <- ~[\w.]+~ Space Angle? (~\.\w+~ Angle?)* ~(?:\s*\[\s*\])*~ &~\s*\w+\s*\(~
"""),
    "c": Grammar(_COMMON + r"""
Unit      <- Above? Space code:Function
Function  <- (~template\s*~ Angle Space)? !~(?:class|struct|enum|union|namespace|typedef|using)\b[^(;]*\{~
             (Name Space Round Tail / Part Function2)
Function2 <- Space (Name Space Round Tail / Part Function2)
Part      <- ~(?:const|static|inline|extern|virtual|explicit|constexpr|unsigned|signed|struct|enum|friend)\b~ / ~[\w:]+~ Angle? ~(?:::\w+)*~ / ~[*&]+~ / Square
Name      <- name:~(?:[\w]+\s*::\s*)*~ name:(~~?operator\s*[^\s(]+~ / ~\~?[A-Za-z_]\w*~)
Tail      <- Space ~(?:const|noexcept|override|final|->[^{;]*)?\s*~ &~[{:=;t]|$~ Rest
""".replace("name:~(?:[\\w]+\\s*::\\s*)*~ ", "~(?:[\\w]+\\s*::\\s*)*~ ").replace("~~?operator", "~operator")),
    "go": Grammar(_COMMON + r"""
Unit      <- Above? Space code:Function
Function  <- ~func\s+~ (Round Space)? name:~\w+~ Space Square? Space Round Rest
"""),
    "rust": Grammar(_COMMON + r"""
Unit      <- Above? Space Attribute* code:Function
Attribute <- ~#!?~ Square Space
Function  <- (~pub\b\s*~ Round? Space)? ~(?:(?:default|const|async|unsafe|extern(?:\s*"[^"]*")?)\s+)*fn\s+~ name:~\w+~ Space Angle? Space Round Rest
"""),
}
GRAMMARS["typescript"], GRAMMARS["cpp"] = GRAMMARS["javascript"], GRAMMARS["c"]

_LINE_COMMENT = {"python": "#"}
_ATTRIBUTE = {"rust": re.compile(r"\s*#!?\[.*\]\s*$"), "java": re.compile(r"\s*@\w[\w.]*(?:\(.*\))?\s*$"), "cpp": re.compile(r"\s*(?:template\s*<.*>|\[\[.*\]\])\s*$")}
_ATTRIBUTE["typescript"] = _ATTRIBUTE["javascript"] = _ATTRIBUTE["java"]


def comment_start(lines: list[str], start: int, lang: str) -> int:
    """The line number (from 0) where the comment directly above line ``start`` (from 0) begins; ``start`` if there is none."""
    mark = _LINE_COMMENT.get(lang, "//")
    k = start - 1
    attribute = _ATTRIBUTE.get(lang)
    while attribute is not None and k >= 0 and attribute.match(lines[k]):
        k -= 1
    if k < 0:
        return start
    line = lines[k].strip()
    if mark == "//" and line.endswith("*/"):
        first = k
        while first >= 0 and "/*" not in lines[first]:
            first -= 1
        return first if first >= 0 and lines[first].lstrip().startswith("/*") else start
    if not line.startswith(mark) or mark == "#" and line.startswith("#!"):
        return start
    while k > 0 and lines[k - 1].strip().startswith(mark):
        k -= 1
    return k


# Words that say nothing about what a function does.
EMPTY_WORDS = frozenset(
    """a an the this that these those it its is are be does do did of for to in on with and or from by as at function functions method methods routine procedure
    helper func def class constructor getter setter implementation returns return param params parameter parameters arg args argument arguments raises throws
    void none null self cls""".split()
)
# Words of which placeholders are made.
PLACEHOLDER_WORDS = frozenset(
    """todo fixme xxx tbd wip hack note document documented documentation docs doc docstring description describe undocumented no not yet goes here add write fill
    later missing placeholder stub comment comments me please needed required required. summary text lorem ipsum n na nothing empty see above below also inheritdoc
    autogenerated unnamed unknown insert your some something""".split()
)
_CROSS = re.compile(r"(?i)^\W*(?:\{?@(?:see|link|inheritdoc|copydoc)\b[^}]*\}?|(?:see|cf\.?|refer to|same as|like|ditto|compare)(?:\s+(?:also|the|for))*\s+[`'\"\w.:#/()<>\[\]-]+(?:\s+(?:above|below|instead|for details))?)\W*$")
_DIRECTIVE = re.compile(r"(?i)^\s*(?:noqa|type:\s*ignore|pylint:|eslint-|ts-ignore|ts-expect-error|nolint|go:\w+|prettier-ignore|istanbul|region\b|endregion\b|clang-format|fmt:\s*(?:on|off)|pragma:|coding[:=]|noinspection|checkstyle)")
_TAG = re.compile(r"^\s*(?:[@\\](?P<tag>\w+)|:(?P<role>\w+)(?P<of>[^:\n]*):)\s*(?P<rest>.*)$")
_NAMED_TAGS = frozenset("param parameter arg argument tparam key keyword raises raise throws throw exception except var ivar cvar type property prop typeparam".split())
_SECTION = re.compile(r"(?i)^\s*(?:args?|arguments|parameters?|params|returns?|raises|throws|yields?|attributes)\s*:?\s*$")
_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*+(?!/)|///?!?|//!|#+:?)?[ \t]?|[ \t]*\*+/[ \t]*$")
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\da-zA-Z_]+")


def plain_text(comment: str) -> str:
    """A comment without its marks."""
    return "\n".join(_MARKS.sub("", _MARKS.sub("", line)).strip() if "*/" in line else _MARKS.sub("", line).strip() for line in comment.split("\n")).strip()


def _stem(word: str) -> str:
    for end in ("ing", "ied", "ies", "ed", "es", "s", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def informs(doc: str, name: str) -> bool:
    """Whether documentation says more than a function's name, bare tags, a placeholder or a cross-reference."""
    lines = []
    for line in doc.split("\n"):
        if _DIRECTIVE.match(line) or _SECTION.match(line) or _CROSS.match(line):
            continue
        m = _TAG.match(line)
        if m is not None:
            tag = (m.group("tag") or m.group("role")).lower()
            if tag in ("see", "inheritdoc", "link", "author", "since", "version", "copydoc", "ignore", "internal", "override", "todo", "deprecated", "generated"):
                if tag not in ("deprecated",):
                    continue
            rest = m.group("rest")
            rest = re.sub(r"^\{[^}]*\}\s*", "", rest)
            if m.group("role") is None and tag in _NAMED_TAGS:
                rest = re.sub(r"^\[?[\w$.*&]+\]?\s*[-:]?\s*", "", rest, count=1)
            lines.append(rest)
            continue
        lines.append(line)
    text = " ".join(lines)
    if _CROSS.match(text):
        return False
    named = {_stem(w.lower()) for w in _CAMEL.findall(name)} | {_stem(name.lower())}
    told = set()
    for word in _WORD.findall(text):
        low = word.lower()
        parts = {_stem(p.lower()) for p in _CAMEL.findall(word)} or {_stem(low)}
        if parts <= named or low in EMPTY_WORDS or low in PLACEHOLDER_WORDS or low.isdigit() or len(set(low)) == 1:
            continue
        told.add(low)
    return len(told) >= 2 or any(len(w) >= 4 and not w.isascii() for w in told)


def pair(text: str, lang: str) -> tuple[str, str, int, int] | None:
    """(name, documentation, offset of the function, offset of the documentation) of a function's text with its comment."""
    grammar = GRAMMARS.get(lang)
    if grammar is None:
        return None
    got = grammar.match(text, "Unit")
    if got is None:
        return None
    spans: dict[str, tuple[int, int]] = {}
    for label, a, b in got[1]:
        spans.setdefault(label, (a, b))
    name = text[slice(*spans["name"])].strip() if "name" in spans else ""
    options = []
    if "inner" in spans:
        a, b = spans["inner"]
        quote = 3 if text[a : a + 3] in ('"""', "'''") else 1
        options.append((text[a + quote : b - quote].strip(), a))
    if "doc" in spans:
        a, b = spans["doc"]
        options.append((plain_text(text[a:b]), a))
    for doc, at in options:
        if informs(doc, name):
            return name, doc, spans["code"][0], at
    return None


#: Lines at which a function can begin; the grammar decides.
_MAY_BEGIN = {
    "python": re.compile(r"\s*(?:async\s+)?def\b"),
    "go": re.compile(r"func\b"),
    "rust": re.compile(r"\s*(?:pub\b|async\b|const\b|unsafe\b|extern\b|default\b|fn\b)[^;={]*\bfn\b|\s*fn\b"),
    "javascript": re.compile(r"\s*(?:export\b|async\b|function\b|(?:const|let|var)\s+[\w$]+[^=]*=|[*#\w$][\w$#\s]*[(<])(?!.*;\s*$(?<!\};))"),
    "java": re.compile(r"\s*[\w@<][^=;\"]*\("),
    "c": re.compile(r"[\w~][^=;\"]*\(|\s+[\w~][\w\s*&:<>,~]*\([^;]*\)?[^;]*$"),
}
_MAY_BEGIN["typescript"], _MAY_BEGIN["cpp"] = _MAY_BEGIN["javascript"], _MAY_BEGIN["c"]
_NOT_HERE = re.compile(r"\s*(?:if|for|while|switch|catch|return|else|do|try|throw|new|case|await|yield|class|import|package)\b")


#: Lines that belong to the function below them.
_LEADING = {"python": re.compile(r"\s*@"), **{lang: _ATTRIBUTE[lang] for lang in ("java", "javascript", "typescript", "cpp")}}


class Source:
    """A file's lines and where they stand in the stored text, whatever its line ends."""

    def __init__(self, code: str):
        self.lines, self.starts, self.at = [], [], [0]
        for m in re.finditer(r"([^\r\n]*)(\r\n|\r|\n|\Z)", code):
            if m.end() == m.start() and self.lines and code[-1:] not in ("\r", "\n"):
                break
            self.lines.append(m.group(1))
            self.starts.append(m.start())
            self.at.append(self.at[-1] + len(m.group(1)) + 1)
        self.text = "\n".join(self.lines)

    def stored(self, offset: int) -> int:
        """Where an offset of the text with ``\\n`` line ends stands in the stored text."""
        k = bisect.bisect_right(self.at, offset) - 1
        return self.starts[min(k, len(self.starts) - 1)] + offset - self.at[min(k, len(self.starts) - 1)]

    def part(self, first: int, last: int) -> str:
        return "\n".join(self.lines[first:last])


def _end_line(source: Source, start: int, lang: str) -> int:
    """The line (from 0) behind a function that begins at line ``start``."""
    lines = source.lines
    if lang == "python":
        indent = len(lines[start]) - len(lines[start].lstrip())
        k, depth = start, 0
        while k < len(lines):
            bare = _PLAIN_STRING.sub("", lines[k])
            deeper = not bare.strip() or len(lines[k]) - len(lines[k].lstrip()) > indent
            if k > start and not depth and not deeper:
                break
            depth = max(0, depth + sum(bare.count(c) for c in "([{") - sum(bare.count(c) for c in ")]}"))
            k += 1
        while k > start + 1 and not lines[k - 1].strip():
            k -= 1
        return k
    depth = 0
    for m in _BRACE.finditer(source.text, source.at[start]):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth <= 0 and c == "}":
                return source.text.count("\n", 0, m.end()) + 1
        elif c == ";" and not depth:
            return source.text.count("\n", 0, m.end()) + 1
    return len(lines)


_PLAIN_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|#.*")
_BRACE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`(?:[^`\\]|\\.)*`|[()\[\]{};]", re.S)


def _found_at(source: Source, start: int, end: int, lang: str) -> tuple | None:
    """(name, documentation, offset of the function, of the documentation) of the function at lines ``start`` to ``end`` (from 0), in the stored text."""
    first = comment_start(source.lines, start, lang)
    got = pair(source.part(first, end), lang)
    if got is None:
        return None
    name, doc, at, doc_at = got
    return name, doc, source.stored(source.at[first] + at), source.stored(source.at[first] + doc_at)


def extract(code: str, lang: str) -> Iterator[tuple]:
    """Every documented function that the grammar finds in a file: (first line, last line, name, documentation, offset of the function, of the documentation)."""
    may = _MAY_BEGIN.get(lang)
    if may is None:
        return
    source = Source(code)
    for k, line in enumerate(source.lines):
        if may.match(line) is None or _NOT_HERE.match(line):
            continue
        start = k
        mark = _LEADING.get(lang)
        while mark is not None and start and mark.match(source.lines[start - 1]):
            start -= 1
        end = _end_line(source, k, lang)
        got = _found_at(source, start, end, lang)
        if got is not None:
            yield start + 1, end, *got


def functions_of_file(code: str, lang: str, wanted: list) -> Iterator[tuple]:
    """For each wanted (chunk_id, start_line, end_line) with documentation: its id, name, documentation and the offsets of both in the stored text."""
    source = Source(code)
    found = {start: f for start, _, *f in extract(code, lang)} if wanted else {}
    for chunk_id, start, end in wanted:
        if start is None or end is None or not 1 <= start <= end or start > len(source.lines):
            continue
        got = found.get(start) or _found_at(source, start - 1, min(end, len(source.lines)), lang)
        if got is not None:
            name, doc, at, doc_at = got
            yield chunk_id, name, doc, doc_at, at


def extracted_functions(files: DataFrame) -> DataFrame:
    """(index_prefix, file_path, lang, start_line, end_line, name, documentation, code_offset) of all documented functions in the current files, by the grammars alone."""
    version = F.struct(F.col("scanned_at").isNotNull().alias("d"), "scanned_at", F.coalesce("sha256", F.lit("")).alias("s"))
    rows = files.where("code is not null and file_path is not null and index_prefix is not null")
    current = rows.groupBy(*KEY).agg(F.max(version).alias("v"))
    texts = rows.select(*KEY, "lang", version.alias("v"), "code").join(current, [*KEY, "v"])
    schema = "index_prefix string, file_path string, lang string, start_line int, end_line int, name string, documentation string, code_offset int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (prefix, path, lang, *f[:5])
                for prefix, path, lang, code in zip(pdf["index_prefix"], pdf["file_path"], pdf["lang"], pdf["code"])
                for f in extract(code, (lang or "").strip().lower())
            ]
            yield pd.DataFrame(out, columns=["index_prefix", "file_path", "lang", "start_line", "end_line", "name", "documentation", "code_offset"])

    return texts.mapInPandas(run, schema).dropDuplicates([*KEY, "start_line"])


def documented_functions(functions: DataFrame, files: DataFrame) -> DataFrame:
    """One row per function chunk with informative documentation; offsets count characters of the stored text."""
    wanted = (
        functions.where(F.col("node_type").isin(*FUNCTION_TYPES) & F.col("chunk_id").isNotNull() & F.col("start_line").isNotNull())
        .groupBy(*KEY).agg(F.collect_set(F.struct("chunk_id", "start_line", "end_line")).alias("wanted"))
    )
    version = F.struct(F.col("scanned_at").isNotNull().alias("d"), "scanned_at", F.coalesce("sha256", F.lit("")).alias("s"))
    current = files.groupBy(*KEY).agg(F.max(version).alias("v"))
    wanted = wanted.join(current, KEY)
    texts = files.where(F.col("code").isNotNull()).select(*KEY, "lang", version.alias("v"), "code")
    joined = texts.join(wanted, [*KEY, "v"]).select(*KEY, "lang", "code", "wanted")
    return joined.mapInPandas(
        _documented, "index_prefix string, file_path string, lang string, chunk_id string, name string, documentation string, doc_offset int, code_offset int"
    ).dropDuplicates(["index_prefix", "file_path", "chunk_id", "documentation"])


def _documented(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["index_prefix", "file_path", "lang", "chunk_id", "name", "documentation", "doc_offset", "code_offset"]
    for pdf in batches:
        rows = []
        for prefix, path, lang, code, wanted in zip(pdf["index_prefix"], pdf["file_path"], pdf["lang"], pdf["code"], pdf["wanted"]):
            todo = [(w["chunk_id"], w["start_line"], w["end_line"]) for w in wanted]
            rows += [(prefix, path, lang, *r) for r in functions_of_file(code, (lang or "").strip().lower(), todo)]
        yield pd.DataFrame(rows, columns=columns)


def documentation_pairs(functions: DataFrame, files: DataFrame, full_chunks: DataFrame) -> DataFrame:
    """(chunk_id, name, documentation, code): every documented function with the code behind its ``full_code_path``."""
    docs = documented_functions(functions, files)
    code = full_chunks.groupBy("chunk_id").agg(F.max("content").alias("code"))
    return docs.join(code, "chunk_id", "left")
