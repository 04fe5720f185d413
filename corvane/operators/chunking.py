"""Source files to chunks: functions, classes and types by their line ranges, and windows over what is left.

Python is read with its own parser; the languages with braces by a scanner that blanks
strings and comments (offsets stay), finds headers of definitions and matches braces.
A class does not end the descent: its methods are chunks too.  Functions inside
functions are not.  Definitions under 20 characters are skipped, files that can't be read
give windows only.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

WINDOW = 50
SMALLEST = 20


class Chunk(NamedTuple):
    start_line: int
    end_line: int
    type: str
    function_name: str
    docstring: str | None


def _python(code: str) -> list[Chunk]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(code)
    out: list[Chunk] = []
    lines = code.split("\n")

    def visit(body: list, depth: int = 0) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
                a_class = isinstance(node, ast.ClassDef)
                kind = "decorated_definition" if node.decorator_list else "class_definition" if a_class else "function_definition"
                doc = ast.get_docstring(node, clean=False)
                if len("\n".join(lines[first - 1 : node.end_lineno]).strip()) >= SMALLEST:
                    out.append(Chunk(first, node.end_lineno, kind, node.name, doc.strip() if doc else None))
                if a_class and not node.decorator_list:
                    visit(node.body, depth + 1)
            else:
                for part in ("body", "orelse", "finalbody", "handlers"):
                    inner = getattr(node, part, None)
                    if isinstance(inner, list) and inner and isinstance(inner[0], (ast.stmt, ast.excepthandler)):
                        visit([x for h in inner for x in (h.body if isinstance(h, ast.excepthandler) else [h])], depth)

    visit(tree.body)
    return out


_HIDE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.){1,8}'|`(?:[^`\\]|\\.)*`", re.S)
_HIDE_QUOTES = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_SCRIPT = [
    ("function_declaration", r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^<>{}]*>)?\s*\("),
    ("class_declaration", r"(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
    ("lexical_declaration", r"(?:export\s+)?(?:const|let)\s+(?P<name>[\w$]+)[^=;\n]*="),
    ("variable_declaration", r"(?:export\s+)?var\s+(?P<name>[\w$]+)[^=;\n]*="),
]
#: Per language: (node type, header at the beginning of a statement), the first that matches counts.
HEADERS = {
    "javascript": _SCRIPT,
    "typescript": [
        *_SCRIPT, ("interface_declaration", r"(?:export\s+)?interface\s+(?P<name>[\w$]+)"), ("enum_declaration", r"(?:export\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)"),
        ("type_alias_declaration", r"(?:export\s+)?type\s+(?P<name>[\w$]+)[^=;\n]*="),
    ],
    "java": [
        ("class_declaration", r"(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract)\s+)*class\s+(?P<name>\w+)"),
        ("interface_declaration", r"(?:(?:public|private|protected|static|abstract)\s+)*interface\s+(?P<name>\w+)"),
    ],
    "go": [
        ("function_declaration", r"func\s+(?P<name>\w+)\s*[\[(]"), ("method_declaration", r"func\s*\([^)]*\)\s*(?P<name>\w+)\s*\("),
        ("type_declaration", r"type\s+(?P<name>\w+)"),
    ],
    "rust": [
        ("function_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+(?P<name>\w+)"), ("struct_item", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"),
        ("enum_item", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("trait_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"), ("impl_item", r"(?:unsafe\s+)?impl\b[^{;]*?(?P<name>\w+)\s*(?:<[^{;]*>)?\s*(?=\{)"),
    ],
    "cpp": [("class_specifier", r"class\s+(?P<name>\w+)[^;{(]*(?=\{)"), ("struct_specifier", r"struct\s+(?P<name>\w+)[^;{(]*(?=\{)")],
    "c": [("struct_specifier", r"struct\s+(?P<name>\w+)\s*(?=\{)")],
}
_METHOD = {
    "java": ("method_declaration", r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^<>]*>\s*)?[\w.<>\[\], ?]+?\s+(?P<name>\w+)\s*\("),
    "javascript": ("method_definition", r"(?!(?:if|for|while|switch|catch|return|function)\b)(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*\*?\s*(?P<name>[#\w$]+)\s*(?:<[^<>{}]*>)?\("),
    "cpp": ("function_definition", r"(?!(?:if|for|while|switch|return|else|do|catch)\b|(?:public|private|protected)\s*:)(?:template\s*<[^{;]*?>\s*)?[\w:<>,*&\s~]*?(?P<name>~?\w+)\s*\("),
}
_METHOD["typescript"], _METHOD["c"] = _METHOD["javascript"], _METHOD["cpp"]
_CLASSES = ("class_declaration", "class_specifier", "struct_specifier", "interface_declaration")
_OPEN = re.compile(r"[{;]")
#: An arrow function outside a declaration, up to its body's brace.
_ARROW = re.compile(r"(?:\basync\s*)?(?:\([^()]*\)|(?P<name>[\w$]+))\s*=>\s*(?=\Z|$)")


def _blank(code: str, lang: str) -> str:
    hide = _HIDE if lang == "rust" else _HIDE_QUOTES
    return hide.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), code)


def _close(text: str, at: int) -> int:
    """The offset behind the brace that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return -1


def _body(text: str, at: int) -> tuple[int, int]:
    """(offset of the body's brace or -1, end of the definition) for a header that ends at ``at``."""
    depth = 0
    for m in re.compile(r"[(){};\[\]]").finditer(text, at):
        c = m.group()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and c == "{":
            return m.start(), _close(text, m.start())
        elif depth <= 0 and c == ";":
            return -1, m.end()
    return -1, len(text)


def _braced(code: str, lang: str) -> list[Chunk]:
    text = _blank(code, lang)
    out: list[Chunk] = []
    headers = [(kind, re.compile(p)) for kind, p in HEADERS[lang]]
    method = [(kind, re.compile(p)) for kind, p in [_METHOD[lang]]] if lang in _METHOD else []
    start_of_statement = re.compile(r"(?:^|(?<=[{};\n]))[ \t\r\n]*(?=\S)")

    def visit(a: int, b: int, inside: bool) -> None:
        at = a
        while at < b:
            m = start_of_statement.search(text, at, b)
            if m is None:
                return
            at = m.end()
            found = None
            options = headers + (method if inside or lang in ("c", "cpp") else [])
            for kind, pattern in options:
                h = pattern.match(text, at, b)
                if h is not None:
                    found = kind, h
                    break
            if found is None:
                nxt = re.compile(r"[{;\n]").search(text, at, b)
                if nxt is None:
                    return
                arrow = _ARROW.search(text, at, nxt.start()) if nxt.group() == "{" and lang in ("javascript", "typescript") else None
                if arrow is not None and (end := _close(text, nxt.start())) > 0:
                    if len(code[arrow.start() : end].strip()) >= SMALLEST:
                        out.append(Chunk(code.count("\n", 0, arrow.start()) + 1, code.count("\n", 0, end - 1) + 1, "arrow_function", arrow.group("name") or "unknown", None))
                    at = end
                elif nxt.group() == "{":
                    end = _close(text, nxt.start())
                    at = end if end > 0 else nxt.end()
                else:
                    at = nxt.end()
                continue
            kind, h = found
            brace, end = _body(text, h.end() - (text[h.end() - 1] in "(["))
            if lang == "go" and brace < 0 or kind in ("lexical_declaration", "variable_declaration", "type_alias_declaration") and brace < 0 and end == len(text):
                end = text.find("\n", h.end())
                end = len(text) if end < 0 else end
            if end < 0 or kind in ("method_definition", "method_declaration", "function_definition") and lang != "go" and brace < 0:
                at = h.end()
                continue
            if kind in ("lexical_declaration", "variable_declaration") and text[end : end + 1] == ";":
                end += 1
            if len(code[at:end].strip()) >= SMALLEST:
                out.append(Chunk(code.count("\n", 0, at) + 1, code.count("\n", 0, end - 1) + 1, kind, h.group("name"), _comment_above(code, at)))
            if kind in _CLASSES and brace >= 0:
                visit(brace + 1, end - 1, True)
            at = end

    visit(0, len(text), False)
    return out


def _comment_above(code: str, at: int) -> str | None:
    before = code[:at].rstrip(" \t\n\r")
    if not before.endswith("*/"):
        return None
    start = before.rfind("/**")
    return before[start:].strip("/* \t\n") or None if start >= 0 and "*/" not in before[start:-2] else None


def chunk_code(code: str, lang: str) -> list[Chunk]:
    """Definitions by position, then the windows of the gaps between them."""
    code = code.replace("\r\n", "\n").replace("\r", "\n")
    try:
        found = _python(code) if lang == "python" else _braced(code, lang) if lang in HEADERS else []
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        found = []
    lines = code.split("\n")
    spans: list[list[int]] = []
    for c in sorted(found):
        if spans and c.start_line <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], c.end_line)
        else:
            spans.append([c.start_line, c.end_line])
    at, gaps = 1, []
    for a, b in [*spans, [len(lines) + 1, len(lines) + 1]]:
        gaps += [(s, min(s + WINDOW - 1, a - 1)) for s in range(at, a, WINDOW)]
        at = b + 1
    return found + [Chunk(a, b, "gap_window", "top-level", None) for a, b in gaps if "".join(lines[a - 1 : b]).strip()]


def chunk_files(files: DataFrame) -> DataFrame:
    """Files (index_prefix, file, lang, code) to chunk records; markdown is one document chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["index_prefix", "file", "level", "start_line", "end_line", "type", "function_name", "docstring", "chunk_id", "content"]
        for pdf in batches:
            rows = []
            for prefix, file, lang, code in zip(pdf["index_prefix"], pdf["file"], pdf["lang"], pdf["code"]):
                if code is None:
                    continue
                lines = code.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                if lang == "markdown":
                    found = [Chunk(1, len(lines), "markdown", "", None)]
                else:
                    found = chunk_code(code, lang or "")
                for c in found:
                    cid = hashlib.sha256(f"{file}:{c.start_line}:{c.end_line}".encode()).hexdigest()[:16]
                    doc = lang == "markdown"
                    rows.append((
                        prefix, file, "document" if doc else "code_chunk", None if doc else c.start_line, None if doc else c.end_line, c.type,
                        None if doc else c.function_name, c.docstring, cid, "\n".join(lines[c.start_line - 1 : c.end_line]),
                    ))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("index_prefix", "file", "lang", "code").mapInPandas(
        run, "index_prefix string, file string, level string, start_line int, end_line int, type string, function_name string, docstring string, chunk_id string, content string"
    )
