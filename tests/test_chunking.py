"""Chunk lists of hand-written sources, and coverage of lines by definitions and windows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators.chunking import WINDOW, chunk_code

PY = "import os\n\n@cached\ndef first(a, b):\n    \"\"\"Adds up.\"\"\"\n    return a + b\n\nclass Thing:\n    def method(self):\n        return 'x' * 30\n"
JS = "/** Says it. */\nexport function hello(a) {\n  return `{${a}}`;\n}\n\nexport class Box {\n  open(key) { return key + '}'; }\n}\nconst twice = (x) => {\n  return x * 2;\n};\n"
JAVA = "package a;\n\npublic class Box {\n    /** Opens. */\n    public int open(String key) {\n        return key.length();\n    }\n}\n"
GO = "package a\n\nfunc (s *Box) Open(key string) int {\n\treturn len(key)\n}\n\ntype Box struct {\n\tA int\n}\n"
RUST = "pub struct Box {\n    a: i64,\n}\n\nimpl Box {\n    fn open(&self) -> i64 { self.a }\n}\n\nfn free<'a>(x: &'a str) -> usize {\n    x.len()\n}\n"
CPP = "#include <map>\n\nclass Box {\npublic:\n    int open(int key) {\n        return key + 1;\n    }\n};\n\nint main(int n) {\n    return n;\n}\n"


def named(code, lang):
    return [(c.type, c.function_name, c.start_line, c.end_line) for c in chunk_code(code, lang) if c.type != "gap_window"]


@pytest.mark.parametrize(
    "code, lang, expected",
    [
        (PY, "python", [("decorated_definition", "first", 3, 6), ("class_definition", "Thing", 8, 10), ("function_definition", "method", 9, 10)]),
        (JS, "javascript", [("function_declaration", "hello", 2, 4), ("class_declaration", "Box", 6, 8), ("method_definition", "open", 7, 7), ("lexical_declaration", "twice", 9, 11)]),
        (JAVA, "java", [("class_declaration", "Box", 3, 8), ("method_declaration", "open", 5, 7)]),
        (GO, "go", [("method_declaration", "Open", 3, 5), ("type_declaration", "Box", 7, 9)]),
        (RUST, "rust", [("struct_item", "Box", 1, 3), ("impl_item", "Box", 5, 7), ("function_item", "free", 9, 11)]),
        (CPP, "cpp", [("class_specifier", "Box", 3, 8), ("function_definition", "open", 5, 7), ("function_definition", "main", 10, 12)]),
    ],
)
def test_definitions(code, lang, expected):
    assert named(code, lang) == expected
    assert named(code.replace("\n", "\r\n"), lang) == expected


def test_broken_python_gives_windows_only():
    assert {c.type for c in chunk_code("def f(:\n  pass\n" * 40, "python")} == {"gap_window"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["", "x = 1", "def f(a):", "    return a + 11111111", "class A:", "# c", "@d"]), max_size=140))
def test_lines_are_covered_once(lines):
    code = "\n".join(lines)
    chunks = chunk_code(code, "python")
    by_definition = {n for c in chunks if c.type != "gap_window" for n in range(c.start_line, c.end_line + 1)}
    windows = [n for c in chunks if c.type == "gap_window" for n in range(c.start_line, c.end_line + 1)]
    assert len(windows) == len(set(windows)) and not by_definition & set(windows)
    assert all(c.end_line - c.start_line < WINDOW for c in chunks if c.type == "gap_window")
    missing = set(range(1, len(lines) + 1)) - by_definition - set(windows)
    assert all(not lines[n - 1].strip() for n in missing)
