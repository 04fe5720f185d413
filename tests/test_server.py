"""The tool server, token counts and refinement."""

import io
import json
import os

import pytest

from corvane import tokens
from corvane.engine import UNRELATED, ContextEngine
from corvane.operators.chunking import chunk_code
from corvane.server import index_of, serve

from .test_engine import Odd


def test_server_answers_a_session():
    def ask(question, root, limit):
        if root == "bad":
            raise ValueError("boom é")
        return f"{question} {root} {limit}"

    call = lambda n, **a: {"jsonrpc": "2.0", "id": n, "method": "tools/call", "params": {"name": "query", "arguments": a}}
    sent = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        call(3, query_text="q", project_location="/p"), call(4, query_text="q", project_location="bad", token_limit=7), call(5, query_text="q"), {"jsonrpc": "2.0", "id": 6, "method": "x"}, [],
    ]
    out = io.StringIO()
    serve(ask, io.StringIO("\n".join([*map(json.dumps, sent), "", "{"])), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, None, None]
    assert got[1]["result"]["tools"][0]["name"] == "query" and got[2]["result"]["content"][0]["text"] == "q /p 15000"
    assert got[3]["result"] == {"content": [{"type": "text", "text": "Error during query: boom "}], "isError": True}
    assert [g["error"]["code"] for g in got[4:]] == [-32602, -32601, -32600, -32700]
    assert len(os.path.basename(index_of("/p", "/x"))) == 16


@pytest.mark.skipif(tokens.encoding(tokens.VOCABULARY) is None, reason="no vocabulary")
def test_tokens_agree_with_another_encoder(spark):
    other = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    texts = ["", "a", "def f(x):\n    return x ** 2\n", "Ünïcode — ≠ 漢字 🙂", " " * 50 + "\t\n\n x", "it's 12345 o'clock"]
    expected = [len(other.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [tokens.count(t) for t in texts] == expected
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    assert [r.n for r in df.select("k", tokens.token_count(df.t).alias("n")).orderBy("k").collect()] == [*expected, None]
    assert tokens.first_tokens("one two three", 2) == ("one two", True) and tokens.first_tokens("one", 2) == ("one", False)
    assert tokens.count("abcde", "/nowhere") == 2 and tokens.first_tokens("abcdefghi", 2, "/nowhere") == ("abcdefgh", True)


def test_refinement(spark, tmp_path):
    chunk = {"level": "code_chunk", "file": "a.py", "folder": None, "start_line": 1, "end_line": 2, "chunk_id": "c", "text": "t", "content": "code " * 400}
    made = ContextEngine(spark, str(tmp_path), provider=Odd("  what it says \n"))
    assert made._refined("q", [chunk, chunk | {"file": "b.py"}], 15_000).startswith("what it says\n\n### a.py")
    assert made._refined("q", [chunk], 5) == "what it says"
    assert made._refined("q", [], 5) == UNRELATED
    failed = ContextEngine(spark, str(tmp_path), provider=Odd(OSError()))
    assert failed._refined("q", [chunk], 5).startswith("### a.py")  # all sections, no budget


def test_arrow_functions_outside_declarations_are_chunked():
    code = "app.get('/x', async (req, res) => {\n  res.send(await find(req));\n});\nconst twice = (x) => {\n  return x + x + 1;\n};\n"
    assert [(c.type, c.start_line, c.end_line) for c in chunk_code(code, "javascript") if c.type] [:2] == [("arrow_function", 1, 3), ("lexical_declaration", 4, 6)]


def test_interview_keeps_defaults_and_asks_again():
    from corvane.config import Config, interview

    answers = iter(["", ""])
    assert interview(lambda _: next(answers), lambda _: None) == Config()
    answers = iter(["x", "http", "", "http://m", "k", "n", "y", "gen", "out", "", "", "soon", "60", "chat-1", "", "n"])
    c = interview(lambda _: next(answers), lambda _: None)
    assert (c.provider, c.api_base, c.api_key, c.ignored_dirs, c.ttl_seconds, c.chat_model, c.embedding_model) == ("http", "http://m", "k", ["gen", "out"], 60, "chat-1", None)


def test_side_store(spark, tmp_path):
    from corvane.sources import side_store as S

    rows = [("a", ".py", "x = 1\r\né"), ("a", ".py", "w"), ("b", None, "t"), (None, ".py", "z"), ("c", ".py", None)]
    S.save_full_code(spark.createDataFrame(rows, "chunk_id string, ext string, content string"), str(tmp_path))
    assert S.load_full_code(str(tmp_path), "a", [".js", ".py"]) == "x = 1\r\n" and S.load_full_code(str(tmp_path), "b", [".py"]) == "t"
    assert S.load_full_code(str(tmp_path), "c", [".py"]) == "[Chunk c not found]"
    assert S.load_metadata(str(tmp_path)) == {}
    S.save_metadata({"a": {"n": 1}}, str(tmp_path))
    assert S.load_metadata(str(tmp_path)) == {"a": {"n": 1}}
