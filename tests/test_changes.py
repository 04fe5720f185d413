"""Versioned tables, their differences and exactly-once processing."""

import datetime as dt
import uuid

import pytest

from corvane.operators.changes import VersionedTable, changed_files, process_new


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_difference_has_appends_deletes_and_survives_compaction(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    v1 = t.append(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, x string"))
    v2 = t.append(spark.createDataFrame([(4, "d")], "id long, x string"))
    v3 = t.delete("id = 2")
    assert rows(t.read(), "id") == [(1,), (3,), (4,)]
    assert rows(t.read(v1), "id") == [(1,), (2,), (3,)]
    assert rows(t.difference(v1, v3), "id", "_change") == [(2, "delete"), (4, "insert")]
    v4 = t.delete("id = 3")
    assert rows(t.difference(v3, v4), "id", "_change") == [(3, "delete")]
    assert rows(t.difference(v4, v2), "id", "_change") == [(2, "insert"), (3, "insert")]
    v5 = t.compact()
    assert rows(t.read(), "id") == [(1,), (4,)]
    assert t.difference(v4, v5).count() == 0  # compaction is no change
    t.append(spark.createDataFrame([(6, "f")], "id long, x string"))
    v7 = t.delete("id in (1, 6)")
    assert rows(t.difference(v3, v7), "id", "_change") == [(1, "delete"), (3, "delete")]
    v8 = t.sync(spark.createDataFrame([(4, "d"), (9, "n"), (None, "z")], "id long, x string"), ["id"])
    assert rows(t.difference(v7, v8), "x", "_change") == [("n", "insert"), ("z", "insert")]
    v9 = t.sync(spark.createDataFrame([(None, "z")], "id long, x string"), ["id"])
    assert rows(t.difference(v8, v9), "id", "_change") == [(4, "delete"), (9, "delete")] and rows(t.read(), "x") == [("z",)]


def test_overlapping_runs_commit_once_and_deletes_are_followed(spark, tmp_path):
    source, out = VersionedTable(spark, str(tmp_path / "s")), VersionedTable(spark, str(tmp_path / "o"))
    source.append(spark.createDataFrame([(k % 4,) for k in range(5)], "id long"))

    def slow(df):
        process_new(source, out, lambda d: d)  # another run is faster
        return df

    with pytest.raises(RuntimeError):
        process_new(source, out, slow)
    assert out.read().count() == 5
    source.delete("id = 0")  # two equal rows
    source.compact()
    process_new(source, out, lambda d: d.withColumn("extra", d.id))
    assert rows(out.read(), "id") == [(1,), (2,), (3,)]
    source.delete("id = 1")
    with pytest.raises(ValueError):
        process_new(source, out, lambda d: d.select("id"))
    process_new(source, out, lambda d: d)
    assert rows(out.read(), "id") == [(2,), (3,)]


def test_a_manifest_cut_off_while_written_blocks_until_recovered(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(spark.createDataFrame([(1,)], "id long"))
    (tmp_path / "t" / "_manifests" / "v000000000002.json").write_text('{"version"')
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(2,)], "id long"))
    assert t.recover() and not t.recover()
    t.append(spark.createDataFrame([(2,)], "id long"))
    assert rows(t.read(), "id") == [(1,), (2,)]


def test_every_record_is_processed_once_whatever_fails(spark, tmp_path):
    source, out = VersionedTable(spark, str(tmp_path / "s")), VersionedTable(spark, str(tmp_path / "o"))
    source.append(spark.createDataFrame([(1,), (2,)], "id long"))
    assert process_new(source, out, lambda d: d) == 1
    assert process_new(source, out, lambda d: d) is None
    source.append(spark.createDataFrame([(3,)], "id long"))

    def broken(d):
        raise RuntimeError("lost")

    for _ in range(2):
        with pytest.raises(RuntimeError):
            process_new(source, out, broken)
    source.append(spark.createDataFrame([(4,)], "id long"))
    process_new(source, out, lambda d: d)
    assert rows(out.read(), "id") == [(1,), (2,), (3,), (4,)]


def test_two_writers_do_not_make_one_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(spark.createDataFrame([(1,)], "id long"))
    m = t.manifest()
    t.append(spark.createDataFrame([(2,)], "id long"))
    with pytest.raises(RuntimeError):
        t.commit(m)
    assert rows(t.read(), "id") == [(1,), (2,)]


FILES = "index_prefix string, file_path string, scanned_at timestamp_ntz, sha256 string, extra string"
RUNS = "index_prefix string, run_no int, run_status string, finished_at timestamp_ntz, file_hashes map<string,string>"


def test_changed_files(spark):
    t = dt.datetime(2025, 1, 1)
    files = spark.createDataFrame(
        [
            ("i", "a/x.py", t, "AA", None), ("i", "a/x.py", t - dt.timedelta(1), "old", None), ("i", "b.py", t, "bb", None), ("i", "b.py", t, "bb", None),
            ("i", "new.py", t, "cc", None), ("i", "build/z.py", t, "dd", None), ("j", "q.py", t, "ee", None), ("k", "q.py", t, "ee", None), ("i", "moved.py", t, "m1", None),
            ("i", None, t, "x", None), (None, "p", t, "x", None), ("i", "nohash.py", None, None, None),
        ],
        FILES,
    )
    runs = spark.createDataFrame(
        [
            ("i", 1, "success", t, {"new.py": "cc"}), ("i", 2, "success", t, {".\\a\\x.py": "aa", "./b.py": "BB", "gone.py": "1", "was.py": "m1"}),
            ("i", 2, "success", t, {".\\a\\x.py": "aa", "./b.py": "BB", "gone.py": "1", "was.py": "m1"}), ("i", 3, "failed", t, {"new.py": "cc"}), ("i", 4, None, None, None),
            ("j", 1, "success", t, {"q.py": "ee"}), ("j", 2, "success", t, None),
        ],
        RUNS,
    )
    config = spark.createDataFrame([(["build"],)], "ignored_dirs array<string>")
    got = rows(changed_files(files, runs, config), "index_prefix", "file_path")
    assert got == [("i", "moved.py"), ("i", "new.py"), ("i", "nohash.py"), ("j", "q.py"), ("k", "q.py")]
    assert changed_files(files.limit(0), runs, config).count() == 0
    assert changed_files(files, runs.limit(0), config.limit(0)).count() == 9 - 1


def test_stream_batches_are_committed_once(spark, tmp_path):
    from corvane.streaming.cache_stream import ingest, newest

    src = str(tmp_path / "in")
    spark.createDataFrame([("k", "v1", 1), ("k", "v2", 2)], "key string, value string, set_at long").coalesce(1).write.parquet(src)
    out = VersionedTable(spark, str(tmp_path / "out" / uuid.uuid4().hex))
    for _ in range(2):
        q = ingest(spark.readStream.schema("key string, value string, set_at long").parquet(src), out, str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert rows(newest(out.read()), "key", "value") == [("k", "v2")]
    assert out.read().count() == 2
