"""Only new or changed records: manifests of immutable table versions, their differences, and exactly-once processing.

A :class:`VersionedTable` is a folder of immutable parquet files and one small manifest
per version.  A manifest lists the live files, the deletion vectors that hide rows of
them, and what the version's writer had processed (``processed``: source name to
version).  A manifest is created exclusively and is never replaced: of two writers that start
from one version the second fails.  Whatever a failed run leaves behind is in no manifest and is never read.
Every row has an id of its own that compaction keeps.

The difference of two versions needs only their manifests: rows of files that were added,
rows of files that were removed, and rows that a deletion vector of only one side hides.  Files
in both are not read but for such rows, and compaction is no change.  :func:`process_new` hands what was
added to a function, commits its output together with the version it has now processed, and hides
output rows whose source rows were deleted: after a crash the next run starts from the last
commit and neither skips nor repeats a record, and of overlapping runs one commits.

:func:`changed_files` is that difference for the scanned files of an index: the manifest of its
last successful run is one version of a table of file entries, the current scan is
synchronised into the next one.

Defined results: null keys equal each other; repeated rows are records of their own, hidden and
restored one by one; an empty source has an empty difference; columns named ``_file``, ``_row``, ``_rid``,
``_from`` or ``_change`` are the table's own and replaced where a frame brings them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import cut_lineage, ensure_checkpoint_dir

FILE, ROW = "_file", "_row"
RID, FROM = "_rid", "_from"
"""A row's own id, and that of the source row it was made from."""


@dataclass
class Manifest:
    """One immutable version: live files, deletion vectors (data file to folders of vectors), what was processed, whether it only rewrites."""

    version: int
    files: list[str] = field(default_factory=list)
    deletions: dict[str, list[str]] = field(default_factory=dict)
    processed: dict[str, int] = field(default_factory=dict)
    schema: str | None = None
    compacted: bool = False


class VersionedTable:
    """A folder of parquet files under versioned manifests, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/_manifests"))

    # manifests
    def latest(self) -> int:
        """The newest version, 0 if there is none."""
        found = self._fs.listStatus(self._Path(f"{self.path}/_manifests"))
        names = [s.getPath().getName() for s in found]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.latest() if version is None else version
        if version == 0:
            return Manifest(0)
        stream = self._fs.open(self._Path(f"{self.path}/_manifests/v{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def commit(self, m: Manifest) -> int:
        """Publish ``m`` as the version after the one it was read as; fails if that version exists, complete or not."""
        target = self._Path(f"{self.path}/_manifests/v{m.version + 1:012d}.json")
        try:
            out = self._fs.create(target, False)  # exclusive: no writer can replace another's version
        except Exception as e:
            raise RuntimeError(f"version {m.version + 1} was committed by another writer") from e
        out.write(bytearray(json.dumps(m.__dict__ | {"version": m.version + 1}).encode()))
        out.close()
        m.version += 1
        return m.version

    def recover(self) -> bool:
        """Remove the newest manifest if its writer died while writing it; to be called when no writer runs."""
        version = self.latest()
        if not version:
            return False
        try:
            self.manifest(version)
            return False
        except ValueError:
            return bool(self._fs.delete(self._Path(f"{self.path}/_manifests/v{version:012d}.json"), False))

    # writing
    def _write(self, df: DataFrame, kind: str) -> list[str]:
        folder = f"{kind}/{uuid.uuid4().hex}"
        if kind == "data":
            if RID not in df.columns:
                df = df.withColumn(RID, F.concat(F.lit(folder[-32:-20] + ":"), F.monotonically_increasing_id().cast("string")))
            df = df if FROM in df.columns else df.withColumn(FROM, F.lit(None).cast("string"))
        df.write.parquet(f"{self.path}/{folder}")
        found = self._fs.listStatus(self._Path(f"{self.path}/{folder}"))
        return sorted(f"{folder}/{s.getPath().getName()}" for s in found if s.getPath().getName().endswith(".parquet"))

    def _add(self, m: Manifest, df: DataFrame) -> None:
        df = df.drop(FILE, ROW, "_change")
        m.files += self._write(df, "data")
        m.schema = m.schema or self._stored(df).json()
        m.compacted = False

    @staticmethod
    def _stored(df: DataFrame) -> T.StructType:
        return T.StructType([*[f for f in df.schema.fields if f.name not in (RID, FROM)], T.StructField(RID, T.StringType()), T.StructField(FROM, T.StringType())])

    def _hide(self, m: Manifest, gone: DataFrame) -> None:
        """Put rows (file, row) into a new folder of vectors: one job, whatever the number of files."""
        folder = f"deletions/{uuid.uuid4().hex}"
        gone.select(FILE, ROW).write.parquet(f"{self.path}/{folder}")
        touched = self.spark.read.schema("_file string, _row long").parquet(f"{self.path}/{folder}").select(FILE).distinct()
        for (name,) in touched.collect():  # as many as the manifest lists at most
            m.deletions[name] = [*m.deletions.get(name, []), folder]
        m.compacted = False

    def append(self, df: DataFrame, processed: dict[str, int] | None = None) -> int:
        """Add rows (and record what was processed) as a new version."""
        m = self.manifest()
        self._add(m, df.drop(RID, FROM))
        m.processed |= processed or {}
        return self.commit(m)

    def delete(self, condition: str | Column) -> int:
        """Hide the rows that meet ``condition`` by new deletion vectors; data files stay as they are."""
        m = self.manifest()
        self._hide(m, self._live(m, m.files).where(condition))
        return self.commit(m)

    def sync(self, df: DataFrame, key: list[str]) -> int:
        """Make the live rows those of ``df``: rows whose key it lacks are hidden, rows whose key is not live are added, the others stay untouched."""
        m = self.manifest()
        live = self._live(m, m.files).select(FILE, ROW, *[F.col(c).alias(f"_k{k}") for k, c in enumerate(key)])
        same = [F.col(f"_k{k}").eqNullSafe(F.col(c)) for k, c in enumerate(key)]
        changed = cut_lineage(live.join(df.withColumn("_there", F.lit(True)), same, "full_outer").where(F.col(FILE).isNull() | F.col("_there").isNull()))
        self._hide(m, changed.where("_there is null"))
        self._add(m, changed.where("_there").select(*df.columns))
        return self.commit(m)

    def compact(self) -> int:
        """Rewrite all live rows into new files without deletion vectors; rows keep their ids."""
        m = self.manifest()
        m.files, m.deletions, m.compacted = self._write(self._live(m, m.files).drop(FILE, ROW), "data"), {}, True
        return self.commit(m)

    # reading
    def _rows(self, files: list[str], schema: str | None) -> DataFrame:
        from pyspark.sql.types import StructType

        parsed = StructType.fromJson(json.loads(schema))
        if not files:
            empty = self.spark.createDataFrame([], parsed)
            return empty.withColumn(FILE, F.lit("")).withColumn(ROW, F.lit(0).cast("long"))
        df = self.spark.read.schema(parsed).parquet(*[f"{self.path}/{f}" for f in files])
        name = F.concat_ws("/", F.slice(F.split("_metadata.file_path", "/"), -3, 3))
        return df.select("*", name.alias(FILE), F.col("_metadata.row_index").alias(ROW))

    def _vectors(self, m: Manifest, files: list[str]) -> DataFrame:
        """The hidden rows (file, row) of some files."""
        wanted = [f for f in files if f in m.deletions]
        folders = sorted({d for f in wanted for d in m.deletions[f]})
        if not folders:
            return self.spark.createDataFrame([], "_file string, _row long")
        # a folder may hold vectors of files that are no longer live; they match no row
        return self.spark.read.schema("_file string, _row long").parquet(*[f"{self.path}/{d}" for d in folders]).distinct()

    def _live(self, m: Manifest, files: list[str]) -> DataFrame:
        rows = self._rows(files, m.schema)
        return rows.join(self._vectors(m, files), [FILE, ROW], "left_anti") if any(f in m.deletions for f in files) else rows

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows of a version."""
        m = self.manifest(version)
        if m.schema is None:
            raise ValueError("the table has no version with data")
        return self._live(m, m.files).drop(FILE, ROW, RID, FROM)

    def difference(self, old: int, new: int) -> DataFrame:
        """Records that differ between two versions, with their id ``_rid`` and ``_change`` = insert or delete."""
        if new < old:
            back = self.difference(new, old)
            return back.withColumn("_change", F.when(F.col("_change") == "insert", "delete").otherwise("insert"))
        ends, parts = old, []
        for version in range(old + 1, new + 1):  # what lies between compactions
            if self.manifest(version).compacted:
                parts += [self._step(ends, version - 1)] if version - 1 > ends else []
                ends = version
        parts += [self._step(ends, new)] if new > ends or not parts else []
        if len(parts) == 1:
            return parts[0]
        # a record that came and went is no change
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        twice = out.groupBy(RID).agg(F.min("_change").alias("lo"), F.max("_change").alias("hi")).where("lo <> hi").select(RID)
        return out.join(twice, RID, "left_anti")

    def _step(self, old: int, new: int) -> DataFrame:
        a, b = self.manifest(old), self.manifest(new)
        schema = b.schema or a.schema
        if schema is None:
            raise ValueError("the table has no version with data")
        a.schema = b.schema = schema
        was, now = set(a.files), set(b.files)
        both = [f for f in b.files if f in was and a.deletions.get(f) != b.deletions.get(f)]
        out = self._live(b, sorted(now - was)).withColumn("_change", F.lit("insert")).unionByName(
            self._live(a, sorted(was - now)).withColumn("_change", F.lit("delete"))
        )
        if both:
            rows, before, after = self._rows(both, schema), self._vectors(a, both), self._vectors(b, both)
            hidden = after.join(before, [FILE, ROW], "left_anti").withColumn("_change", F.lit("delete"))
            shown = before.join(after, [FILE, ROW], "left_anti").withColumn("_change", F.lit("insert"))
            out = out.unionByName(rows.join(hidden.unionByName(shown), [FILE, ROW]).select(*out.columns))
        return out.drop(FILE, ROW, FROM)


def process_new(source: VersionedTable, output: VersionedTable, step: Callable[[DataFrame], DataFrame], name: str = "source") -> int | None:
    """Run ``step`` over the records added to ``source`` since ``output`` last processed it; returns the output's new version.

    ``step`` may change, drop or multiply records but keeps their column ``_rid``; output rows of
    records deleted since are hidden in the same commit.  The commit is made on the very version of the output that
    was read at the start, so if another run was faster this one fails and has written nothing.
    Nothing new: no commit, None.
    """
    m = output.manifest()
    done, now = m.processed.get(name, 0), source.latest()
    if now == done:
        return None
    delta = source.difference(done, now)
    made = step(delta.where("_change = 'insert'").drop("_change"))
    gone = delta.where("_change = 'delete'").select(F.col(RID).alias(FROM)).distinct()
    followed = RID in made.columns
    if not followed and gone.take(1):
        raise ValueError(f"the step drops {RID}, so its output can't follow deleted records")
    if followed and m.files:
        live = output._live(m, m.files)
        output._hide(m, live.join(gone, FROM, "left_semi"))
    output._add(m, made.withColumnRenamed(RID, FROM) if followed else made)
    m.processed |= {name: now}
    return output.commit(m)


# --- scanned files of indexes --------------------------------------------------------------------

def plain_path(path: Column) -> Column:
    """One spelling of a relative path: forward slashes, no leading or inner current directory, no empty parts."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, r"/{2,}", "/")
    p = F.regexp_replace(p, r"(^|/)(?:\./)+", "$1")
    return F.trim(p)


def plain_hash(value: Column) -> Column:
    """One spelling of a hash."""
    return F.lower(F.trim(value))


def current_scan(files: DataFrame) -> DataFrame:
    """The newest version of every scanned file as (index_prefix, file_path, sha256); code is not read."""
    row = F.struct(F.col("scanned_at").isNotNull().alias("d"), "scanned_at", F.coalesce("sha256", F.lit("")).alias("sha256"))
    return (
        files.where("index_prefix is not null and file_path is not null")
        .groupBy("index_prefix", "file_path").agg(F.max(row)["sha256"].alias("sha256"))
    )


def last_manifest(runs: DataFrame) -> DataFrame:
    """(index_prefix, path, hash) of every index's last successful run."""
    last = (
        runs.where(F.col("run_status") == "success")
        .groupBy("index_prefix").agg(F.max_by(F.col("file_hashes"), F.struct("run_no", F.coalesce("finished_at", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))))).alias("file_hashes"))
    )
    return last.select("index_prefix", F.explode("file_hashes").alias("path", "hash")).select(
        "index_prefix", plain_path(F.col("path")).alias("path"), plain_hash(F.col("hash")).alias("hash")
    )


def scan_entries(files: DataFrame, config: DataFrame) -> DataFrame:
    """(index_prefix, path, hash, file_path) of every current file that is no part of an ignored directory."""
    ignored = config.select(F.explode("ignored_dirs").alias("d")).distinct().agg(F.collect_set("d").alias("ignored"))
    return (
        current_scan(files).withColumn("path", plain_path(F.col("file_path")))
        .crossJoin(F.broadcast(ignored))  # one row: the fixed list of names
        .where(~F.arrays_overlap(F.expr("slice(split(path, '/'), 1, size(split(path, '/')) - 1)"), F.coalesce("ignored", F.array().cast("array<string>"))))
        .select("index_prefix", "path", plain_hash(F.col("sha256")).alias("hash"), "file_path")
    )


def scan_versions(files: DataFrame, runs: DataFrame, config: DataFrame) -> tuple[VersionedTable, int, int]:
    """A table of file entries in the shared folder: one version as of the last successful runs, one as of the current scan."""
    spark = files.sparkSession
    entries = VersionedTable(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/entries-{uuid.uuid4().hex}")
    old = entries.append(last_manifest(runs).distinct().withColumn("file_path", F.lit(None).cast("string")))
    return entries, old, entries.sync(scan_entries(files, config), ["index_prefix", "path", "hash"])


def changed_files(files: DataFrame, runs: DataFrame, config: DataFrame) -> DataFrame:
    """(index_prefix, file_path) of current files that are new or changed since their index's last successful run.

    They are the records that the version of the current scan adds to the version of those runs.
    An index without one, or whose last has no hashes, has all its files come out.  Files
    below ignored directories never do.  Each file comes out once, whatever failed since.
    """
    entries, old, new = scan_versions(files, runs, config)
    return entries.difference(old, new).where("_change = 'insert'").select("index_prefix", "file_path")


def entry_delta(files: DataFrame, runs: DataFrame, config: DataFrame) -> DataFrame:
    """(index_prefix, change, n_entries): how many entries of an index the current scan adds and removes."""
    entries, old, new = scan_versions(files, runs, config)
    return entries.difference(old, new).groupBy("index_prefix", F.col("_change").alias("change")).agg(F.count("*").alias("n_entries"))


def processed_entries(files: DataFrame, runs: DataFrame, config: DataFrame) -> DataFrame:
    """(index_prefix, path, hash) of a table that followed both versions by :func:`process_new`: the current entries, each once."""
    entries, old, new = scan_versions(files, runs, config)
    output = VersionedTable(entries.spark, f"{entries.path}-output")
    m = output.manifest()
    output._add(m, entries.difference(0, old).withColumnRenamed(RID, FROM))
    m.processed["entries"] = old
    output.commit(m)
    process_new(entries, output, lambda df: df, "entries")
    return output.read().select("index_prefix", "path", "hash")
