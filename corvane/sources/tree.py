"""The file tree source: every regular file below a root, hidden names and empty files included.

``binaryFile`` drops names that begin with ``_`` or ``.`` (so every ``__init__.py``) and
empty files; this source lists the tree itself, prunes ignored directories while walking, and
reads bytes in parallel tasks.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "rel_path string, ext string, sha256 string, n_bytes long, mtime timestamp, code string"
FILES_PER_TASK = 256


def suffix(name: str) -> str:
    """The last suffix with its dot; names that begin with their only dot have none."""
    stem, dot, end = name.rpartition(".")
    return f".{end}" if dot and stem and end else ""


def decode(data: bytes) -> str:
    """UTF-8 with invalid bytes dropped and line ends made ``\\n``."""
    return data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path") or options["root"]
        part = lambda key: {x for x in options.get(key, "").split(",") if x}
        self.dirs, self.names, self.exts = part("ignoredDirs"), part("ignoredFiles"), part("extensions")
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        found = []
        for top, dirs, names in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in self.dirs)
            for name in sorted(names):
                if name not in self.names and (not self.exts or suffix(name) in self.exts):
                    found.append(os.path.relpath(os.path.join(top, name), self.root).replace(os.sep, "/"))
        return [_Part(found[k : k + FILES_PER_TASK]) for k in range(0, len(found), FILES_PER_TASK)] or [_Part([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime

        for rel in partition.paths:
            path = os.path.join(self.root, rel)
            try:
                with open(path, "rb") as f:
                    data = f.read()
                at = datetime.datetime.fromtimestamp(os.stat(path).st_mtime, datetime.timezone.utc)
            except OSError:  # vanished since it was listed
                continue
            yield rel, suffix(rel.rsplit("/", 1)[-1]), hashlib.sha256(data).hexdigest(), len(data), at, decode(data) if self.content else None


class SourceTree(DataSource):
    """``spark.read.format("source_tree")``; options: ignoredDirs, ignoredFiles, extensions (comma lists), content."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k: v for k, v in self.options.items()} | {"ignoredDirs": self.options.get("ignoredDirs", ""), "ignoredFiles": self.options.get("ignoredFiles", "")})


def read_tree(spark: SparkSession, root: str, ignored_dirs=(), ignored_files=(), extensions=(), content: bool = True) -> DataFrame:
    """The files below ``root``; executors must see the path."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(
        root=os.path.abspath(root), ignoredDirs=",".join(ignored_dirs), ignoredFiles=",".join(ignored_files), extensions=",".join(extensions), content=str(content).lower()
    ).load()
