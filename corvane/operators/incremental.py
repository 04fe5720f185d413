"""Incremental maintenance of an index: difference, retention, upsert and combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import after_first_line

KEYS = ["index_prefix", "file"]


def classified(old: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every file as added, deleted, modified or unchanged, by hash; one full join."""
    o = old.select(*keys, F.col("hash").alias("old_hash"), F.lit(True).alias("was"))
    n = new.select(*keys, F.col("hash").alias("new_hash"), F.lit(True).alias("is"))
    status = (
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    )
    return o.join(n, keys, "full").select(*keys, status.alias("status"))


def kept_chunks(chunks: DataFrame, diff: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Chunks of files that did not change or vanish; folder summaries are always made anew."""
    gone = diff.where(F.col("status").isin("modified", "deleted")).select(*keys)
    return chunks.where("level <> 'folder_summary'").join(gone, keys, "left_anti")


def kept_summaries(kept: DataFrame) -> DataFrame:
    """File summaries recovered from kept chunks: the text behind the first line."""
    return kept.where("level = 'file_summary'").select(*KEYS, after_first_line(F.col("text")).alias("summary"))


def merged_summaries(kept: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Kept summaries overlaid by new ones."""
    return new.unionByName(kept.join(new.select(*keys).distinct(), keys, "left_anti"))


def combined(*parts: DataFrame) -> DataFrame:
    """The new index: all parts under one schema, absent columns null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def needs_embedding(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks whose position has no usable vector yet."""
    return chunks.join(vectors.select(F.col("vec_id").alias("position")), "position", "left_anti")
