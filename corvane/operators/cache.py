"""The result cache as keyed state with a time to live, in bulk and point form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL = 86_400


def latest(entries: DataFrame, tie: str) -> DataFrame:
    """The last set of every key: (key, value, expires_at)."""
    return entries.groupBy("key").agg(F.max_by(F.struct("value", "expires_at"), F.struct("set_at", tie)).alias("e")).select("key", "e.value", "e.expires_at")


def live(entries: DataFrame, now: Column) -> DataFrame:
    """Entries not expired at ``now``: valid while ``now <= expires_at``."""
    return entries.where(F.col("expires_at") >= now)


def as_of(ops: DataFrame, ttl: int = TTL) -> DataFrame:
    """Every get with the value it sees: the last set of its key before it, unless expired.

    ``ops``: (key, at_s, seq, is_set, value).  One window per key, no join.
    """
    w = Window.partitionBy("key").orderBy("at_s", "seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = ops.withColumn("last", F.last(F.when(F.col("is_set"), F.struct("at_s", "value", "seq")), ignorenulls=True).over(w))
    return seen.where(~F.col("is_set")).select(
        "key", "at_s", "seq", F.when(F.col("at_s") <= F.col("last.at_s") + ttl, F.col("last.value")).alias("value"), F.col("last.seq").alias("set_seq")
    )


def context_key(query: Column, texts: Column) -> Column:
    """The key of a query's context: its text and the first 100 characters of the five best texts."""
    heads = F.transform(F.slice(texts, 1, 5), lambda t: F.substring(t, 1, 100))
    return F.concat(F.lit("context_cache:"), F.sha2(F.concat(query, F.array_join(heads, "|")), 256))
