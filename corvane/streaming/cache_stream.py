"""The result cache fed by a stream: sets are upserted per micro-batch, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.changes import VersionedTable


def ingest(sets: DataFrame, output: VersionedTable, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Append every micro-batch of a stream to a versioned table once.

    The query's id and the batch number are part of the commit, so a replayed batch is skipped; a query with a new
    checkpoint folder has a new id and numbers of its own.
    """

    def batch(df: DataFrame, number: int) -> None:
        source = f"{name}:{df.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}"
        if output.manifest().processed.get(source, -1) < number:
            output.append(df, {source: number})

    return sets.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(entries: DataFrame) -> DataFrame:
    """The last set of every key."""
    return entries.groupBy("key").agg(F.max_by(F.struct("value", "set_at"), F.col("set_at")).alias("e")).select("key", "e.value", "e.set_at")
