"""Line-range algebra: union, complement, fixed windows, windows' text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import WHITE, line_array

WINDOW_LINES = 50


def merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Union of overlapping or adjacent ``[start_line, end_line]`` per key."""
    before = Window.partitionBy(*keys).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    r = ranges.select(*keys, "start_line", "end_line").distinct()
    r = r.withColumn("prev", F.max("end_line").over(before))
    r = r.withColumn("island", F.sum(F.when(F.col("prev").isNull() | (F.col("start_line") > F.col("prev") + 1), 1).otherwise(0)).over(upto))
    return r.groupBy(*keys, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def complement(ranges: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """The gaps of merged ranges within ``[1, total_lines]`` per key; keys without ranges are one gap."""
    stop = totals.select(*keys, (F.col("total_lines") + 1).alias("start_line"), (F.col("total_lines") + 1).alias("end_line"))
    inside = ranges.join(totals.select(*keys, "total_lines"), keys).where("start_line <= total_lines").select(*keys, "start_line", "end_line")
    before = Window.partitionBy(*keys).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    r = inside.unionByName(stop).withColumn("prev", F.coalesce(F.max("end_line").over(before), F.lit(0)))
    return r.select(*keys, (F.col("prev") + 1).alias("gap_start"), (F.col("start_line") - 1).alias("gap_end")).where("gap_start <= gap_end")


def windows(gaps: DataFrame, keys: list[str], size: int = WINDOW_LINES) -> DataFrame:
    """Gaps cut into windows of ``size`` lines, the last one short."""
    return gaps.select(*keys, "gap_end", F.explode(F.sequence("gap_start", "gap_end", F.lit(size))).alias("start_line")).select(
        *keys, "start_line", F.least(F.col("start_line") + size - 1, "gap_end").alias("end_line")
    )


def window_text(spans: DataFrame, texts: DataFrame, keys: list[str], text: str = "code") -> DataFrame:
    """The lines of each window joined by ``\\n``; blank windows vanish."""
    lines = texts.select(*keys, line_array(F.col(text)).alias("lines"))
    w = spans.join(lines, keys)
    w = w.withColumn("text", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    return w.where(F.length(F.regexp_replace("text", WHITE, "")) > 0).drop("lines")
