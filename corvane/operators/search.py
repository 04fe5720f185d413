"""Exact vector search: one query against the index, or a stated set of queries in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import dot, norm, unit

THRESHOLD = 0.3
TOP_K = 20
BLOCK = 512


def usable(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """Vectors of the right length without nulls, NaN or infinity and not zero."""
    top, low = F.array_max("embedding"), F.array_min("embedding")  # NaN counts as the greatest
    return vectors.where((F.size("embedding") == dim) & (F.size(F.array_compact("embedding")) == dim)).where(
        ~F.isnan(top) & (top < float("inf")) & (low > float("-inf")) & ((top > 0) | (low < 0))
    )


def top_k(vectors: DataFrame, query: DataFrame, k: int = TOP_K, key: str = "vec_id") -> DataFrame:
    """The k best rows by cosine for a one-row query ``(q array<double>)`` of length one, by score rounded to 6 places, then key."""
    rows = usable(vectors).select(key, "embedding").crossJoin(F.broadcast(query.limit(1)))
    scored = rows.select(key, (dot(F.col("embedding"), F.col("q")) / norm(F.col("embedding"))).alias("raw"))
    return scored.orderBy(F.desc(F.round("raw", 6)), key).limit(k)


def above(ranked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows strictly over the threshold; applied after the limit, on unrounded scores."""
    return ranked.where(F.col("raw") > threshold)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", dim: int = 64) -> DataFrame:
    """(query_id, vec_id, score, rank) for a stated query set ``(query_id, q)`` against all rows.

    Queries are broadcast in blocks of ``BLOCK``; each Arrow batch of the index is scored by one
    matrix product and reduced to k rows per query before anything is shuffled.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK))
    rows = usable(vectors, dim).select(F.col(key).alias("vec_id"), "embedding")
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = part.select("query_id", "q").toPandas()  # a block of the stated query set
        q = np.stack(got["q"].to_numpy()).astype(np.float64).reshape(-1, dim) if len(got) else np.empty((0, dim))
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((got["query_id"].to_numpy(), q))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for pdf in batches:
                if not len(pdf) or not len(q):
                    continue
                v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                keys = pdf["vec_id"].to_numpy()
                order = np.argsort(keys, kind="stable")
                s = np.round(q @ v[order].T, 6)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(ids, top.shape[1]), "vec_id": keys[order][top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

        hits = rows.mapInPandas(run, "query_id long, vec_id long, score double")
        out = hits if out is None else out.unionByName(hits)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class FlatIndex:
    """An exact inner-product index: unit vectors in a folder of parquet files, written once and read by any number of searches."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id"):
        self.spark, self.path, self.key = spark, path, key

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "vec_id", dim: int = 64) -> FlatIndex:
        """Normalise the usable vectors and write them; an index that is there already is an error."""
        usable(vectors, dim).select(key, unit(F.col("embedding")).alias("embedding")).write.parquet(path)
        return cls(vectors.sparkSession, path, key)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def dim(self) -> int | None:
        """The vectors' length; None for an empty index."""
        first = self.rows().select(F.size("embedding").alias("n")).first()
        return None if first is None else first.n

    def search(self, query: DataFrame, k: int = TOP_K) -> DataFrame:
        """(key, raw): the k best for a one-row query ``(q array<double>)`` of length one."""
        rows = self.rows().crossJoin(F.broadcast(query.limit(1)))
        return rows.select(self.key, dot(F.col("embedding"), F.col("q")).alias("raw")).orderBy(F.desc(F.round("raw", 6)), self.key).limit(k)
