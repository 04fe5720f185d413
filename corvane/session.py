"""Session helpers shared by every operator: sessions, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
"""Most rows that :func:`small` broadcasts (callers pass narrow rows: 200,000 x 100 B = 20 MB)."""


def session(app: str = "corvane", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, Arrow)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a local one is set only where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        current = named or os.path.join(tempfile.gettempdir(), f"corvane-checkpoints-{os.getuid()}")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and continue from there.

    The files outlive any executor, so a lost executor costs no recomputation of
    what lies before the cut.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it is proven to have at most ``max_rows`` rows, else leave it to a shuffle join.

    The proof is a ``limit(max_rows + 1)`` count, so at most that many rows are looked at per partition.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
