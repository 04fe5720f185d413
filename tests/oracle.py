"""Compare a query with its SQL twin, as sets of rows with counts."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings source_files chunks function_metadata full_chunks"
    " index_vectors index_meta index_config eval_items mix_targets"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        elif not os.path.exists(path):
            continue
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of_spark(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    return sorted(rel.columns), Counter(tuple(plain(r[k]) for k in order) for r in rel.fetchall())


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Nothing if both agree, else what differs."""
    a_names, a = rows_of_spark(df)
    b_names, b = rows_of_sql(con, sql)
    out = [] if a_names == b_names else [f"columns {a_names} and {b_names}"]
    if a != b:
        out.append(f"rows {sum(a.values())} and {sum(b.values())}; only Spark {list((a - b).items())[:2]}; only SQL {list((b - a).items())[:2]}")
    return out
