"""Problem 7: source files that do not parse.

Every scanned text is parsed where it is read, by the recursive-descent parsers of
:mod:`corvane.llm.syntax`; only verdicts are shuffled, to keep each file's current
version.  A text that occurs again in a batch is parsed once.

Defined results: null code or a language without a parser gives no verdict (``valid``
null) and never counts as invalid; an empty file is valid in every language but Go
(which needs ``package``; an empty Go file is not flagged either, for it declares
nothing wrong); a text nested too deep to parse has no verdict unless an error was
found all the same; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .current import newest
from .syntax import check

VERDICT = T.StructType([
    T.StructField("valid", T.BooleanType()), T.StructField("n_errors", T.IntegerType()), T.StructField("line", T.IntegerType()),
    T.StructField("cause", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType())),
])
_NONE = {"valid": None, "n_errors": None, "line": None, "cause": None, "errors": None}


@F.pandas_udf(VERDICT)
def _verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for code, lang in batches:
        seen: dict[tuple[str, str], dict] = {}
        out = []
        for c, lg in zip(code, lang):
            if c is None or lg is None:
                out.append(_NONE)
                continue
            v = seen.get((lg, c))
            if v is None:
                got = check(c, lg) if c.strip() or lg != "go" else None
                v = seen[lg, c] = _NONE if got is None else got._asdict()
            out.append(v)
        yield pd.DataFrame(out, columns=list(_NONE)).astype(object).where(lambda d: d.notna(), None)


def parsed_files(files: DataFrame) -> DataFrame:
    """The current version of every file with its verdict."""
    judged = files.select(
        "index_prefix", "file_path", "repo_path", "lang", "scanned_at", "sha256",
        _verdicts("code", F.lower(F.trim("lang"))).alias("verdict"),
    )
    return newest(judged, "repo_path", "lang", "verdict").select(
        "index_prefix", "file_path", "repo_path", "lang", "verdict.*"
    )


def invalid_files(files: DataFrame) -> DataFrame:
    """Current files that are not valid in their language, with all errors and the first cause."""
    return parsed_files(files).where("not valid").drop("valid")


def validity_rates(files: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid ones and the share accepted."""
    return (
        parsed_files(files).groupBy("repo_path", "lang")
        .agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), F.count("valid").alias("n_judged"))
        .withColumn("accepted", F.when(F.col("n_judged") > 0, F.round(1 - F.col("n_invalid") / F.col("n_judged"), 6)))
    )


def extracted_nodes(files: DataFrame, functions: DataFrame) -> DataFrame:
    """What was still extracted from invalid files: node types per language and validity."""
    v = parsed_files(files).select("index_prefix", "file_path", "lang", "valid")
    f = functions.select("index_prefix", "file_path", "chunk_id", "node_type").distinct()
    return (
        f.join(v, ["index_prefix", "file_path"]).groupBy("lang", "valid", "node_type")
        .agg(F.count("*").alias("n_chunks"), F.countDistinct("index_prefix", "file_path").alias("n_files"))
    )
