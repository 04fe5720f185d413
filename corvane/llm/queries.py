"""The queries of the training-data operators over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import table

from . import credentials, doc_pairs, invalid_files, leaks, lookalikes, mixing, neighbours, provenance, splitting


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf, "index_vectors"), 5, 0.85)


def p1_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "index_vectors"), 5).select("vec_id", "other", F.round("cosine", 4).alias("cosine"), "rank")


def p1_recall(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.recall(table(spark, sf, "index_vectors"), 5, 0.85)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.secret_lines(table(spark, sf, "chunks"), table(spark, sf, "full_chunks"))


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.redacted(table(spark, sf, "chunks"), table(spark, sf, "full_chunks"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = credentials.record_texts(table(spark, sf, "chunks"), table(spark, sf, "full_chunks"))
    return splitting.pieces(texts, with_text=False).select("origin", "record_key").distinct()


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.pieces(credentials.record_texts(table(spark, sf, "chunks"), table(spark, sf, "full_chunks")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, sf, "source_files"), table(spark, sf, "index_config")).select("index_prefix", "file_path")


def p5_labels(spark: SparkSession, sf: str) -> DataFrame:
    found = provenance.labelled_files(table(spark, sf, "source_files"), table(spark, sf, "index_config"))
    return found.groupBy("index_prefix", "label").agg(F.count("*").alias("n_files"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = doc_pairs.documented_functions(table(spark, sf, "function_metadata"), table(spark, sf, "source_files"))
    return found.select("chunk_id").distinct()


def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return doc_pairs.documentation_pairs(
        table(spark, sf, "function_metadata"), table(spark, sf, "source_files"), table(spark, sf, "full_chunks")
    )


def p6_extracted(spark: SparkSession, sf: str) -> DataFrame:
    found = doc_pairs.extracted_functions(table(spark, sf, "source_files"))
    return found.select("index_prefix", "file_path", "lang", "start_line", "end_line", "name", "documentation")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return invalid_files.invalid_files(table(spark, sf, "source_files")).select("index_prefix", "file_path")


def p7_rates(spark: SparkSession, sf: str) -> DataFrame:
    return invalid_files.validity_rates(table(spark, sf, "source_files"))


def p7_extracted(spark: SparkSession, sf: str) -> DataFrame:
    return invalid_files.extracted_nodes(table(spark, sf, "source_files"), table(spark, sf, "function_metadata"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_suites(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "eval_items")
    return leaks.leak_report(leaks.leaked_items(table(spark, sf, "documents"), items), items)


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return mixing.shares(mixing.mixture(table(spark, sf, "documents"), targets), targets)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.lookalike_pairs(table(spark, sf, "documents"))


def p10_normalized(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", lookalikes.normalized_text(F.col("text")).alias("text"))


def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.lookalike_classes(table(spark, sf, "documents"))


def p10_links(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.lookalike_links(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit() and callable(f)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": "select distinct 'full_chunks' as origin, chunk_id as record_key from full_chunks where length(content) > 2000 and chunk_id is not null"
        " union select distinct 'chunks', position::VARCHAR from chunks where length(text) > 2000 and position is not null",
    }
