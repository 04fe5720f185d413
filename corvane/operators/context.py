"""Chunks to context: searchable text, summaries, reranking, budgets and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import ascii_strip, base_name, chunk_id, cut, folder, tokens_about

CANDIDATES = 25
FILES_PER_FOLDER = 8
SUMMARY_INPUT = 3500


# searchable text
def metadata_text() -> Column:
    """The text that stands for a code chunk: name, file, lines, type and documentation, absent parts left out."""
    c = F.col
    return F.concat_ws(
        "\n",
        F.when(c("function_name").isNotNull() & (c("function_name") != "unknown"), F.concat(F.lit("Function: "), c("function_name"))),
        F.concat(F.lit("File: "), c("file")),
        F.concat(F.lit("Lines: "), c("start_line").cast("string"), F.lit("-"), c("end_line").cast("string")),
        F.when(c("type").isNotNull() & (c("type") != ""), F.concat(F.lit("Type: "), c("type"))),
        F.when(c("docstring").isNotNull() & (c("docstring") != ""), F.concat(F.lit("Documentation: "), c("docstring"))),
    )


def document_chunks(files: DataFrame) -> DataFrame:
    """One document chunk per markdown file (file, code)."""
    n = F.size(F.split("code", "\n", -1))
    cid = chunk_id(F.col("file"), F.lit(1), n)
    return files.select("*", cid.alias("chunk_id"), F.concat(F.lit("full_chunks/"), cid, F.lit(".md")).alias("full_code_path"), F.concat(F.lit("DOCUMENT: "), F.col("file"), F.lit("\n\n"), F.col("code")).alias("text"))


# summaries
def summary_inputs(files: DataFrame) -> DataFrame:
    """Files over 100 characters with the part a summariser sees."""
    return files.where(F.length("code") > 100).withColumn("prompt_text", F.substring("code", 1, SUMMARY_INPUT))


def folder_lines(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Per folder (not the root) its first eight files' summaries as lines, in order of path."""
    s = summaries.withColumn("folder", folder(F.col("file"))).where("folder <> '.'")
    w = Window.partitionBy(*keys, "folder").orderBy("file")
    s = s.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= FILES_PER_FOLDER)
    line = F.concat(F.lit("- "), base_name(F.col("file")), F.lit(": "), F.coalesce("summary", F.lit("")))
    parts = F.sort_array(F.collect_list(F.struct("rn", line.alias("line"))))  # at most eight
    return s.groupBy(*keys, "folder").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("lines"), F.count("*").cast("int").alias("n_used"))


# reranking
def rerank_header() -> Column:
    """The line that introduces a candidate to a ranking model."""
    c = F.col
    where = F.concat(c("file"), F.lit(":"), c("start_line").cast("string"), F.lit("-"), c("end_line").cast("string"))
    return (
        F.when(c("level") == "code_chunk", F.concat(F.lit("Code "), F.coalesce("function_name", F.lit("unknown")), F.lit(" in "), where))
        .when(c("level") == "file_summary", F.concat(F.lit("File "), c("file")))
        .when(c("level") == "folder_summary", F.concat(F.lit("Folder "), c("folder")))
        .when(c("level") == "document", F.concat(F.lit("Document "), c("file")))
        .otherwise("Chunk")
    )


def apply_ranking(candidates: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    """Candidates ``(pos, ...)`` with a model's scores ``(response_pos, pos, score)``; positions out of range match nothing, ties keep the reply's order."""
    return candidates.join(ranking, "pos").orderBy(F.desc("score"), "response_pos").limit(k)


def default_ranking(candidates: DataFrame) -> DataFrame:
    """What stands in for a failed reply: every candidate scores 5."""
    return candidates.select(F.col("pos").alias("response_pos"), "pos", F.lit(5.0).alias("score"))


# budgets
def prefix_within(blocks: DataFrame, keys: list[str], limit: int, order: str = "pos") -> DataFrame:
    """The longest prefix of blocks whose tokens fit; the first that doesn't ends it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0) if keys else Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("used", F.sum("n_tokens").over(w)).where(F.col("used") <= limit)


def refinement_block() -> Column:
    """A chunk's body in a refinement prompt."""
    c = F.col
    code = F.coalesce(cut(ascii_strip(c("content")), 1500), F.lit("(Code not available)"))
    return (
        F.when(c("level") == "code_chunk", F.concat(rerank_header(), F.lit("\n"), code))
        .when(c("level") == "document", F.concat(rerank_header(), F.lit("\n"), F.coalesce(cut(ascii_strip(c("content")), 1500), F.substring(c("text"), 1, 500))))
        .when(c("level").isin("file_summary", "folder_summary"), F.concat(rerank_header(), F.lit("\n"), c("text")))
        .otherwise(F.concat(F.substring(c("text"), 1, 200), F.lit("...")))
    )


# late code and rendering
def with_code(chunks: DataFrame, full_chunks: DataFrame) -> DataFrame:
    """Chunks with the code behind their id; several contents of one id count as the greatest."""
    code = full_chunks.groupBy("chunk_id").agg(F.max("content").alias("content"))
    return chunks.join(code, "chunk_id", "left")


def late_content() -> Column:
    """What is shown of a chunk's code: the content, or a note why there is none."""
    return (
        F.when(F.col("chunk_id").isNull(), "[Content not available]")
        .otherwise(F.coalesce(ascii_strip(F.col("content")), F.concat(F.lit("[Chunk "), F.col("chunk_id"), F.lit(" not found]"))))
    )


def section() -> Column:
    """One chunk as Markdown."""
    c = F.col
    head = F.concat(F.lit("### "), c("file"))
    lines = F.concat(F.lit(" (lines "), c("start_line").cast("string"), F.lit("-"), c("end_line").cast("string"), F.lit(")"))
    return (
        F.when(c("level") == "code_chunk", F.concat(head, lines, F.lit("\n\n```\n"), late_content(), F.lit("\n```")))
        .when(c("level") == "document", F.concat(head, F.lit("\n\n"), late_content()))
        .when(c("level") == "file_summary", F.concat(head, F.lit("\n\n"), c("text")))
        .when(c("level") == "folder_summary", F.concat(F.lit("### "), c("folder"), F.lit("/\n\n"), c("text")))
        .otherwise(F.concat(F.lit("**"), c("text"), F.lit("**")))
    )


SEPARATOR = "\n\n---\n\n"


def joined_sections(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Sections ``(pos, section)`` of each key in order, as one text; callers bound the sections per key."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "section")))
    return sections.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["section"]), SEPARATOR).alias("context"))


def block_tokens(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("n_tokens", tokens_about(F.col("block")))
