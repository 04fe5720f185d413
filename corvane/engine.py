"""The engine: index a tree incrementally, retrieve, and answer questions with a bounded context."""

from __future__ import annotations

import json
import logging
import os
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.functions import folder
from corvane.operators import context, incremental, search
from corvane.operators.chunking import chunk_files
from corvane.providers import HashProvider, Provider, rank, refine, summarize_file, summarize_folder
from corvane.sources.tree import read_tree
from corvane.tokens import VOCABULARY, count, first_tokens

log = logging.getLogger("corvane")
EMBED_BATCH = 32
NOTHING = "No relevant context found."
UNRELATED = "query invalid, no related chunks found\nTry with a different query. Or search for context yourself"


class ContextEngine:
    """An index below ``path``: immutable version folders and a pointer to the current one."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, provider: Provider | None = None, vocabulary: str = VOCABULARY):
        self.vocabulary = vocabulary
        self.spark, self.path, self.config, self.provider = spark, path, config or Config(), provider or HashProvider()
        os.makedirs(path, exist_ok=True)

    # versions
    def _pointer(self) -> str:
        return os.path.join(self.path, "CURRENT.json")

    def state(self) -> dict | None:
        """The manifest of the current version; None without one, or if another model made its vectors."""
        try:
            with open(self._pointer(), encoding="utf-8") as f:
                m = json.load(f)
        except (FileNotFoundError, json.JSONDecodeError):
            return None
        return m if m.get("model") == self.provider.name else None

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, self.state()["version"], name))

    # indexing
    def index(self, root: str) -> dict[str, int]:
        """Bring the index up to date with a tree; returns the counts of the difference."""
        c = self.config
        inside = os.path.relpath(os.path.abspath(self.path), os.path.abspath(root))
        tree = read_tree(self.spark, root, c.ignored_dirs, c.ignored_files, list(c.supported_languages))
        if not inside.startswith(".."):
            tree = tree.where(~F.col("rel_path").startswith(inside + "/"))
        langs = F.create_map(*[F.lit(x) for kv in c.supported_languages.items() for x in kv])
        now = tree.select(F.lit("").alias("index_prefix"), F.col("rel_path").alias("file"), langs[F.col("ext")].alias("lang"), F.col("sha256").alias("hash"), "code")
        before = self.state()
        keys = ["index_prefix", "file"]
        old = self._read("files") if before else self.spark.createDataFrame([], "index_prefix string, file string, hash string")
        diff = incremental.classified(old, now, keys)
        counts = {r.status: r.n for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
        if before and set(counts) <= {"unchanged"}:
            return counts
        version = f"v-{uuid.uuid4().hex[:12]}"
        out = os.path.join(self.path, version)
        todo = now.join(diff.where("status in ('added', 'modified')").select(*keys), keys)
        todo.write.parquet(os.path.join(out, "todo"))
        todo = self.spark.read.parquet(os.path.join(out, "todo"))
        chunks = chunk_files(todo)
        code = F.when(F.col("level") == "document", F.concat(F.lit("DOCUMENT: "), "file", F.lit("\n\n"), "content")).otherwise(context.metadata_text())
        fresh = chunks.select(*keys, F.lit(None).cast("string").alias("folder"), "level", "start_line", "end_line", "type", "function_name", "docstring", "chunk_id", code.alias("text"), "content")
        summaries = _summaries(todo, self.provider)
        summary_rows = summaries.select(*keys, F.lit("file_summary").alias("level"), F.concat(F.lit("FILE: "), "file", F.lit("\n"), "summary").alias("text"))
        fresh = fresh.unionByName(summary_rows, allowMissingColumns=True)
        fresh = _embedded(fresh, self.provider)
        fresh.write.parquet(os.path.join(out, "fresh"))
        fresh = self.spark.read.parquet(os.path.join(out, "fresh"))
        everything = fresh
        if before:
            kept = incremental.kept_chunks(self._read("chunks"), diff, keys)
            everything = incremental.combined(kept, fresh)
        folders = _folder_chunks(everything, self.provider)
        everything = incremental.combined(everything, _embedded(folders, self.provider)).where(F.col("embedding").isNotNull())
        everything.write.parquet(os.path.join(out, "chunks"))
        # a file of which a chunk got no vector is listed without a hash, so the next run takes it as modified and replaces what was stored
        failed = fresh.where(F.col("embedding").isNull()).select(*keys, F.lit(True).alias("failed")).distinct()
        now.join(failed, keys, "left").select(*keys, F.when(F.col("failed").isNull(), F.col("hash")).alias("hash")).write.parquet(os.path.join(out, "files"))
        manifest = {"version": version, "root": os.path.abspath(root), "model": self.provider.name, "dim": self.provider.dim, "total_chunks": self.spark.read.parquet(os.path.join(out, "chunks")).count()}
        draft = self._pointer() + f".{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump(manifest, f)
        os.replace(draft, self._pointer())  # the commit
        return counts

    # retrieval
    def retrieve(self, question: str, k: int = search.TOP_K, threshold: float = search.THRESHOLD) -> DataFrame:
        """The best chunks for a question as (pos, score, chunk columns)."""
        q = self.spark.createDataFrame([(self.provider.embed([question])[0],)], "q array<double>")
        rows = self._read("chunks").withColumn("vec_id", F.concat_ws(":", "level", F.coalesce("file", "folder"), F.coalesce(F.col("start_line"), F.lit(0)), F.coalesce(F.col("end_line"), F.lit(0)), F.coalesce("type", F.lit(""))))
        scored = rows.crossJoin(F.broadcast(q)).select("*", search.dot(F.col("embedding"), F.col("q")).alias("raw")).drop("q")
        best = scored.orderBy(F.desc(F.round("raw", 6)), "vec_id").limit(k)
        return best.where(F.col("raw") > threshold)

    def query(self, question: str, k: int = search.TOP_K, output_k: int = 5, token_limit: int = 15_000, use_cache: bool = True) -> str:
        """Context for a question: search, cache, ranking, refinement by the model, rendering within the token limit."""
        found = [r.asDict() for r in self.retrieve(question, k).select("vec_id", "level", "file", "folder", "start_line", "end_line", "function_name", "chunk_id", "text", "content", "raw").collect()]
        if not found:
            return NOTHING
        key = _cache_key(question, [_ascii(f["text"]) for f in found], output_k, token_limit, self.provider.name, self.state()["version"])
        if use_cache and (hit := self._cached(key)) is not None:
            return hit
        top = found[: context.CANDIDATES]
        prompt = f"Score each chunk from 0 to 10 for the question: {question}\n\n" + "\n\n".join(f"[{n}] {f['level']} {f['file'] or f['folder']}\n{_ascii(f['text'])}" for n, f in enumerate(top))
        order = sorted(rank(self.provider, prompt, len(top)), key=lambda s: -s[1])[:output_k]
        text = self._refined(question, [top[n] for n, _ in order], token_limit)
        self._store(key, text)
        return text

    def _refined(self, question: str, chosen: list[dict], token_limit: int) -> str:
        """The model's summary of the chosen chunks with as many of their sections as fit; without a reply all sections, whatever their size."""
        if not chosen:
            return UNRELATED
        sections = [_section(f) for f in chosen]
        blocks, used = [], 0
        for n, f in enumerate(chosen):  # the longest prefix of blocks within the limit
            block = f"Chunk {n}: {_block(f)}"
            used += count(block, self.vocabulary)
            if used > token_limit:
                break
            blocks.append(block)
        try:
            summary = refine(self.provider, question, blocks)
        except Exception:  # noqa: BLE001 - whatever the provider raises
            log.warning("no refinement", exc_info=True)
            return context.SEPARATOR.join(sections)
        return fit(summary, sections, token_limit, self.vocabulary)

    def sync_and_query(self, question: str, root: str, token_limit: int = 15_000) -> str:
        """Index a project, then answer; a failed index run is logged and the old index answers."""
        try:
            self.index(root)
        except Exception:  # noqa: BLE001
            log.exception("indexing failed")
        try:
            text = _ascii(self.query(_ascii(question), output_k=10, token_limit=token_limit))
        except Exception as e:  # noqa: BLE001
            return f"Error: {e}"
        text, cut = first_tokens(text, token_limit, self.vocabulary)
        return text + f"\n\n[Result truncated: output exceeded {token_limit} token limit]" if cut else text

    # result cache: one small JSON file per key
    def _cached(self, key: str) -> str | None:
        try:
            with open(os.path.join(self.path, "cache", key), encoding="utf-8") as f:
                e = json.load(f)
        except (FileNotFoundError, json.JSONDecodeError):
            return None
        if int(time.time()) > e["expires_at"]:
            os.remove(os.path.join(self.path, "cache", key))
            return None
        return e["value"]

    def _store(self, key: str, value: str) -> None:
        os.makedirs(os.path.join(self.path, "cache"), exist_ok=True)
        with open(os.path.join(self.path, "cache", key), "w", encoding="utf-8") as f:
            json.dump({"value": value, "expires_at": int(time.time()) + self.config.ttl_seconds}, f)

    def purge(self, expired_only: bool = True) -> int:
        """Remove cache entries; returns how many."""
        gone, folder_ = 0, os.path.join(self.path, "cache")
        for name in os.listdir(folder_) if os.path.isdir(folder_) else []:
            with open(os.path.join(folder_, name), encoding="utf-8") as f:
                if not expired_only or json.load(f)["expires_at"] < int(time.time()):
                    os.remove(os.path.join(folder_, name))
                    gone += 1
        return gone

    def inspect(self) -> DataFrame:
        """How many chunks and files there are per level."""
        return self._read("chunks").groupBy(F.coalesce("level", F.lit("unknown")).alias("level")).agg(F.count("*").alias("n_chunks"), F.countDistinct("file").alias("n_files"))


def _ascii(text: str) -> str:
    return text.encode("ascii", "ignore").decode()


def _cache_key(question: str, texts: list[str], *more) -> str:
    import hashlib

    return hashlib.sha256("|".join([question, *[t[:100] for t in texts[:5]], *map(str, more)]).encode()).hexdigest()


def _section(f: dict) -> str:
    if f["level"] in ("code_chunk", "document"):
        body = _ascii(f["content"]) if f["content"] is not None else f"[Chunk {f['chunk_id']} not found]"
        if f["level"] == "document":
            return f"### {f['file']}\n\n{body}"
        return f"### {f['file']} (lines {f['start_line']}-{f['end_line']})\n\n```\n{body}\n```"
    return f"### {f['file'] or f['folder'] + '/'}\n\n{_ascii(f['text'])}"


def _block(f: dict) -> str:
    """A chunk's body in the refinement prompt."""
    where = f["file"] or f["folder"]
    if f["level"] in ("code_chunk", "document"):
        body = "(Code not available)" if f["content"] is None else _ascii(f["content"])
        return f"{where}\n" + (body if len(body) <= 1500 else body[:1500] + "\n... (truncated)")
    return f"{where}\n{_ascii(f['text'])}"


def fit(summary: str, sections: list[str], limit: int, vocabulary: str = VOCABULARY) -> str:
    """The summary with the longest prefix of sections within ``limit`` tokens."""
    for n in range(len(sections), 0, -1):
        text = (summary + "\n\n" if summary else "") + context.SEPARATOR.join(sections[:n])
        if count(text, vocabulary) <= limit:
            return text
    return summary


def _summaries(files: DataFrame, provider: Provider) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"index_prefix": pdf["index_prefix"], "file": pdf["file"], "summary": [summarize_file(provider, c, f.rpartition("/")[2]) for c, f in zip(pdf["prompt_text"], pdf["file"])]})

    return context.summary_inputs(files).select("index_prefix", "file", "prompt_text").mapInPandas(run, "index_prefix string, file string, summary string")


def _embedded(chunks: DataFrame, provider: Provider, attempts: int = 3) -> DataFrame:
    """Chunks with vectors, in batches of 32; a batch that fails for good stays without."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, out = pdf["text"].tolist(), []
            for k in range(0, len(texts), EMBED_BATCH):
                part = texts[k : k + EMBED_BATCH]
                for attempt in range(attempts):
                    try:
                        out += provider.embed(part)
                        break
                    except Exception:  # noqa: BLE001
                        time.sleep(0.0 if attempt == attempts - 1 else 2.0**attempt)
                else:
                    out += [None] * len(part)
            yield pdf.assign(embedding=out)

    return chunks.mapInPandas(run, schema)


def _folder_chunks(chunks: DataFrame, provider: Provider) -> DataFrame:
    s = incremental.kept_summaries(chunks)
    lines = s.withColumn("in_folder", folder(F.col("file"))).where("in_folder <> '.'")
    from pyspark.sql import Window

    w = Window.partitionBy("index_prefix", "in_folder").orderBy("file")
    top = lines.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= context.FILES_PER_FOLDER)
    grouped = top.groupBy("index_prefix", "in_folder").agg(F.sort_array(F.collect_list(F.struct("rn", "file", "summary"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [f"FOLDER: {d}\n{summarize_folder(provider, [(p['file'], p['summary']) for p in parts])}" for d, parts in zip(pdf["in_folder"], pdf["parts"])]
            yield pd.DataFrame({"index_prefix": pdf["index_prefix"], "folder": pdf["in_folder"], "level": "folder_summary", "text": text})

    return grouped.mapInPandas(run, "index_prefix string, folder string, level string, text string")


