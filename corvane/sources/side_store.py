"""The side store of an index: one text file per chunk and one JSON file of metadata, on a disk that all executors share."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

METADATA = "chunk_metadata.json"


def save_full_code(chunks: DataFrame, folder: str) -> None:
    """Write ``content`` of every (chunk_id, ext, content) to ``full_chunks/<chunk_id><ext>``.

    Of an id with several contents the greatest counts, so the outcome does not depend on the order of tasks; null ids or
    contents have no file; a file is replaced as a whole.
    """

    def write(rows: Iterator[Row]) -> None:
        where = os.path.join(folder, "full_chunks")
        os.makedirs(where, exist_ok=True)
        for r in rows:
            path = os.path.join(where, r.chunk_id + r.ext)
            draft = f"{path}.{os.getpid()}"
            with open(draft, "w", encoding="utf-8", errors="surrogatepass", newline="") as f:
                f.write(r.content)
            os.replace(draft, path)

    one = chunks.where("chunk_id is not null and content is not null").groupBy("chunk_id").agg(F.max(F.struct("content", F.coalesce("ext", F.lit(".txt")).alias("ext"))).alias("c"))
    one.select("chunk_id", "c.ext", "c.content").foreachPartition(write)


def load_full_code(folder: str, chunk_id: str, extensions: list[str]) -> str:
    """The ASCII characters of a chunk's file, whichever extension it has; a note where there is none."""
    for ext in [*extensions, ".txt"]:
        try:
            with open(os.path.join(folder, "full_chunks", chunk_id + ext), encoding="utf-8", errors="ignore", newline="") as f:
                return f.read().encode("ascii", "ignore").decode()
        except FileNotFoundError:
            continue
    return f"[Chunk {chunk_id} not found]"


def save_metadata(metadata: dict, folder: str) -> None:
    with open(os.path.join(folder, METADATA), "w", encoding="utf-8") as f:
        json.dump(metadata, f, indent=2)


def load_metadata(folder: str) -> dict:
    """What :func:`save_metadata` wrote; empty where it wrote nothing."""
    try:
        with open(os.path.join(folder, METADATA), encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}
