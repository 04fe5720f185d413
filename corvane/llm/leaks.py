"""Problem 8: evaluation passages inside a corpus, by size-partitioned MinHash containment.

A leak is a run of at least ``passage`` (12) consecutive words of a test item inside a
document.  Both sides are cut into passages of exactly that length, that is into sets
of ``passage - shingle + 1`` (8) consecutive five-word shingles.  For sets of
one size containment is equality, so a passage that occurs on both sides has the
same MinHash under every permutation: the search loses nothing.  A document's passage
signatures are sliding minima over its shingle hashes, of which neighbouring passages
share most, and only signatures of the items are looked up.

Items are partitioned by size (a power of two of their passage count): large items have
many passages and hence more chance signatures, so their partitions ask for more MinHash rows to
agree.  A document's signatures for all partitions come out of one pass over its rows.

Neither table is held by the driver, and passages are kept only where both sides may have them.  The signatures of
all items are folded into a filter, sized by the items' length up to ``FILTER_BITS``, which is broadcast; the corpus
is read once, whatever the number of items, and only passages whose signature is in the filter are kept, as 16-byte
digests of their words.  Their signatures make a second filter, by which a second reading of the items keeps the
passages that documents may have.  Equal digests are the containment check.  More items than the filter was made
for let more passages through and lose none.

Words are runs of letters, digits and underscores in the consistent form of
:mod:`corvane.llm.lookalikes`, lower-cased; HTML tags, entities and link targets are markup.

Defined results: null or empty texts match nothing; items under ``passage`` words match
nothing; repeated items or documents give one row per (document, item).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage, small

from .lookalikes import readable

PASSAGE = 12
SHINGLE = 5
FILTER_BITS = 1 << 29
"""Greatest size of a broadcast filter: 64 MB, made for some seventy million passages."""
FILTER_BLOCK = 1 << 13
"""Words of a filter that are merged together."""
SLICE_CHARS = 1 << 22
"""Characters that are cut into words at once (a longer text makes a slice of its own)."""
_MARKUP = re.compile(r"</?[a-zA-Z][a-zA-Z0-9-]*(?:\s[^<>]*)?/?>|&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,6});|(?<=\])\([^()\s]*\)")
_WORD = re.compile(r"\w+")
_PERMUTE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def words(text: str) -> list[str]:
    """The words of a text that the comparison sees."""
    text = readable(text).lower()
    if "<" in text or "&" in text or "](" in text:
        text = _MARKUP.sub(" ", text)
    if "_" not in text:
        return _WORD.findall(text)
    return [w for w in (x.strip("_") for x in _WORD.findall(text)) if w]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def shingle_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` word numbers."""
    m = max(0, len(ids) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n if m > 0 else 0):
        out = _mix(out + ids[k : k + m].astype(np.uint64) + np.uint64(k + 1))
    return out


def signatures(shingles: np.ndarray, width: int) -> list[np.ndarray]:
    """MinHash signatures of every set of ``width`` consecutive shingles, for 1, 2, ... rows (permutations folded into one number)."""
    m = len(shingles) - width + 1
    out, folded = [], np.zeros(max(0, m), dtype=np.uint64)
    for r, permute in enumerate(_PERMUTE):
        h = _mix(shingles ^ permute)
        low = h[: max(0, m)].copy()
        for k in range(1, width):
            np.minimum(low, h[k : k + m], out=low)
        folded = _mix(folded + low)
        out.append(folded + np.uint64(r))
    return out


def rows_for(passages: int) -> int:
    """MinHash rows of the size partition of an item with so many passages."""
    size = passages.bit_length()
    return 1 + (size > 4) + (size > 7)


class _Numbers(dict):
    """Words to 64-bit numbers, remembered for a while."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return out


def _slices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch by rows of about ``SLICE_CHARS`` characters together."""
    at = np.cumsum(pdf["t"].map(len).to_numpy(np.int64)) // SLICE_CHARS
    for k in np.unique(at):
        yield pdf[at == k]


def _passages(texts: Iterable[str], passage: int, numbers: _Numbers) -> tuple[list[list[str]], np.ndarray, np.ndarray, list[np.ndarray]]:
    """The words of every text, and for every passage of them the text, the first word and the signatures."""
    all_words = [words(t) for t in texts]
    sizes = np.array([len(w) for w in all_words], dtype=np.int64)
    ids = np.fromiter((numbers[w] for ws in all_words for w in ws), dtype=np.uint64, count=int(sizes.sum()))
    n = len(ids) - passage + 1
    if n <= 0:
        return all_words, np.empty(0, np.int64), np.empty(0, np.int64), [np.empty(0, np.uint64)] * len(_PERMUTE)
    sketch = signatures(shingle_hashes(ids, SHINGLE), passage - SHINGLE + 1)
    # texts are laid end to end; a passage must end in the text it begins in
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(text[:n] == text[passage - 1 :])
    starts = np.cumsum(sizes) - sizes
    return all_words, text[inside], inside - starts[text[inside]], [x[inside] for x in sketch]


# --- filters -------------------------------------------------------------------------------------

def filter_bits(passages: float) -> int:
    """Bits of a filter for so many passages: a power of two, eight a passage where ``FILTER_BITS`` allows."""
    return min(FILTER_BITS, max(1 << 16, 1 << int(8 * passages).bit_length()))


def _places(sig: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word and the bit of the two places of every signature in a filter."""
    for h in (sig, _mix(sig)):
        at = h & np.uint64(bits - 1)
        yield (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def _held(filter_: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Which signatures may be among those of a filter."""
    out = np.ones(len(sig), bool)
    for word, bit in _places(sig, 64 * len(filter_)):
        out &= (filter_[word] & bit) != 0
    return out


def _fold(sigs: Iterable[np.ndarray], bits: int) -> Iterator[pd.DataFrame]:
    """The filter of a task's signatures, as its blocks that hold any."""
    filter_ = np.zeros(bits >> 6, np.uint64)
    for sig in sigs:
        for word, bit in _places(sig, bits):
            np.bitwise_or.at(filter_, word, bit)
    for k in range(0, len(filter_), FILTER_BLOCK):
        part = filter_[k : k + FILTER_BLOCK]
        if part.any():
            yield pd.DataFrame({"block": [k], "words": [zlib.compress(part.tobytes(), 1)]})


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint64) for x in pdf["words"]])
    return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), "words": [zlib.compress(out.tobytes(), 1)]})


def _filter(folded: DataFrame, bits: int) -> np.ndarray:
    """The filter of all tasks; at most ``FILTER_BITS`` reach the driver, whatever the number of items."""
    out = np.zeros(bits >> 6, np.uint64)
    for r in folded.groupBy("block").applyInPandas(_merge, _BLOCKS).collect():
        part = np.frombuffer(zlib.decompress(r.words), np.uint64)
        out[r.block : r.block + len(part)] = part
    return out


_BLOCKS = "block long, words binary"


# --- both sides ----------------------------------------------------------------------------------

def _digests(ws: list[list[str]], text: np.ndarray, first: np.ndarray, passage: int) -> list[bytes]:
    return [hashlib.blake2b(" ".join(ws[t][k : k + passage]).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t, k in zip(text, first)]


def _item_filter(passage: int, bits: int):
    """The filter of the items' signatures, each of the rows of its item's size."""

    def sigs(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        numbers = _Numbers()
        for pdf in batches:
            for part in _slices(pdf):
                ws, text, _, sketch = _passages(part["t"], passage, numbers)
                if len(text):
                    rows = np.array([rows_for(max(1, len(w) - passage + 1)) for w in ws], dtype=np.int64)[text] - 1
                    yield np.choose(rows, sketch)

    return lambda batches: _fold(sigs(batches), bits)


def _signature_filter(bits: int):
    """The filter of a column of signatures."""
    return lambda batches: _fold((pdf["sig"].to_numpy(np.int64).view(np.uint64) for pdf in batches), bits)


def _document_runs(shared, passage: int):
    """The passages of documents that have one of their signatures in the items' filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Numbers()
        for pdf in batches:
            for part in _slices(pdf):
                ws, text, first, sketch = _passages(part["t"], passage, numbers)
                hit = np.flatnonzero(np.logical_or.reduce([_held(shared.value, sig) for sig in sketch]))
                out = pd.DataFrame({"doc_id": part["k"].to_numpy()[text[hit]], "run": _digests(ws, text[hit], first[hit], passage), "sig": sketch[-1][hit].astype(np.int64)})
                yield out.drop_duplicates(["doc_id", "run"])

    return run


def _item_runs(shared, passage: int):
    """The passages of items that have their signature in the documents' filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Numbers()
        for pdf in batches:
            for part in _slices(pdf):
                ws, text, first, sketch = _passages(part["t"], passage, numbers)
                hit = np.flatnonzero(_held(shared.value, sketch[-1]))
                out = pd.DataFrame({"item_id": part["k"].to_numpy()[text[hit]], "run": _digests(ws, text[hit], first[hit], passage)})
                yield out.drop_duplicates()

    return run


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text",
    item_key: str = "item_id", item_text: str = "text", passage: int = PASSAGE,
) -> DataFrame:
    """(doc_id, item_id) for every document holding a passage of an item's text."""
    context = docs.sparkSession.sparkContext
    queries = items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("t")).where("k is not null and t is not null")
    source = docs.select(F.col(doc_key).cast("long").alias("k"), F.col(doc_text).alias("t")).where(
        (F.length("t") >= 2 * passage - 1) & F.col("k").isNotNull()
    )
    # some six characters a word
    bits = filter_bits((queries.agg(F.sum(F.length("t"))).first()[0] or 0) / 6)
    shared = context.broadcast(_filter(queries.mapInPandas(_item_filter(passage, bits), _BLOCKS), bits))
    hits = cut_lineage(source.mapInPandas(_document_runs(shared, passage), "doc_id long, run binary, sig long"))
    shared.unpersist()
    bits = filter_bits(hits.count())
    shared = context.broadcast(_filter(hits.select("sig").mapInPandas(_signature_filter(bits), _BLOCKS), bits))
    runs = cut_lineage(queries.mapInPandas(_item_runs(shared, passage), "item_id long, run binary").distinct())
    shared.unpersist()
    return hits.select("doc_id", "run").join(small(runs), "run").select("doc_id", "item_id").distinct()


def leak_report(found: DataFrame, items: DataFrame, item_key: str = "item_id", suite: str = "suite") -> DataFrame:
    """Per suite: how many items leaked and into how many documents."""
    hits = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
    return (
        items.select(F.col(item_key).alias("item_id"), suite).distinct().join(hits, "item_id", "left")
        .groupBy(suite).agg(
            F.count("*").alias("n_items"), F.count("n").alias("n_leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits")
        )
    )
