"""Problem 3: oversized texts cut into overlapping pieces at natural boundaries.

Candidate cuts are the natural boundaries of a text, each with a penalty (a blank line
costs least, then a line end before less indented code, any line end, a sentence, a
word); where no boundary lies within reach, plain characters are candidates at a high
penalty.  Dynamic programming over the candidates minimises the sum of cut penalties
and squared deviations of piece sizes from an even split, subject to the maximum length
of a piece with its overlap.

Every piece after the first begins with the last ``overlap`` characters of the one
before, or up to a fifth less where that makes it begin at a line or word.

Lengths count code points; no cut separates ``\\r\\n`` or a combining mark from its letter.

Defined results: texts up to the limit, empty and null ones give no piece (they need no
cut); repeated rows give one set of pieces; an id with two contents gives both sets,
told apart by ``text_hash``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
# Penalties of cuts, in units of a squared deviation of a quarter of the limit.
BLANK_LINE, OUTER_LINE, LINE, SENTENCE, WORD, CHARACTER = 0.0, 0.15, 0.4, 1.0, 2.0, 8.0

_LINES = re.compile(r"\r\n|\n|\r| | ")
_SENTENCE = re.compile(r"[.!?。！？;][\"')\]]*\s+")
_SPACE = re.compile(r"\s+")


def candidates(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut positions inside the text with their penalties."""
    cost: dict[int, float] = {}
    start, before = 0, 0
    ends = [m.end() for m in _LINES.finditer(text)]
    for end in ends:
        line = text[start:end]
        after = text[end : end + 80]
        bare = line.strip()
        indent = len(after) - len(after.lstrip(" \t"))
        if not bare:
            cost[end] = BLANK_LINE
        elif indent < before or indent == 0 and before == 0 and bare[-1:] in "};":
            cost[end] = OUTER_LINE
        else:
            cost[end] = LINE
        if bare:
            before = len(line) - len(line.lstrip(" \t"))
        start = end
    reach = (limit - overlap) // 4
    edges = [0, *ends, len(text)]
    for a, b in zip(edges, edges[1:]):
        if b - a <= reach:
            continue
        found = {m.end(): SENTENCE for m in _SENTENCE.finditer(text, a, b)}
        for m in _SPACE.finditer(text, a, b):
            found.setdefault(m.end(), WORD)
        stops = [a, *sorted(found), b]
        for p, q in zip(stops, stops[1:]):
            for c in range(p + reach // 2, q, max(1, reach // 2)) if q - p > reach else ():
                while c < q and (unicodedata.combining(text[c]) or text[c] in "‍️"):
                    c += 1
                if p < c < q:
                    found.setdefault(c, CHARACTER)
        for c, k in found.items():
            cost.setdefault(c, k)
    cost.pop(0, None)
    cost.pop(len(text), None)
    places = np.array(sorted(cost), dtype=np.int64)
    return places, np.array([cost[c] for c in places.tolist()])


def overlap_start(text: str, cut: int, overlap: int = OVERLAP) -> int:
    """Where the piece behind ``cut`` begins: at most ``overlap`` before it, at a line or word if one is near."""
    first = max(0, cut - overlap)
    last = max(first, cut - overlap + overlap // 5)
    if first == 0 and cut <= overlap:
        return 0
    window = text[first:last]
    m = _LINES.search(window)
    if m is not None:
        return first + m.end()
    m = _SPACE.search(window)
    if m is not None and first + m.end() <= last:
        return first + m.end()
    while first < cut and (unicodedata.combining(text[first]) or text[first - 1 : first + 1] == "\r\n"):
        first += 1
    return first


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of every piece; one piece if the text needs no cut."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    places, cost = candidates(text, limit, overlap)
    ends = np.append(places, n)
    cost = np.append(cost, 0.0)
    starts = np.empty(len(ends) + 1, dtype=np.int64)  # where the piece behind a cut begins; 0 is the text's beginning
    starts[0] = 0
    starts[1:-1] = [overlap_start(text, c, overlap) for c in places.tolist()]
    starts[-1] = n
    edges = np.concatenate(([0], ends))
    even = n / max(1, -(-(n - overlap) // (limit - overlap)))
    unit = (limit / 4) ** 2
    best = np.full(len(edges), np.inf)
    best[0] = 0.0
    back = np.zeros(len(edges), dtype=np.int64)
    low = 0
    for j in range(1, len(edges)):
        while ends[j - 1] - starts[low] > limit:
            low += 1
        if low >= j:  # unreachable: candidates are never further apart than a piece may be long
            continue
        size = edges[j] - edges[low:j]
        total = best[low:j] + (size - even) ** 2 / unit
        k = int(np.argmin(total))
        best[j] = total[k] + cost[j - 1]
        back[j] = low + k
    out, j = [], len(edges) - 1
    while j > 0:
        i = int(back[j])
        out.append((int(starts[i]), int(edges[j])))
        j = i
    return out[::-1]


def pieces(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(origin, record_key, text_hash, piece_no, start, end[, piece]) of every text over the limit.

    Shorter texts are filtered in the JVM and never reach Python.
    """
    long = texts.where(F.length("text") > limit).select("origin", "record_key", F.xxhash64("text").alias("text_hash"), "text")
    columns = ["origin", "record_key", "text_hash", "piece_no", "start", "end"] + ["piece"] * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for o, k, h, t in zip(pdf["origin"], pdf["record_key"], pdf["text_hash"], pdf["text"]):
                for n, (a, b) in enumerate(split(t, limit, overlap)):
                    rows.append((o, k, h, n, a, b, t[a:b])[: len(columns)])
            yield pd.DataFrame(rows, columns=columns)

    schema = "origin string, record_key string, text_hash long, piece_no int, start int, end int" + ", piece string" * with_text
    return long.mapInPandas(run, schema).dropDuplicates(["origin", "record_key", "text_hash", "piece_no"])
