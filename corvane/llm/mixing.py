"""Problem 9: sources mixed to target shares of tokens.

Every document has a membership in each target domain: 1 in its source if that is a target,
else, where the source is unknown, the posteriors of a classifier fitted on labelled rows.
Each document has its own rate, between 0 and the cap of repeats of its likeliest domain.  The
rates minimise the squared distance of the domains' expected token totals from their
targets by projected gradient: an iteration moves every rate against the gradient, which is the
membership-weighted residual of its domains, and projects it on [0, cap].  Rates are not stored
between iterations but replayed from the few residual vectors so far, so an
iteration is one pass over a narrow table without a shuffle of rows, and one number per
domain reaches the driver.

Rates become whole repeats by a hash of the document's key plus one shift per domain.  The shifts are
searched ``SPLIT`` at a time until the tokens that really come out are the
nearest to the target, that is within about half a document; a domain with a target that has
any document gets at least one.

The size of the mixture is the largest at which the targets that sources can't reach under
their caps add up to no more than ``SHORTFALL`` of it, so neither is the scarcest source's
share given up nor does it alone set the size.  Shares of absent sources
are spread over the present ones in proportion and reported.

Tokens are counted with a public vocabulary; the classifier is fitted on at most
``FIT_ROWS`` labelled rows (a bound, not a share), everything else covers all rows.

Defined results: null or empty texts have no tokens and never come out; the tokens of unknown
sources count for every domain by its posterior, whatever that is; repeated keys are one document;
targets with a null or non-positive share take no part.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FIT_ROWS = 20_000
BUCKETS = 8192
ITERATIONS = 20
CLOSE = 1e-5
"""Distance from the targets, as a share of the size, at which the gradient steps end."""
SHORTFALL = 0.005
SPLIT, ROUNDS = 16, 5
"""Shifts tried at once and times that the best one's surroundings are searched again."""
_WORD = re.compile(r"\w+|[^\w\s]")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def features(text: str) -> np.ndarray:
    """Hashed counts of words and their shapes."""
    words = _WORD.findall(text.lower()) or [""]


    return np.bincount([zlib.crc32(w.encode()) % BUCKETS for w in words], minlength=BUCKETS)


class Classifier:
    """Naive Bayes over hashed words, with the posterior tempered by the text's length."""

    def __init__(self, labels: list[str], rows: list[tuple[str, str]]):
        self.labels = labels
        index = {label: k for k, label in enumerate(labels)}
        counts = np.full((len(labels), BUCKETS), 0.1)
        prior = np.ones(len(labels))
        for label, text in rows:
            counts[index[label]] += np.minimum(features(text), 3)
            prior[index[label]] += 1
        self.weights = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
        self.prior = np.log(prior / prior.sum()).astype(np.float32)

    def posterior(self, text: str) -> np.ndarray:
        x = np.minimum(features(text), 3)
        used = np.flatnonzero(x)
        z = self.prior + self.weights[:, used] @ x[used] / max(1.0, np.sqrt(x[used].sum()) / 4)
        z = np.exp(z - z.max())
        return z / z.sum()


def fit(docs: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id") -> Classifier:
    """A classifier of sources from at most ``rows`` labelled documents, taken by the hash of their key."""
    labelled = docs.where("source is not null and text is not null")
    share = min(1.0, rows / max(1, labelled.count()))
    picked = labelled.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)).select("source", "text")
    got = [(r.source, r.text) for r in picked.limit(rows).collect()]
    return Classifier(sorted({s for s, _ in got}) or [""], got)


def _measured(docs: DataFrame, model: Classifier, domains: list[str], vocabulary: str, key: str) -> DataFrame:
    """(doc_id, source, m, n_tokens): ``m`` holds the membership in each of ``domains``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = {d: row for d, row in zip(domains, np.eye(len(domains)))}
        none = np.zeros(len(domains))
        for pdf in batches:
            encode = _encoding(vocabulary).encode_ordinary
            at = {label: k for k, label in enumerate(shared.value.labels)}
            n = [len(encode(t)) for t in pdf["text"]]
            m = []
            for s, t in zip(pdf["source"], pdf["text"]):
                if s is None:
                    p = shared.value.posterior(t)
                    m.append(np.array([float(p[at[d]]) if d in at else 0.0 for d in domains]))
                else:
                    m.append(one.get(s, none))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "m": m, "n_tokens": n})

    return (
        docs.where(f"{key} is not null and text is not null and text <> ''").select(F.col(key).cast("long").alias("doc_id"), "source", "text")
        .mapInPandas(run, "doc_id long, source string, m array<double>, n_tokens long")
    )


def mixture(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(doc_id, source, domain, membership, memberships, n_tokens, repeats) of every document that comes out at least once; ``domain`` is the likeliest."""
    # the targets are a fixed small table of domains; its rows are read to the driver
    wanted = {r.source: (r.target_share, r.max_repeats or 1) for r in targets.where("source is not null and target_share > 0").collect()}
    domains = list(wanted)
    names = F.array(*[F.lit(d) for d in domains]).cast("array<string>")
    narrow = cut_lineage(
        _measured(docs, fit(docs, key=key), domains, vocabulary, key)
        .withColumn("membership", F.array_max("m")).where("membership > 0").dropDuplicates(["doc_id"])
        .withColumn("domain", F.element_at(names, F.array_position("m", F.col("membership")).cast("int")))
        .withColumn("u", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) + 0.5) / (1 << 30))
    )
    memberships = F.map_filter(F.map_from_arrays(names, F.col("m")), lambda _, x: x > 0).alias("memberships")
    columns = ["doc_id", "source", "domain", "membership", memberships, "n_tokens"]
    caps = np.array([float(wanted[d][1]) for d in domains])
    have = _totals(narrow, len(domains), caps, [], np.zeros((1, len(domains))), whole=None)[0]
    present = np.flatnonzero(have > 0)
    if not len(present):
        return narrow.select(*columns, F.lit(0).alias("repeats")).limit(0)
    share = np.zeros(len(domains))
    share[present] = [wanted[domains[k]][0] for k in present]
    share /= share.sum()
    size = mixture_size(share[present], (caps * have)[present])
    goal = np.minimum(size * share, caps * have)
    steps: list[np.ndarray] = []
    total = np.zeros(len(domains))
    for _ in range(ITERATIONS):
        if np.abs(total - goal).max() <= CLOSE * size:
            break
        # each domain's part of the gradient, preconditioned by its tokens; the rates are projected on [0, cap] after each step
        steps.append((total - goal) / np.maximum(have, 1e-9) * (have > 0))
        total = _totals(narrow, len(domains), caps, steps, np.zeros((1, len(domains))), whole=False)[0]
    # whole repeats: the shift of every domain at which the tokens that come out are nearest to the goal
    low, high = np.full(len(domains), -1.0), np.ones(len(domains))
    best, best_gap = np.zeros(len(domains)), np.full(len(domains), np.inf)
    for _ in range(ROUNDS):
        tried = low + (high - low) * np.linspace(0.0, 1.0, SPLIT + 1)[:, None]
        got = _totals(narrow, len(domains), caps, steps, tried, whole=True)
        gap = np.where(got > 0, np.abs(got - goal), np.inf)
        k = gap.argmin(0)
        at = np.arange(len(domains))
        better = gap[k, at] < best_gap
        best, best_gap = np.where(better, tried[k, at], best), np.where(better, gap[k, at], best_gap)
        first = np.clip((got < goal).sum(0), 1, SPLIT)  # totals rise with the shift: the goal lies between the last one below and the first one at it
        low, high = tried[first - 1, at], tried[first, at]
    repeated = _repeated(caps, steps, best)
    return narrow.withColumn("repeats", repeated("m", "u")).where("repeats > 0").select(*columns, "repeats")


def mixture_size(share: np.ndarray, most: np.ndarray) -> float:
    """The largest size at which what sources lack of ``size * share`` adds up to at most ``SHORTFALL`` of it."""
    ends = np.sort(most / share)
    low, high = float(ends[0]), float(ends[-1])
    for _ in range(60):  # the lack grows with the size
        size = (low + high) / 2
        if np.maximum(size * share - most, 0.0).sum() <= SHORTFALL * size:
            low = size
        else:
            high = size
    return low


def rates(m: np.ndarray, cap: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The documents' rates after the gradient steps, each projected on [0, cap]."""
    out = np.zeros(len(m))
    for step in steps:
        out = np.clip(out - m @ step, 0.0, cap)
    return out


def _whole(m: np.ndarray, u: np.ndarray, caps: np.ndarray, steps: list[np.ndarray], shift: np.ndarray) -> np.ndarray:
    domain = m.argmax(1)
    rate = rates(m, caps[domain], steps)
    return np.where(rate > 0, np.clip(np.floor(rate + u + shift[domain]), 0.0, caps[domain]), 0.0)


def _repeated(caps: np.ndarray, steps: list[np.ndarray], shift: np.ndarray):
    @F.pandas_udf("int")
    def repeated(m: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(_whole(np.stack(m.to_numpy()), u.to_numpy(), caps, steps, shift).astype("int32")) if len(m) else pd.Series([], dtype="int32")

    return repeated


def _totals(narrow: DataFrame, n: int, caps: np.ndarray, steps: list[np.ndarray], shifts: np.ndarray, whole: bool | None) -> np.ndarray:
    """Per shift and domain the tokens by membership: of all documents (``whole`` None), at the rates, or at whole repeats."""
    if not n:
        return np.zeros((len(shifts), 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((len(shifts), n))
        for pdf in batches:
            if not len(pdf):
                continue
            m, tokens = np.stack(pdf["m"].to_numpy()), pdf["n_tokens"].to_numpy(dtype=float)
            if whole:
                u = pdf["u"].to_numpy()
                for k, shift in enumerate(shifts):
                    out[k] += (_whole(m, u, caps, steps, shift) * tokens) @ m
            else:
                out[0] += ((np.ones(len(m)) if whole is None else rates(m, caps[m.argmax(1)], steps)) * tokens) @ m
        yield pd.DataFrame({"k": np.arange(out.size), "t": out.ravel()})

    got = narrow.select("m", "u", "n_tokens").mapInPandas(run, "k int, t double").groupBy("k").agg(F.sum("t").alias("t")).collect()  # a number per shift and domain
    out = np.zeros(len(shifts) * n)
    for row in got:
        out[row.k] = row.t
    return out.reshape(len(shifts), n)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share, the share reached, tokens, documents and the most repeats of one document."""
    # tokens count for every domain by membership, a document and its repeats for the likeliest one
    mine = F.col("d") == F.col("domain")
    out = mixed.select("*", F.explode("memberships").alias("d", "part")).groupBy(F.col("d")).agg(
        F.sum(F.col("n_tokens") * F.col("repeats") * F.col("part")).alias("n_tokens"), F.count(F.when(mine, 1)).alias("n_documents"), F.max(F.when(mine, F.col("repeats"))).alias("most_repeats")
    ).withColumnRenamed("d", "domain")
    everything = out.agg(F.sum("n_tokens").alias("all_tokens"))
    t = targets.where("source is not null and target_share > 0").select(F.col("source").alias("domain"), "target_share", "max_repeats")
    return (
        t.join(out, "domain", "left").crossJoin(F.broadcast(everything))  # one row
        .select(
            F.col("domain").alias("source"), "target_share", F.round(F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
            F.coalesce(F.round("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
            "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )
