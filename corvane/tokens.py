"""Token counts: byte-pair encoding under a public vocabulary file, or a quarter of the characters where there is none."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The encoder of a vocabulary file of base64 tokens and ranks; None if the file or the library is missing."""
    if not os.path.isfile(vocabulary):
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, vocabulary: str = VOCABULARY) -> int:
    e = encoding(vocabulary)
    return -(-len(text) // 4) if e is None else len(e.encode_ordinary(text))


def first_tokens(text: str, limit: int, vocabulary: str = VOCABULARY) -> tuple[str, bool]:
    """The text of the first ``limit`` tokens, and whether anything was cut off; a character cut in two is left out."""
    e = encoding(vocabulary)
    if e is None:
        return text[: 4 * limit], len(text) > 4 * limit
    ids = e.encode_ordinary(text)
    return (text, False) if len(ids) <= limit else (e.decode(ids[:limit], errors="ignore"), True)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text column; null for null."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else count(t, vocabulary)).astype("Int64")

    return counted(text)
