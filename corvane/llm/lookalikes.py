"""Problem 10: one form for texts that look the same.

The skeleton of a text is built as Unicode's confusable skeletons are: decompose
canonically, replace every character by its prototype, decompose again.  The
prototype comes from rules over the Unicode character database (wide, narrow, font,
no-break and ligature forms; spaces; characters without a glyph) and, for
look-alike letters of other scripts, from the short table below.  ASCII characters
are their own prototypes, so texts that differ in a real letter, digit or case keep
different skeletons.

Defined results: a null text has a null skeleton and belongs to no class; the empty
text is a class of its own; a text of invisible characters only has the skeleton ``""``;
repeated rows of one document count once; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import cut_lineage, small

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "у": "y", "ү": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ӕ": "æ", "ә": "ə", "А": "A", "В": "B", "С": "C",
    "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T",
    "У": "Y", "Ү": "Y", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ӕ": "Æ",
    # Greek
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "ϲ": "c", "ϳ": "j", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian, Cherokee and Latin letters made for phonetics
    "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "զ": "q", "Ս": "U", "Օ": "O", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C",
    "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S",
    "Ꭲ": "I", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʋ": "u", "ᴄ": "c", "ᴏ": "o",
    "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    # Near look-alikes of Cyrillic and Greek
    "к": "k", "ԍ": "G", "Ԍ": "G", "η": "n", "κ": "k", "τ": "t",
    # Lisu, by the capital each letter is drawn as
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R",
    "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Canadian syllabics
    "ᑌ": "U", "ᑭ": "P", "ᗅ": "A", "ᗞ": "D", "ᗪ": "D", "ᒍ": "J", "ᒪ": "L", "ᖇ": "R", "ᕼ": "H", "ᐯ": "V", "ᑕ": "C", "ᗷ": "B", "ᗰ": "M", "ᔕ": "S",
    # Hyphens, dashes and quotation marks
    "‐": "-", "‑": "-", "﹣": "-", "‒": "-", "–": "-", "−": "-", "˗": "-", "’": "'", "‘": "'", "‛": "'", "ʼ": "'", "ʹ": "'", "′": "'",
}
# Characters without a glyph that are not of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
FORMS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")


def prototype(ch: str) -> str:
    """What stands for ``ch`` in a skeleton (one character in, any number out)."""
    if ch < "\x80":
        return ch
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch in INVISIBLE or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if kind == "Zs":
        return " "
    form = unicodedata.decomposition(ch)
    name = unicodedata.name(ch, "")
    if form.startswith(FORMS) or form.startswith("<compat>") and ("LIGATURE" in name or "ROMAN NUMERAL" in name or "DIGRAPH" in name):
        out = unicodedata.normalize("NFKD", ch)
        return "".join(LOOKALIKES.get(c, c) for c in out)
    return ch


class _Prototypes(dict):
    """A translation table that fills itself in as characters occur."""

    def __missing__(self, code: int) -> str:
        self[code] = out = prototype(chr(code))
        return out


_TABLE = _Prototypes()


def skeleton(text: str) -> str:
    """The text with every character replaced by its prototype, decomposed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_TABLE))


def readable(text: str) -> str:
    """The skeleton with accents composed again: the form to store and to cut into words."""
    return text if text.isascii() else unicodedata.normalize("NFC", skeleton(text))


@F.pandas_udf(T.BinaryType())
def _skeleton_digest(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else hashlib.sha256(skeleton(t).encode("utf-8", "surrogatepass")).digest())


@F.pandas_udf(T.StringType())
def _readable(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else readable(t))


def _beyond_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def normalized_text(text: Column) -> Column:
    """The consistent form of a text column; ASCII texts never leave the JVM."""
    return F.coalesce(_readable(F.when(_beyond_ascii(text), text)), text)


def skeleton_digest(text: Column) -> Column:
    """SHA-256 of the skeleton as binary; ASCII texts never leave the JVM."""
    return F.coalesce(_skeleton_digest(F.when(_beyond_ascii(text), text)), F.unhex(F.sha2(text, 256)))


def lookalike_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its class (the least key of equal skeletons), the class's size and number of spellings.

    Linear in the documents: copies are counted on digests with partial aggregation, never paired.
    """
    d = _digests(docs, key, text)
    classes = _spellings(d, key).groupBy("skeleton").agg(
        F.min("first").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_spellings")
    )
    return d.join(classes, "skeleton").select(key, "class_id", "n_docs", "n_spellings")


def lookalike_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b, n_a, n_b): one pair per two spellings of a skeleton, by the least key of each, and how many documents have each."""
    s = _links(_spellings(_digests(docs, key, text), key))
    swap = F.col("first_a") > F.col("first_b")
    return s.select(
        F.least("first_a", "first_b").alias("doc_a"), F.greatest("first_a", "first_b").alias("doc_b"),
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
    )


def lookalike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of documents with different texts and one skeleton, smaller key first.

    Spellings are paired first, by one representative each, then both sides are filled in with their
    documents, so copies of one text pair with nothing and no skeleton's documents meet in one task.
    """
    d = _digests(docs, key, text)
    links = _links(_spellings(d, key)).select("skeleton", "spelling_a", "spelling_b")
    a = d.select("skeleton", F.col("spelling").alias("spelling_a"), F.col(key).alias("a"))
    b = d.select("skeleton", F.col("spelling").alias("spelling_b"), F.col(key).alias("b"))
    return (
        small(links).join(a, ["skeleton", "spelling_a"]).join(b, ["skeleton", "spelling_b"]).where("a <> b")
        .select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
    )


def _digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, skeleton, spelling), written once: texts are read and digested a single time."""
    t = F.col(text)
    return cut_lineage(
        docs.where(t.isNotNull() & F.col(key).isNotNull())
        .select(key, skeleton_digest(t).alias("skeleton"), F.xxhash64(t).alias("spelling"))
        .dropDuplicates([key, "spelling"])
    )


def _spellings(d: DataFrame, key: str) -> DataFrame:
    return d.groupBy("skeleton", "spelling").agg(F.min(key).alias("first"), F.count("*").alias("n"))


def _links(spellings: DataFrame) -> DataFrame:
    several = spellings.groupBy("skeleton").count().where("count > 1").select("skeleton")
    s = cut_lineage(spellings.join(several, "skeleton", "left_semi"))
    a = s.select("skeleton", F.col("spelling").alias("spelling_a"), F.col("first").alias("first_a"), F.col("n").alias("n_a"))
    b = s.select("skeleton", F.col("spelling").alias("spelling_b"), F.col("first").alias("first_b"), F.col("n").alias("n_b"))
    return a.join(b, "skeleton").where("spelling_a < spelling_b")
