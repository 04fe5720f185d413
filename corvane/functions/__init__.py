"""Column functions with the exact semantics of the engine's text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
"""Unicode white space, as a class that Java and RE2 read alike."""


def ascii_strip(s: Column) -> Column:
    """Drop every character beyond ASCII."""
    return F.regexp_replace(s, r"[^\x00-\x7F]", "")


def white_strip(s: Column) -> Column:
    """Strip Unicode white space on both sides (SQL trim strips spaces only)."""
    return F.regexp_replace(s, f"^{WHITE}+|{WHITE}+$", "")


def line_array(s: Column) -> Column:
    """Lines between ``\\n``; the empty text has one."""
    return F.split(s, "\n", -1)


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``path:start:end``."""
    return F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string")), 256), 1, 16)


def project_id(path: Column) -> Column:
    """First 16 hex digits of the SHA-256 of an absolute path."""
    return F.substring(F.sha2(path, 256), 1, 16)


def extension(path: Column) -> Column:
    """The last suffix with its dot; names that begin with their only dot have none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def folder(path: Column) -> Column:
    """The parent folder, ``.`` at the top level."""
    f = F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
    return F.when(f == "", ".").otherwise(f)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def after_first_line(s: Column) -> Column:
    """The text behind the first line end, else the empty text."""
    return F.when(F.instr(s, "\n") > 0, s.substr(F.instr(s, "\n") + 1, F.length(s))).otherwise("")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; null for a zero vector.  The length is computed once per row, not per element."""
    n = norm(a)
    return F.when(n > 0, F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, m: x.cast("double") / m))


def tokens_about(s: Column) -> Column:
    """The default token count: a quarter of the characters, rounded up."""
    return F.ceil(F.length(s) / 4).cast("long")


def cut(s: Column, n: int) -> Column:
    """At most ``n`` characters, marked where text was cut."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("\n... (truncated)"))).otherwise(s)
