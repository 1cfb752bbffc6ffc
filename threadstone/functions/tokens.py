"""Token estimates by text length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """The words of a text, cut at white space."""
    return F.filter(F.split(_c(text), r"(?U)\s+"), lambda w: w != "")


def estimate_tokens(text) -> Column:
    """0 for null or empty texts, else the largest of a third of the characters (rounded up), the words, and 1."""
    t = _c(text)
    est = F.greatest(F.ceil(F.length(t) / 3.0).cast("long"), F.size(words(t)).cast("long"), F.lit(1).cast("long"))
    return F.when(t.isNull() | (t == ""), F.lit(0).cast("long")).otherwise(est)


def byte_tokens(text) -> Column:
    """A quarter of the bytes, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.octet_length(_c(text)) / 4), F.lit(0)).cast("long")
