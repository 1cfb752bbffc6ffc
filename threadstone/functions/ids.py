"""Identifier derivation and canonical forms of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_id(path) -> Column:
    """Hex SHA-256 of the path with ``/`` as separator."""
    return F.sha2(F.replace(_c(path), F.lit("\\"), F.lit("/")), 256)


def symbol_id(file, qualified_name) -> Column:
    """SHA-256 of ``file_id::qualified_name``."""
    return F.sha2(F.concat(_c(file), F.lit("::"), _c(qualified_name)), 256)


def content_hash(text) -> Column:
    return F.sha2(_c(text), 256)


def chunk_id(file, symbol, kind, chash) -> Column:
    """SHA-256 of file id, symbol id (or nothing), kind and content hash, without separators."""
    return F.sha2(F.concat(_c(file), F.coalesce(_c(symbol), F.lit("")), _c(kind), _c(chash)), 256)


def vector_set_id(model, quantization, dim, pooling, normalized) -> Column:
    """SHA-256 naming a set of comparable vectors."""
    norm = F.when(_c(normalized), F.lit("norm:true")).otherwise(F.lit("norm:false"))
    return F.sha2(F.concat(_c(model), _c(quantization), _c(dim).cast("string"), _c(pooling), norm), 256)


def canonical_id(x) -> Column:
    """The record that an id names, whatever the writing: lower case, no outer blanks, no record-link notation
    (``table:id`` or ``table:⟨id⟩``). Null and blank become null."""
    low = F.lower(F.trim(_c(x)))
    bare = F.when(F.contains(low, F.lit(":")), F.regexp_replace(low, r"^[a-z_]+:", "")).otherwise(low)
    return F.nullif(F.translate(bare, "⟨⟩` \t\n\x0b\f\r", ""), F.lit(""))


def _without(x: Column, form: str) -> Column:
    """A text without what the form matches, again and again, once per opening bracket."""
    n = F.size(F.split(x, "[<(]"))
    return F.when(x.rlike("[<(]"), F.aggregate(F.sequence(F.lit(1), n), x, lambda s, _: F.regexp_replace(s, form, ""))).otherwise(x)


def bare_callee(x) -> Column:
    """The bare name of a callee as written in source: no qualification, receiver, type arguments, call mark or blanks.
    Brackets go innermost first, however deep; what follows one that stays open is no name. Letter case is kept. Null and
    blank become null."""
    s = F.replace(F.translate(_c(x), " \t\n\x0b\f\r", ""), F.lit("->"), F.lit("."))
    s = F.when(F.endswith(s, F.lit(")")), F.regexp_replace(s, r"!?\([^()<>]*\)$", "")).otherwise(s)
    inner = s
    for form in (r"<[^<>()]*>|\([^<>()]*\)", r"\([^()]*\)", r"<[^<>]*>"):
        inner = _without(inner, form)
    inner = F.regexp_replace(F.regexp_replace(inner, r"!?\(.*$|!$", ""), r"(::)+$", "")
    # most names have neither brackets nor marks
    s = F.when(s.rlike(r"[<(!>]|::$"), inner).otherwise(s)
    s = F.when(s.rlike(r"[.:>]"), F.regexp_extract(s, r"([^.:>]*)$", 1)).otherwise(s)
    return F.nullif(s, F.lit(""))
