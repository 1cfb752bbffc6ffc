"""Merging new states into stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; aggregated before the shuffle, so hot keys shrink where they are."""
    rest = [c for c in df.columns if c not in key]
    packed = df.select(*key, F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"), F.struct(*rest).alias("_v"))
    best = packed.groupBy(*key).agg(F.max_by("_v", "_o").alias("_v"))
    return best.select(*key, *[F.col(f"_v.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The stored rows with new ones in place of those of equal keys. Keys are unique on either side; null keys never match."""
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


def classify(stored: DataFrame, present: DataFrame, key: str, content: str) -> DataFrame:
    """What a sync has to do: ``<key>, change`` of added, updated, unchanged or removed. Unknown contents count as updated."""
    a = stored.select(F.col(key).alias("_a"), F.col(content).alias("_ac"))
    b = present.select(F.col(key).alias("_b"), F.col(content).alias("_bc"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_ac") == F.col("_bc"), "unchanged").otherwise("updated")
    return both.select(F.coalesce("_a", "_b").alias(key), change.alias("change"))


def unknown(present: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """Present rows not stored with the same content."""
    return present.join(stored.select(key, content).distinct(), [key, content], "left_anti")


def without(df: DataFrame, reference: Column, gone: DataFrame, key: str) -> DataFrame:
    """Rows that don't refer to a deleted record."""
    return df.withColumn("_ref", reference).join(gone.select(F.col(key).alias("_ref")).distinct(), "_ref", "left_anti").drop("_ref")


def enrich_calls(calls: DataFrame, symbols: DataFrame, caller: Column, callee: Column) -> DataFrame:
    """One edge per caller and callee, as last written (largest line of the latest), with the caller's name or else its id:
    ``caller_id, callee_name, caller_name, line, n_calls``."""
    edges = calls.select(caller.alias("caller_id"), callee.alias("callee_name"), "line", F.struct("valid_from", "line", "edge_id").alias("o"))
    edges = edges.filter(F.col("caller_id").isNotNull() & F.col("callee_name").isNotNull())
    one = edges.groupBy("caller_id", "callee_name").agg(F.max_by("line", "o").alias("line"), F.countDistinct("o.edge_id").alias("n_calls"))
    return one.join(symbols, "caller_id", "left").select("caller_id", "callee_name", F.coalesce("caller_name", "caller_id").alias("caller_name"), "line", "n_calls")


def link_by_name(df: DataFrame, key: str, name: str, symbols: DataFrame) -> DataFrame:
    """The first symbol, by id, of which the name or the qualified name is the one referred to: ``<key>, symbol_id``. Two
    equi-joins instead of one on either."""
    want = df.filter(F.col(name).isNotNull()).select(key, F.col(name).alias("_n"))
    by = lambda c: symbols.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_n")).agg(F.min("symbol_id").alias("symbol_id"))
    both = by("name").unionByName(by("qualified_name")).groupBy("_n").agg(F.min("symbol_id").alias("symbol_id"))
    return want.join(both, "_n").select(key, "symbol_id").distinct()
