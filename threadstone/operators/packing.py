"""Packing ranked items into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pack(items: DataFrame, group: list[str], key: str, score: str, tokens: str, budget: int) -> DataFrame:
    """Greedy packing with skips per group: by score per token, then score, then fewer tokens, then key; an item that doesn't
    fit is passed over. Gives the group, key, tokens, pack_rank and used (tokens so far) of what is taken.

    Null tokens count as 0 and null scores as 0. Items of no tokens are taken, as they fit. Of one size t no more than
    budget/t items can be taken, and the earlier ones of a size go first; so what a group folds is bounded by the budget
    (about budget * ln budget items), however many rows it has.
    """
    t, s = F.coalesce(tokens, F.lit(0)).cast("long"), F.coalesce(score, F.lit(0.0)).cast("double")
    ranked = items.select(*group, F.col(key).alias("_key"), t.alias("_t"), s.alias("_s")).filter(F.col("_t") <= budget)
    paid, free = ranked.filter("_t > 0"), ranked.filter("_t <= 0")
    same = Window.partitionBy(*group, "_t").orderBy(F.desc("_s"), "_key")
    paid = paid.withColumn("_n", F.row_number().over(same)).filter((F.col("_n") <= budget) & (F.col("_n") <= F.floor(F.lit(budget) / F.col("_t")))).drop("_n")
    item = F.struct((-F.col("_s") / F.col("_t")).alias("d"), (-F.col("_s")).alias("s"), F.col("_t").alias("t"), F.col("_key").alias("k"))
    folded = paid.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kind = f"array<struct<k:{items.schema[key].dataType.simpleString()},t:bigint,used:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("taken"))
    step = lambda a, x: F.when(
        a["used"] + x["t"] <= budget,
        F.struct((a["used"] + x["t"]).alias("used"), F.concat(a["taken"], F.array(F.struct(x["k"].alias("k"), x["t"].alias("t"), (a["used"] + x["t"]).alias("used")))).alias("taken")),
    ).otherwise(a)
    taken = folded.select(*group, F.posexplode(F.aggregate("_items", start, step)["taken"]).alias("pos", "x"))
    out = taken.select(*group, F.col("x.k").alias(key), F.col("x.t").alias(tokens), (F.col("pos") + 1).alias("pack_rank"), F.col("x.used").alias("used"))
    nothing = free.select(*group, F.col("_key").alias(key), F.col("_t").alias(tokens), F.lit(0).alias("pack_rank"), F.lit(0).cast("long").alias("used"))
    return out.unionByName(nothing)


def pack_prefix(items: DataFrame, group: list[str], order: list, tokens: str, budget: int) -> DataFrame:
    """The leading items of each group, in order, until the next one would exceed the budget: all columns, with ``used``.
    Every item counts at least 1 token, so no more than ``budget`` rows of a group matter; the others are cut off before the
    running total. ``order`` should end in a unique key."""
    w = Window.partitionBy(*group).orderBy(*order)
    t = F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(1)).cast("long")
    near = items.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= budget)
    run = near.withColumn("used", F.sum(t).over(Window.partitionBy(*group).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter(F.col("used") <= budget).drop("_n")
