"""Neighbours in the order of time within a key, without one task per key.

A window over a key sorts all of the key's rows in one task. Here rows are ordered within stretches of time, and one small row
per key and stretch carries what lies across their borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a stretch in seconds.
STRETCH_S = 86_400


def stretch(at: str, seconds: int = STRETCH_S) -> Column:
    """The stretch a time falls into; rows without time have one of their own, before all others."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    return F.coalesce(F.floor(us / (seconds * 1_000_000)).cast("long"), F.lit(-(2**62)))


def _windows(by: list[str]) -> tuple:
    return Window.partitionBy(*by, "_stretch").orderBy(F.asc_nulls_first("_at"), "_tie"), Window.partitionBy(*by).orderBy("_stretch")


def neighbours(df: DataFrame, by: list[str], at: str, tie: str, what: list[str], before: bool = True, seconds: int = STRETCH_S) -> DataFrame:
    """df with ``_near``: a struct of the columns ``what`` of the row before (or after) in the order of time and tie-breaker, null
    at the ends; and ``_at, _tie, _stretch``. Equal keys of null count as one key."""
    inside, across = _windows(by)
    d = df.withColumn("_at", F.col(at)).withColumn("_tie", F.col(tie)).withColumn("_stretch", stretch(at, seconds))
    row = F.struct(*[F.col(c).alias(f"w{i}") for i, c in enumerate(what)])
    edge = (F.max_by if before else F.min_by)(row, F.struct(F.col("_at").isNotNull(), "_at", "_tie"))
    ends = d.groupBy(*by, "_stretch").agg(edge.alias("_e"))
    ends = ends.withColumn("_over", (F.lag if before else F.lead)("_e").over(across)).drop("_e")
    near = d.withColumn("_in", (F.lag if before else F.lead)(row).over(inside))
    same = [near[c].eqNullSafe(ends[c]) for c in [*by, "_stretch"]]
    joined = near.join(ends, on=same[0] if len(same) == 1 else _all(same)).select(near["*"], ends["_over"])
    near_row = F.coalesce("_in", "_over")
    return joined.withColumn("_near", F.struct(*[near_row[f"w{i}"].alias(c) for i, c in enumerate(what)], near_row.isNotNull().alias("there"))).drop("_in", "_over")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def since_start(df: DataFrame, by: list[str], start: str, out: str) -> DataFrame:
    """df, as `neighbours` gives it, with the number of rows since the last one where ``start`` is true, that one counted as 1.
    The first row of a key is a start."""
    inside, across = _windows(by)
    n = F.row_number().over(inside)
    d = df.withColumn("_n", n).withColumn("_s", F.max(F.when(F.col(start), F.col("_n"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = df.withColumn("_n", n).groupBy(*by, "_stretch").agg(F.count(F.lit(1)).alias("_rows"), F.max(F.when(F.col(start), F.col("_n"))).alias("_last"))
    tail = F.when(F.col("_last").isNull(), F.col("_rows")).otherwise(F.col("_rows") - F.col("_last") + 1)
    sums = sums.withColumn("_run", F.sum(F.when(F.col("_last").isNull(), 0).otherwise(1)).over(across)).withColumn("_tail", tail)
    upto = F.sum("_tail").over(Window.partitionBy(*by, "_run").orderBy("_stretch"))
    sums = sums.withColumn("_open", upto).withColumn("_carry", F.coalesce(F.lag("_open").over(across), F.lit(0))).select(*by, "_stretch", "_carry")
    same = [d[c].eqNullSafe(sums[c]) for c in [*by, "_stretch"]]
    joined = d.join(sums, on=_all(same)).select(d["*"], sums["_carry"])
    count = F.when(F.col("_s").isNull(), F.col("_n") + F.col("_carry")).otherwise(F.col("_n") - F.col("_s") + 1)
    return joined.withColumn(out, count).drop("_n", "_s", "_carry")
