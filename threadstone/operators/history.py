"""History of changing entity attributes, kept as checkpoints and patches.

Observations become a change log: the first change of an entity in each checkpoint period is stored whole, every other change
as a patch that holds the changed attributes only. Validity rows come from folding the patches forward from the nearest
checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Length of a checkpoint period in seconds. An entity's rows of one period are what one window has to sort.
PERIOD_S = 90 * 86_400


def observations(
    df: DataFrame, entity: Column, at: Column, order: list[Column], attributes: dict[str, Column], usable: Column, born: Column | None = None
) -> DataFrame:
    """One row per entity and time: ``entity, at_s, state, born_s``, the state the last usable one by ``order`` of several, null where
    no row is usable; ``born_s`` is the earliest time of ``born`` in any row. Rows without entity or time count for birth only, as
    rows of no time. Aggregated once, before the shuffle, so that copies of a hot entity shrink."""
    seconds = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000).cast("long")
    return (
        df.select(
            entity.alias("entity"), seconds(at).alias("at_s"), seconds(born if born is not None else F.lit(None)).alias("born"),
            F.when(usable, F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), F.struct(*[c.alias(k) for k, c in attributes.items()]).alias("state"))).alias("v"),
        )
        .filter(F.col("entity").isNotNull())
        .groupBy("entity", "at_s").agg(F.max("v").alias("v"), F.min("born").alias("born_s"))
        .select("entity", "at_s", F.when(F.col("at_s").isNotNull(), F.col("v.state")).alias("state"), "born_s")
    )


def births(obs: DataFrame) -> DataFrame:
    """``entity, born_s`` of all rows of an entity, whether observations or not."""
    return obs.groupBy("entity").agg(F.min("born_s").alias("born_s"))


def change_log(obs: DataFrame, attributes: list[str], period_s: int = PERIOD_S) -> DataFrame:
    """Checkpoint-delta storage: ``entity, period, at_s, is_checkpoint, is_change, patch``.

    One row per change of an entity, and one at the first observation in each period, stored whole (a checkpoint). ``patch`` has
    a struct ``{v}`` per attribute: null where the attribute didn't change, else its new value, which may be null. Equal states
    in a row, also over periods and gaps, are no change. `is_change` is false at a checkpoint that repeats the state before it.
    Rows of obs without state are no observations.
    """
    obs = obs.filter(F.col("state").isNotNull())
    byp = Window.partitionBy("entity", "period").orderBy("at_s")
    seen = obs.withColumn("period", F.floor(F.col("at_s") / period_s).cast("long"))
    seen = seen.withColumn("before", F.lag("state").over(byp)).withColumn("first", F.row_number().over(byp) == 1)
    kept = seen.filter(F.col("first") | ~F.col("state").eqNullSafe(F.col("before")))
    # what the period before ended with: one small row per entity and period
    ends = obs.groupBy("entity", F.floor(F.col("at_s") / period_s).cast("long").alias("period")).agg(F.max(F.struct("at_s", "state")).alias("e"))
    ends = ends.withColumn("carried", F.lag("e.state").over(Window.partitionBy("entity").orderBy("period"))).select("entity", "period", "carried")
    kept = kept.join(ends, ["entity", "period"])
    changed = lambda a: F.when(F.col("first") | ~F.col(f"state.{a}").eqNullSafe(F.col(f"before.{a}")), F.struct(F.col(f"state.{a}").alias("v")))
    return kept.select(
        "entity", "period", "at_s", F.col("first").alias("is_checkpoint"),
        (~F.col("first") | F.col("carried").isNull() | ~F.col("state").eqNullSafe(F.col("carried"))).alias("is_change"),
        F.struct(*[changed(a).alias(a) for a in attributes]).alias("patch"),
    )


def fold(log: DataFrame, attributes: list[str]) -> DataFrame:
    """Versions from a change log: ``entity, at_s, <attributes>, valid_to_s`` (null while a version still holds).
    Each attribute is the last one patched since the checkpoint of its period."""
    since = Window.partitionBy("entity", "period").orderBy("at_s").rowsBetween(Window.unboundedPreceding, 0)
    full = log.select("entity", "period", "at_s", "is_change", *[F.last(f"patch.{a}", ignorenulls=True).over(since)["v"].alias(a) for a in attributes])
    versions = full.filter("is_change")
    # the end of a version: the next change in its period, else the first change of a later period
    byp = Window.partitionBy("entity", "period").orderBy("at_s")
    starts = versions.groupBy("entity", "period").agg(F.min("at_s").alias("starts"))
    starts = starts.withColumn("then", F.lead("starts").over(Window.partitionBy("entity").orderBy("period"))).drop("starts")
    return versions.withColumn("next", F.lead("at_s").over(byp)).join(starts, ["entity", "period"]).select(
        "entity", "at_s", *attributes, F.coalesce("next", "then").alias("valid_to_s")
    )


def as_of(log: DataFrame, attributes: list[str], at_s: int | None = None) -> DataFrame:
    """State of each entity at a time, by default the last one: from the last checkpoint at or before it, patched forward, with the
    time of the last row that says so: ``entity, <attributes>, since_s``. Entities not yet seen are absent."""
    past = log if at_s is None else log.filter(F.col("at_s") <= at_s)
    near = past.groupBy("entity").agg(F.max("period").alias("period"))
    agg = [F.max_by(F.col(f"patch.{a}"), F.when(F.col(f"patch.{a}").isNotNull(), F.col("at_s")))["v"].alias(a) for a in attributes]
    return past.join(near, ["entity", "period"]).groupBy("entity").agg(*agg, F.max("at_s").alias("since_s"))


class ChangeLog:
    """A change log kept as a table: snapshots are appended as checkpoints and patches, and states and versions are read from it.
    What is written is never rewritten."""

    def __init__(self, spark: SparkSession, path: str, attributes: list[str], period_s: int = PERIOD_S):
        self.spark, self.path, self.attributes, self.period_s = spark, path, attributes, period_s
        self.parts = 0

    def log(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/part={i}" for i in range(self.parts)])

    def append(self, obs: DataFrame) -> None:
        """Adds observations (``entity, at_s, state``), all of them after what is stored of their entity; an earlier one is an error,
        since what was unchanged around it isn't kept. Patches say what changed since the stored state."""
        obs = obs.filter(F.col("state").isNotNull()).select("entity", "at_s", "state")
        if not self.parts:
            new = change_log(obs, self.attributes, self.period_s)
        else:
            last = as_of(self.log(), self.attributes).select("entity", F.col("since_s").alias("at_s"), F.struct(*self.attributes).alias("state"))
            late = obs.join(last.select("entity", F.col("at_s").alias("since_s")), "entity").filter(F.col("at_s") <= F.col("since_s"))
            if late.limit(1).count():
                raise ValueError("observations that aren't after the stored ones of their entity")
            # the stored state is the row before the first new one, and isn't written again
            touched = last.join(obs.select("entity").distinct(), "entity", "left_semi")
            both = change_log(obs.unionByName(touched), self.attributes, self.period_s)
            new = both.join(touched.select("entity", F.col("at_s").alias("since_s")), "entity", "left").filter(F.col("since_s").isNull() | (F.col("at_s") > F.col("since_s"))).drop("since_s")
        new.write.mode("overwrite").parquet(f"{self.path}/part={self.parts}")
        self.parts += 1

    def versions(self) -> DataFrame:
        return fold(self.log(), self.attributes)

    def as_of(self, at_s: int) -> DataFrame:
        return as_of(self.log(), self.attributes, at_s)
