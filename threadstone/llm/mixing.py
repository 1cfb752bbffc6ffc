"""Mixing sources to target weights as a time-varying curriculum.

Every source of a plan has a weight schedule over training time 0..1 whose integral is its share. The cumulative demand of a
source, in tokens, is that integral; inverting it at the tokens that lie before a document gives the document its training
position, and a range sort by position gives the order of training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadstone.session import Workspace

#: Documents that a bucket of a source should hold; running totals are made bucket by bucket, so this is what one task sorts.
ROWS_PER_BUCKET = 100_000
#: How far the schedules lean: 0 keeps every weight constant; 1 lets the steepest reach zero at one end.
LEAN = 0.6


def source_name(x: str) -> Column:
    """A source's name whatever the writing: lower case, no outer blanks, ``-`` as ``_``; null and blank become null."""
    return F.nullif(F.replace(F.lower(F.trim(F.col(x))), F.lit("-"), F.lit("_")), F.lit(""))


def schedules(targets: DataFrame, lean: float = LEAN) -> DataFrame:
    """Adds ``slope``: a source's weight at time t is ``share * (1 + slope * (2t - 1))``. Larger sources thin out, smaller ones
    grow, and the weights of a plan sum to its shares' sum at every t. A plan of equal shares keeps constant weights."""
    w = Window.partitionBy("plan_id")
    mean = F.coalesce(F.try_divide(F.sum(F.col("target_share") ** 2).over(w), F.sum("target_share").over(w)), F.lit(0.0))
    away = F.col("mean") - F.col("target_share")
    most = F.max(F.abs(away)).over(w)
    return targets.withColumn("mean", mean).withColumn("slope", F.when(most > 1e-12, F.lit(lean) * away / most).otherwise(0.0)).drop("mean")


def invert_demand(u: Column, slope: Column) -> Column:
    """Time at which a source has had the part u of its demand: the t in 0..1 with ``(1 - slope) t + slope t^2 = u``."""
    b = 1 - slope
    root = 2 * u / (b + F.sqrt(F.greatest(b * b + 4 * slope * u, F.lit(0.0))))
    return F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0))


def mix(docs: DataFrame, targets: DataFrame, lean: float = LEAN, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Documents for each plan, in training order, and the shares reached.

    ``docs``: ``doc_id, source, n_tokens``; ``targets``: ``plan_id, size_factor, source, target_share, max_repeats``. A plan
    wants ``size_factor`` times the tokens of all documents, and of each source its share of that. A source is passed over as
    often as its share needs, each pass in the same random order. The last pass takes the documents no longer than the rest
    as far as they fit; its last place goes to that one of all others which comes nearest to what is then missing, if it comes
    nearer than none.
    No document occurs more than ``max_repeats`` times. A source that can't fill its share gives all it may, and the
    others don't make up for it. Documents without tokens or without source are in no plan, but count in the total (0 tokens).
    A source in the plan without documents reaches 0; null shares or repeats count as 0; of several target rows of a plan and
    source the largest counts.

    First frame: ``plan_id, position, source, doc_id, repeat_no, n_tokens``, sorted by plan and position. Second: one row per
    plan and source. A hot source is summed in buckets, never in one task. Sizes are written and read while this is called.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    kept = ws.cut(docs.select("doc_id", source_name("source").alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")), "sizes")
    n_docs, total = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()  # one row
    buckets = n_docs // ROWS_PER_BUCKET + 16
    order = F.xxhash64(F.lit(seed), "doc_id")
    usable = kept.filter((F.col("n_tokens") > 0) & F.col("source").isNotNull())
    usable = usable.withColumn("ord", order).withColumn("bucket", F.floor((F.shiftright("ord", 1) + F.lit(2**62)) / F.lit(2**63 / buckets)).cast("int"))
    # one row per source and bucket
    sums = usable.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    run = Window.partitionBy("source").orderBy("bucket")
    sums = sums.select(
        "source", "bucket", (F.sum("t").over(run) - F.col("t")).alias("before_bucket"), F.sum("t").over(Window.partitionBy("source")).alias("supply"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = usable.withColumn("upto", F.sum("n_tokens").over(inside)).join(sums, ["source", "bucket"])
    placed = placed.select(
        "doc_id", "source", "n_tokens", "ord", "bucket", "supply", (F.col("before_bucket") + F.col("upto") - F.col("n_tokens")).alias("before")
    )
    placed = ws.cut(placed, "placed")  # read several times
    ws.drop("sizes")

    goal = targets.select(
        "plan_id", F.col("size_factor").cast("double").alias("size_factor"), source_name("source").alias("source"),
        F.coalesce("target_share", F.lit(0.0)).cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(0)).cast("long").alias("max_repeats"),
    ).filter(F.col("source").isNotNull())
    goal = goal.groupBy("plan_id", "source").agg(F.max(F.struct("target_share", "max_repeats", "size_factor")).alias("g")).select("plan_id", "source", "g.*")
    supply = placed.groupBy("source").agg(F.first("supply").alias("supply"))  # the same in all rows of a source
    goal = schedules(goal, lean).join(supply, "source", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    wanted = F.col("size_factor") * F.col("target_share") * F.lit(int(total))
    goal = goal.withColumn("wanted", wanted).withColumn("given", F.least(wanted, (F.col("supply") * F.col("max_repeats")).cast("double")))
    goal = goal.withColumn("passes", F.when(F.col("supply") > 0, F.floor(F.col("given") / F.col("supply"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("given") - F.col("passes") * F.col("supply"))

    goal = ws.cut(goal, "goal")
    need = goal.filter("given > 0").select("plan_id", "source", "passes", "rest", "given", "slope")
    key = ["plan_id", "source"]
    hit = placed.join(need, "source").withColumn("small", F.col("n_tokens") <= F.col("rest"))
    # the bucket in which the documents that are no longer than the rest reach it: from one row per plan, source and bucket
    along = Window.partitionBy(*key).orderBy("bucket")
    levels = hit.filter("small").groupBy(*key, "bucket").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    levels = levels.withColumn("below", F.sum("t").over(along) - F.col("t")).filter(F.col("below") + F.col("t") > F.col("rest"))
    edge = levels.groupBy(*key).agg(F.min(F.struct("bucket", "below")).alias("e")).select(*key, F.col("e.bucket").alias("edge"), F.col("e.below").alias("below"))
    # these tables have a row per plan and source; each is cut, so that no later step works it out again
    hit = hit.join(ws.cut(edge, "edge"), key, "left")
    # in that bucket alone documents are counted one by one
    last = hit.filter(F.col("small") & (F.col("bucket") == F.col("edge")))
    last = last.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy(*key).orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    last = last.filter(F.col("below") + F.col("upto") <= F.col("rest")).groupBy(*key).agg(F.max(F.struct("ord", "doc_id")).alias("upmost"))
    hit = hit.join(ws.cut(last, "last"), key, "left")
    inside = F.col("edge").isNull() | (F.col("bucket") < F.col("edge")) | F.coalesce(F.struct("ord", "doc_id") <= F.col("upmost"), F.lit(False))
    hit = hit.withColumn("fits", F.col("small") & inside)
    filled = hit.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(F.col("fits"), F.col("n_tokens"))), F.lit(0)).alias("filled"), F.max(F.when(F.col("fits"), F.col("before") + F.col("n_tokens"))).alias("cut"),
    )
    hit = hit.join(ws.cut(filled, "filled"), key).withColumn("off", F.abs(F.col("n_tokens") - (F.col("rest") - F.col("filled"))))
    nearest = hit.filter(~F.col("fits") & (F.col("off") < F.col("rest") - F.col("filled")))
    nearest = nearest.groupBy(*key).agg(F.min_by("doc_id", F.struct("off", "ord", "doc_id")).alias("last_doc"))
    hit = hit.join(ws.cut(nearest, "nearest"), key, "left")
    ends = F.coalesce(F.col("doc_id") == F.col("last_doc"), F.lit(False))
    # the pass's places are drawn together to the tokens that it has
    hit = hit.withColumn("late", F.when(F.col("fits"), F.col("before") * F.col("filled") / F.col("cut")).otherwise(F.col("filled")))
    hit = hit.withColumn("times", (F.col("passes") + F.when(F.col("fits") | ends, 1).otherwise(0)).cast("int")).filter("times > 0")
    hit = hit.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("times"))))
    own = F.when(F.col("repeat_no") > F.col("passes"), F.col("late")).otherwise(F.col("before"))
    part = ((F.col("repeat_no") - 1) * F.col("supply") + own + F.col("n_tokens") / 2) / F.col("given")
    chosen = hit.select("plan_id", invert_demand(F.least(part, F.lit(1.0)), F.col("slope")).alias("position"), "source", "doc_id", "repeat_no", "n_tokens")

    reached = chosen.groupBy("plan_id", "source").agg(
        F.sum("n_tokens").alias("reached_tokens"), F.count(F.lit(1)).alias("n_rows"), F.max("repeat_no").alias("most_repeats")
    )
    nil = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = goal.select("plan_id", "source", "target_share", F.col("wanted").alias("wanted_tokens"), "max_repeats").join(reached, ["plan_id", "source"], "left")
    report = report.select("plan_id", "source", "target_share", "max_repeats", "wanted_tokens", nil("reached_tokens"), nil("n_rows"), nil("most_repeats"))
    by_plan = Window.partitionBy("plan_id")
    share = lambda c: F.when(F.sum(c).over(by_plan) > 0, F.col("reached_tokens") / F.sum(c).over(by_plan)).otherwise(0.0)
    report = report.withColumn("reached_share", share("reached_tokens")).withColumn("share_of_wanted", share("wanted_tokens"))
    return chosen.orderBy("plan_id", "position", "source", "doc_id", "repeat_no"), report
