"""Life of memories and edges: supersession, conflicts, decay, consolidation, staleness, distillation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadstone.functions.text import commit_parts, is_conflict, trimmed
from threadstone.operators.ordered import neighbours


def supersede(df: DataFrame, entity: list[str], key: str, at: str) -> DataFrame:
    """Versions of an entity by time: each is ended by the next one, which supersedes it: adds ``valid_until, superseded_by,
    status``. Equal times go by key. Rows without time come first and are ended like others."""
    near = neighbours(df, entity, at, key, [at, key], before=False)
    out = near.withColumn("valid_until", F.col(f"_near.{at}")).withColumn("superseded_by", F.col(f"_near.{key}"))
    out = out.withColumn("status", F.when(F.col("_near.there"), "superseded").otherwise("active"))
    return out.drop("_near", "_at", "_tie", "_stretch")


def conflicts(rules: DataFrame, key: str, kind: str, text: str, order: list) -> DataFrame:
    """Pairs of rules of one kind that contradict each other, the newer first: ``first, second, kind``. Meant for the short
    list of active rules; its size bounds the pairs."""
    n = rules.select(F.col(key).alias("id"), F.col(kind).alias("kind"), F.col(text).alias("text"), F.row_number().over(Window.orderBy(*order)).alias("n"))
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.n") < F.col("b.n"))).filter(is_conflict("a.text", "b.text"))
    return pairs.select(F.col("a.id").alias("first"), F.col("b.id").alias("second"), F.col("a.kind").alias("kind"))


def decay_exponential(weight: Column, days: Column, tau_days: float = 30.0) -> Column:
    """Weight after some days with a mean life: within 0..1; days before the start count as none."""
    return F.least(F.greatest(weight * F.exp(-F.greatest(days, F.lit(0.0)) / tau_days), F.lit(0.0)), F.lit(1.0))


def decay_half_life(weight: Column, days: Column, half_life_days: float = 30.0) -> Column:
    return weight * F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / half_life_days)


def days_between(start, end) -> Column:
    return (F.unix_micros(F.to_timestamp(end)) - F.unix_micros(F.to_timestamp(start))) / F.lit(86_400_000_000.0)


def prune(edges: DataFrame, weight: str, threshold: float = 0.15) -> DataFrame:
    """Edges that still count; null weights don't."""
    return edges.filter(F.col(weight) >= threshold)


def consolidate(incidents: DataFrame, component: Column, key: str, symptom: str, resolution: str, order: list) -> DataFrame:
    """One rule per component from its incidents, in order: symptoms joined by `` | ``, numbered resolutions, the incidents'
    ids, confidence ``min(1, 0.5 + 0.1 n)`` and a rule id. Meant for the short list of the newest incidents."""
    rows = incidents.select(component.alias("component"), F.col(key).alias("id"), F.coalesce(symptom, F.lit("")).alias("s"), F.coalesce(resolution, F.lit("")).alias("r"), F.row_number().over(Window.orderBy(*order)).alias("n"))
    grouped = rows.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("n", "id", "s", "r"))).alias("x"), F.count(F.lit(1)).alias("n_incidents"))
    return grouped.select(
        F.concat(F.lit("rule_"), F.regexp_replace(F.lower("component"), "[ /-]", "_")).alias("rule_id"), "component", "n_incidents",
        F.array_join(F.transform("x", lambda v: v["s"]), " | ").alias("condition_pattern"),
        F.array_join(F.transform("x", lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v["r"])), "\n").alias("prescribed_solution"),
        F.array_join(F.transform("x", lambda v: v["id"]), ",").alias("incident_ids"),
        F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * F.col("n_incidents")).alias("confidence"),
    )


def stale(snapshots: DataFrame, model: str, path: str, old_hash: str, current: DataFrame, cur_path: str, cur_hash: str) -> DataFrame:
    """Models of which a file has changed or is gone since their snapshot: ``<model>, is_stale, n_changed, n_missing``. One row
    per model and file comes in; joined on the path, never collected per model."""
    now = current.select(F.col(cur_path).alias("_p"), F.col(cur_hash).alias("_h"), F.lit(True).alias("_there"))
    seen = snapshots.select(model, F.col(path).alias("_p"), F.col(old_hash).alias("_old")).join(now, "_p", "left")
    gone = F.col("_there").isNull()
    changed = ~gone & ~F.col("_h").eqNullSafe(F.col("_old"))
    return seen.groupBy(model).agg(F.bool_or(gone | changed).alias("is_stale"), F.count_if(changed).alias("n_changed"), F.count_if(gone).alias("n_missing"))


def distill(commits: DataFrame, key: str, message: str, author: Column) -> DataFrame:
    """Memories from commits with a known type: ``source_hash, kind, title, content, author, tags``. Others are dropped."""
    kind, title, says = commit_parts(message)
    content = F.concat(says, F.lit(" "), F.col(key).cast("string"), F.lit(": "), trimmed(message))
    rows = commits.select(F.col(key).alias("source_hash"), kind.alias("kind"), title.alias("title"), content.alias("content"), F.concat(F.lit("git:"), author).alias("author"))
    rows = rows.filter(F.col("kind").isNotNull())
    return rows.select("source_hash", "kind", "title", "content", "author", F.array(F.lit("distilled"), F.lit("git"), "kind").alias("tags"))


def not_stored(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored yet; null keys count as new."""
    return new.join(stored.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
