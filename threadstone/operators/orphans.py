"""References to records that do not exist.

Parents (records that can be referred to) are range-partitioned by their key, and within a key that has very many by the begin of
their lives. Each range holds them as sorted arrays of keys and life intervals. Batches of references are probed by binary search
in the range they fall into, and the misses come out; `orphan_report` counts them per table and period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadstone.session import Workspace

#: Parents that one range should hold; a range of that many needs some tens of MB in a task.
ROWS_PER_RANGE = 100_000
#: References that one probe task should hold; a range with more is probed by several tasks, each with its own copy of the parents.
REFS_PER_PROBE = 500_000
#: Parents of the sample from which the ranges' bounds are taken, per range. It balances ranges and changes no result.
SAMPLE_PER_RANGE = 40
#: Parents whose lives a task merges at a time before they move.
MERGE_ROWS = 200_000
FOREVER = np.iinfo(np.int64).max
EVER = np.iinfo(np.int64).min


def references(df: DataFrame, table: str, field: str, row_id: str, key, at) -> DataFrame:
    """Rows of a table as references: ``src_table, field_name, row_id, key, at_us``.

    A null or blank key is no reference. A null time is taken as the end of all time (the newest state decides) and has a
    null period.
    """
    return df.select(
        F.lit(table).alias("src_table"), F.lit(field).alias("field_name"), F.col(row_id).cast("long").alias("row_id"),
        key.alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"),
    ).filter(F.col("key").isNotNull() & (F.trim("key") != ""))


def parents(df: DataFrame, space: str, key, begin: str | None, end: str | None) -> DataFrame:
    """Records that can be referred to: ``space, key, from_us, to_us``. Null begin: there from ever; null end: still there."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if c else F.lit(None).cast("long")
    return df.select(
        F.lit(space).alias("space"), key.alias("key"),
        F.coalesce(us(begin), F.lit(EVER)).alias("from_us"), F.coalesce(us(end), F.lit(FOREVER)).alias("to_us"),
    ).filter(F.col("key").isNotNull())


# ---- lives ----------------------------------------------------------------------------------------------------------


def _sorted(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Codes of keys, begins and ends in the order of key and begin, and the distinct keys in their order."""
    t = t.take(pc.sort_indices(t, sort_keys=[("key", "ascending"), ("from_us", "ascending")]))
    keys = t.column("key").combine_chunks().dictionary_encode()
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    return keys.indices.to_numpy(), t.column("from_us").to_numpy(), t.column("to_us").to_numpy(), keys.dictionary


def _reach(code: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The latest end among the lives of a key that begin no later."""
    ends, at = np.unique(end, return_inverse=True)
    step = len(ends) + 1
    return ends[np.maximum.accumulate(at + code.astype(np.int64) * step) - code.astype(np.int64) * step]


def merge_lives(t: pa.Table) -> pa.Table:
    """Lives that overlap or meet become one: the disjoint lives of each key."""
    if not t.num_rows:
        return t.select(["key", "from_us", "to_us"])
    code, begin, end, keys = _sorted(t)
    reach = _reach(code, end)
    new = np.r_[True, (code[1:] != code[:-1]) | (begin[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    last = np.r_[at[1:] - 1, len(new) - 1]
    return pa.table({"key": keys.take(pa.array(code[at])), "from_us": begin[at], "to_us": reach[last]})


def _merged(pars: DataFrame) -> DataFrame:
    """Parents with the lives merged that a task has at hand; what is left to merge meets in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= MERGE_ROWS:
                yield from merge_lives(pa.Table.from_batches(held)).to_batches()
                held, rows = [], 0
        if rows:
            yield from merge_lives(pa.Table.from_batches(held)).to_batches()

    return pars.mapInArrow(run, "key string, from_us long, to_us long")


# ---- ranges ---------------------------------------------------------------------------------------------------------


def _range_of(keys: np.ndarray, times: np.ndarray):
    """A function of (key, time) that gives the range: the number of bounds that aren't after it."""

    @F.arrow_udf("int")
    def run(key: pa.Array, at: pa.Array) -> pa.Array:
        codes = key.dictionary_encode()
        own = codes.dictionary.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        which = codes.indices.to_numpy()
        out = high[which].astype(np.int32)
        split = np.flatnonzero(high > low)  # keys that bounds cut: at most as many as there are bounds
        for i in split:
            rows = np.flatnonzero(which == i)
            out[rows] = low[i] + np.searchsorted(times[low[i] : high[i]], at.to_numpy()[rows], "right")
        return pa.array(out, pa.int32())

    return run


def _bounds(lives: DataFrame, n_ranges: int, n_lives: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal-depth bounds (key, begin), in order, from a sample of a fixed number of rows per range."""
    part = min(1.0, SAMPLE_PER_RANGE * n_ranges / max(1, n_lives))
    sample = sorted((r.key, r.from_us) for r in lives.sample(part, 7).select("key", "from_us").collect())
    step = max(1, len(sample) // n_ranges)
    cuts = sorted(set(sample[step::step]))
    return np.array([k for k, _ in cuts], object), np.array([t for _, t in cuts], np.int64)


def _carried(ranged: DataFrame, cut_keys: list[str]) -> DataFrame:
    """What a key's lives in earlier ranges reach into later ones, for the keys that bounds cut: a row per such key and range."""
    own = ranged.filter(F.col("key").isin(cut_keys)).groupBy("key", "range").agg(F.max("to_us").alias("to_us"))
    over = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("to_us", F.max("to_us").over(over)).filter(F.col("to_us").isNotNull()).select("key", F.lit(EVER).alias("from_us"), "to_us", "range")


# ---- probes ---------------------------------------------------------------------------------------------------------


def probe(keys: pa.Array, at: np.ndarray, lives: pa.Table) -> np.ndarray:
    """For each reference (key, time), whether a parent of the key lives then. Binary search in sorted arrays, whole batches at once."""
    n = len(at)
    if not n or not lives.num_rows:
        return np.zeros(n, bool)
    code, begin, end, known = _sorted(lives)
    reach = _reach(code, end)
    names = known.to_numpy(zero_copy_only=False)
    asked = keys.dictionary_encode()
    own = asked.dictionary.to_numpy(zero_copy_only=False)
    i = np.minimum(np.searchsorted(names, own), len(names) - 1)
    i = np.where(names[i] == own, i, -1)[asked.indices.to_numpy()]
    times = np.unique(begin)
    step = len(times) + 1
    order = code.astype(np.int64) * step + np.searchsorted(times, begin)
    t = np.searchsorted(times, at, "right") - 1
    j = np.searchsorted(order, i * step + t, "right") - 1
    hit = (i >= 0) & (t >= 0) & (j >= 0)
    j = np.maximum(j, 0)
    return hit & (code[j] == i) & (reach[j] > at)


def _misses(left: pa.Table, right: pa.Table) -> pa.Table:
    out = left.select(["ref", "row_id", "at_us"])
    if not left.num_rows:
        return out
    return out.filter(pa.array(~probe(left.column("key").combine_chunks(), left.column("at_us").to_numpy(), right)))


def orphans(refs: DataFrame, pars: DataFrame, into: dict[tuple[str, str], str], n_ranges: int | None = None) -> DataFrame:
    """The references of which no parent is there at their own time: ``src_table, field_name, row_id, period``.

    ``refs`` from `references`, ``pars`` from `parents`, ``into`` maps (table, field) to the parents' space. A parent is there
    at t if one of its rows has begun (``from_us <= t``) and not ended (``to_us > t``). Repeated rows count once. Without
    parents every reference is an orphan; without references the result is empty.

    Lives of a key are merged before they move. Ranges hold about equally many of them: a key with very many is cut by time, and
    each of its ranges is told how far earlier lives reach. A range with very many references (a hot key) is probed by several
    tasks; its parents go to each of them. Both inputs are cut, and bounds sampled, while this is called.
    """
    spark = refs.sparkSession
    ws = Workspace(spark, "orphans")
    names = list(into)
    spaces = sorted(set(into.values()))
    # the space is the key's first character
    mark = lambda space: F.create_map(*[F.lit(x) for i, s in enumerate(spaces) for x in (s, chr(48 + i))])[space]
    ref_no = F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in ("/".join(k), i)])
    space_of = F.create_map(*[F.lit(x) for k, s in into.items() for x in ("/".join(k), chr(48 + spaces.index(s)))])
    which = F.concat_ws("/", "src_table", "field_name")

    lives = pars.filter(F.col("space").isin(spaces)).select(F.concat(mark(F.col("space")), "key").alias("key"), "from_us", "to_us")
    lives = ws.cut(_merged(lives.filter(F.col("from_us") < F.col("to_us"))), "lives")
    n_lives = lives.count()
    if n_ranges is None:
        n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_lives // ROWS_PER_RANGE + 1)
    bound_keys, bound_times = _bounds(lives, n_ranges, n_lives)
    in_range = _range_of(bound_keys, bound_times)

    keyed = refs.select(
        ref_no[which].cast("int").alias("ref"), "row_id", F.coalesce("at_us", F.lit(FOREVER - 1)).alias("at_us"), F.concat(space_of[which], "key").alias("key"),
    )
    keyed = ws.cut(keyed.withColumn("range", in_range(F.col("key"), F.col("at_us"))), "references")
    ranged = lives.withColumn("range", in_range(F.col("key"), F.col("from_us")))
    if cut_keys := sorted(set(bound_keys)):
        ranged = ranged.unionByName(_carried(ranged, cut_keys))
    # one row per range with many references
    load = keyed.groupBy("range").count().filter(F.col("count") > REFS_PER_PROBE)
    load = load.select("range", F.ceil(F.col("count") / REFS_PER_PROBE).cast("int").alias("tasks"))
    tasks = F.coalesce("tasks", F.lit(1))
    keyed = keyed.join(load, "range", "left").withColumn("part", F.pmod(F.xxhash64("row_id"), tasks).cast("int")).drop("tasks")
    ranged = ranged.join(load, "range", "left").withColumn("part", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("tasks")
    missed = keyed.groupBy("range", "part").cogroup(ranged.groupBy("range", "part")).applyInArrow(_misses, "ref int, row_id long, at_us long")
    pick = lambda j: F.element_at(F.array(*[F.lit(k[j]) for k in names]), F.col("ref") + 1)
    period = F.when(F.col("at_us") < FOREVER - 1, F.date_format(F.timestamp_micros("at_us"), "yyyy-MM"))
    return missed.select(pick(0).alias("src_table"), pick(1).alias("field_name"), "row_id", period.alias("period")).dropDuplicates()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field and period."""
    return found.groupBy("src_table", "field_name", "period").agg(F.count(F.lit(1)).alias("n_orphans"))
