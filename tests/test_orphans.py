"""Orphan references against a plain search, and the cases that need a defined result."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from threadstone.functions.ids import bare_callee, canonical_id
from threadstone.operators import orphans as O

REF = "src_table string, field_name string, row_id long, key string, at_us long"
PAR = "space string, key string, from_us long, to_us long"
INTO = {("a", "x"): "s", ("b", "y"): "t"}


def run(spark, refs, pars, **kw):
    out = O.orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(pars, PAR), INTO, **kw)
    return {(r.src_table, r.field_name, r.row_id): r.period for r in out.collect()}


def test_against_plain_search(spark, monkeypatch):
    rnd = random.Random(3)
    keys = [f"k{i}" for i in range(30)] + ["hot"]
    pars = [("st"[rnd.random() < 0.4], rnd.choice(keys), rnd.choice([O.EVER, rnd.randint(0, 90)]), rnd.choice([O.FOREVER, rnd.randint(0, 99)])) for _ in range(120)]
    refs = []
    for i in range(900):
        src = rnd.choice(["a", "b"])
        refs.append((src, {"a": "x", "b": "y"}[src], i, "hot" if rnd.random() < 0.4 else rnd.choice([*keys, "never"]), rnd.randint(0, 100)))
    refs += refs[:50]  # repeated rows
    monkeypatch.setattr(O, "REFS_PER_PROBE", 40)  # the hot range is probed by several tasks
    got = run(spark, refs, pars, n_ranges=5)
    there = lambda r: any(p[0] == INTO[r[:2]] and p[1] == r[3] and p[2] <= r[4] < p[3] for p in pars)
    assert set(got) == {r[:3] for r in refs if not there(r)}


def test_half_open_and_periods(spark):
    us = lambda s: int(dt.datetime.fromisoformat(s + "+00:00").timestamp() * 1e6)
    t = us("2024-03-05T00:00:00")
    refs = [("a", "x", 1, "k", t), ("a", "x", 2, "k", t + 1), ("a", "x", 3, "k", t - 1), ("a", "x", 4, "k", None)]
    assert run(spark, refs, [("s", "k", t, t + 1)]) == {("a", "x", 2): "2024-03", ("a", "x", 3): "2024-03", ("a", "x", 4): None}
    assert run(spark, refs, [("s", "k", O.EVER, O.FOREVER)]) == {}
    assert run(spark, refs, [("t", "k", O.EVER, O.FOREVER)]).keys() == {("a", "x", i) for i in (1, 2, 3, 4)}, "another space doesn't count"


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [], [("s", "k", 0, 1)]) == {}
    assert run(spark, [("b", "y", 7, "k", 5)], []) == {("b", "y", 7): "1970-01"}


def test_references_skip_null_and_blank_and_ignore_other_columns(spark):
    df = spark.createDataFrame([(1, "A", None, 9), (2, None, None, 9), (3, " ", None, 9), (None, "B", None, 9)], "id long, ref string, at timestamp, row_id int").drop("row_id")
    df = df.withColumn("key", F.lit("clash")).withColumn("src_table", F.lit("clash"))
    rows = O.references(df, "t", "f", "id", canonical_id("ref"), "at").collect()
    assert sorted((r.row_id or 0, r.key) for r in rows) == [(0, "b"), (1, "a")]
    assert {r.src_table for r in rows} == {"t"}


def test_lives_merge():
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), a, a + rnd.randint(1, 9)) for a in (rnd.randint(0, 60) for _ in range(60))]
    t = pa.table({"key": [r[0] for r in rows], "from_us": pa.array([r[1] for r in rows], pa.int64()), "to_us": pa.array([r[2] for r in rows], pa.int64())})
    m = O.merge_lives(t).to_pylist()
    for k in "abcd":
        for at in range(80):
            assert any(r["key"] == k and r["from_us"] <= at < r["to_us"] for r in m) == any(r[0] == k and r[1] <= at < r[2] for r in rows)
    by = sorted((r["key"], r["from_us"], r["to_us"]) for r in m)
    assert all(x[0] != y[0] or x[2] < y[1] for x, y in zip(by, by[1:])), "disjoint"


def test_one_key_of_very_many_lives(spark):
    """A key with 300,000 disjoint lives is cut by time; no range holds much more than its share, and results are right."""
    n = 300_000
    pars = spark.range(n).select(F.lit("s").alias("space"), F.lit("hot").alias("key"), (F.col("id") * 10).alias("from_us"), (F.col("id") * 10 + 5).alias("to_us"))
    pars = pars.unionByName(spark.range(2000).select(F.lit("s").alias("space"), F.concat(F.lit("k"), "id").alias("key"), F.lit(0).cast("long").alias("from_us"), F.lit(O.FOREVER).alias("to_us")))
    refs = spark.range(50_000).select(
        F.lit("a").alias("src_table"), F.lit("x").alias("field_name"), F.col("id").alias("row_id"), F.lit("hot").alias("key"), (F.col("id") * 61 + 3).alias("at_us")
    )
    got = {r.row_id for r in O.orphans(refs, pars, INTO, n_ranges=12).collect()}
    assert got == {i for i in range(50_000) if (i * 61 + 3) % 10 >= 5 or (i * 61 + 3) // 10 >= n}
    keys, times = O._bounds(pars.select(F.concat(F.lit("0"), "key").alias("key"), "from_us"), 12, n + 2000)
    assert list(keys).count("0hot") >= 10 and sorted(times[:10]) == list(times[:10])


def test_a_long_life_reaches_over_ranges(spark):
    pars = [("s", "hot", 0, 10_000), *(("s", "hot", 20_000 + i * 10, 20_000 + i * 10 + 1) for i in range(400))]
    refs = [("a", "x", i, "hot", i * 100 + 50) for i in range(260)]
    got = run(spark, refs, pars, n_ranges=6)
    assert {k[2] for k in got} == {i for i in range(260) if not any(p[2] <= i * 100 + 50 < p[3] for p in pars)}


def test_writings_of_ids_and_callees(spark):
    ids = ["AB12", " ab12 ", "symbol:ab12", "Symbol:⟨AB12⟩", "file:`ab12`", "", "  ", None]
    callees = ["run", " run ", "run()", "run!", "a::b::run", "self.run", "p->run", "run::<u32>", "Vec<Box<T>>::run(x, y)", "run<string>", "this.a.run()", None, " "]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ids], "x string").select(canonical_id("x")).collect()]
    assert got == ["ab12"] * 5 + [None] * 3
    got = [r[0] for r in spark.createDataFrame([(x,) for x in callees], "x string").select(bare_callee("x")).collect()]
    assert got == ["run"] * 11 + [None] * 2


def test_report(spark):
    found = spark.createDataFrame([("a", "x", 1, "2024-01"), ("a", "x", 2, "2024-01"), ("a", "x", 3, None)], "src_table string, field_name string, row_id long, period string")
    assert {(r.period, r.n_orphans) for r in O.orphan_report(found).collect()} == {("2024-01", 2), (None, 1)}
