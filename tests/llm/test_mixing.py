"""Mixtures: shares reached, repeats within their caps, positions that follow the schedules."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadstone.llm import mixing as M

DOCS = "doc_id long, source string, n_tokens long"
PLANS = "plan_id string, size_factor double, source string, target_share double, max_repeats long"


@pytest.fixture(scope="module")
def mixed(spark):
    docs = [(i, "big" if i % 10 < 7 else " MID-size " if i % 10 < 9 else "small", 5 + i % 11) for i in range(2000)]
    docs += [(9001, None, 50), (9002, "big", 0), (9003, "big", None), (9004, "unplanned", 7)]
    plans = [("p", 0.5, "big", 0.5, 2), ("p", 0.5, "mid_size", 0.3, 3), ("p", 0.5, "small", 0.1, 2), ("p", 0.5, "none", 0.1, 5), ("p", 0.5, "none", 0.1, 5), ("q", 0.2, "small", 1.0, 9), ("r", 0.1, "big", None, None)]
    chosen, report = M.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(plans, PLANS))
    return docs, plans, chosen.collect(), {(r.plan_id, r.source): r for r in report.collect()}


def test_shares_within_a_document(mixed):
    docs, plans, chosen, report = mixed
    total = sum(n or 0 for _, _, n in docs)
    for plan, factor, source, share, cap in set(plans):
        r = report[plan, source]
        supply = sum(n or 0 for _, s, n in docs if s and s.strip().lower().replace("-", "_") == source)
        want = factor * (share or 0) * total
        assert r.wanted_tokens == pytest.approx(want)
        assert abs(r.reached_tokens - min(want, supply * (cap or 0))) <= 16 / 2
        assert r.most_repeats <= (cap or 0)
    assert report["p", "none"].reached_tokens == 0 and report["p", "none"].n_rows == 0
    assert sum(r.reached_share for k, r in report.items() if k[0] == "p") == pytest.approx(1)


def test_repeats_are_even(mixed):
    _, _, chosen, report = mixed
    times = Counter((r.plan_id, r.source, r.doc_id) for r in chosen)
    by = defaultdict(set)
    for (plan, source, _), n in times.items():
        by[plan, source].add(n)
    assert all(max(n) - min(n) <= 1 for n in by.values())
    assert {r.doc_id for r in chosen}.isdisjoint({9001, 9002, 9003, 9004})


def test_order_and_schedule(mixed):
    _, _, chosen, _ = mixed
    assert [(r.plan_id, r.position) for r in chosen] == sorted((r.plan_id, r.position) for r in chosen)
    p = [r for r in chosen if r.plan_id == "p"]
    assert all(0 <= r.position <= 1 for r in p)
    early, late = ([sum(r.n_tokens for r in p if r.source == s and (r.position < 0.5) == half) for s in ("big", "small")] for half in (True, False))
    assert early[0] > late[0] and early[1] < late[1], "large sources thin out, small ones grow"


def brute(docs, want, cap, order):
    """Tokens that a source gives: whole passes, then what fits, then the nearest of the others."""
    own = sorted(docs, key=order)
    supply = sum(n for _, n in own)
    given = min(want, supply * cap)
    passes = int(given // supply) if supply else 0
    rest = given - passes * supply
    sum_, taken = 0, set()
    for d, n in own:
        if n <= rest:
            if sum_ + n > rest:
                break
            sum_ += n
            taken.add(d)
    off = [(abs(n - (rest - sum_)), n) for d, n in own if d not in taken]
    if off and min(off)[0] < rest - sum_:
        sum_ += min(off)[1]
    return passes * supply + sum_


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [(i, rng.choice("aab"), rng.choice([1, 7, 30, 500, 4000])) for i in range(300)]
    plans = [("p", 0.7, "a", 0.6, 1), ("p", 0.7, "b", 0.4, 2), ("q", 2.5, "a", 0.5, 9), ("q", 2.5, "b", 0.5, 2)]
    frame = spark.createDataFrame(docs, DOCS)
    hashes = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64(F.lit(0), "doc_id").alias("h")).collect()}
    _, report = M.mix(frame, spark.createDataFrame(plans, PLANS))
    total = sum(n for _, _, n in docs)
    for r in report.collect():
        plan = next(p for p in plans if (p[0], p[2]) == (r.plan_id, r.source))
        want = brute([(d, n) for d, s, n in docs if s == r.source], plan[1] * plan[3] * total, plan[4], lambda x: (hashes[x[0]], x[0]))
        assert abs(r.reached_tokens - want) <= 1e-6 * total, "ties of nearest documents differ in which, not in how near"


def test_weights_sum_to_the_shares(spark):
    plans = [("p", 1.0, s, w, 1) for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))] + [("e", 1.0, s, 0.5, 1) for s in "ab"]
    rows = M.schedules(spark.createDataFrame(plans, PLANS)).collect()
    for plan in "pe":
        assert sum(r.target_share * r.slope for r in rows if r.plan_id == plan) == pytest.approx(0)
    assert all(r.slope == 0 for r in rows if r.plan_id == "e")
    for slope in (-0.6, 0.0, 0.35):
        u = spark.range(11).select(F.round(M.invert_demand(F.col("id") / 10, F.lit(slope)), 9).alias("t"), (F.col("id") / 10).alias("u")).collect()
        assert all((1 - slope) * r.t + slope * r.t**2 == pytest.approx(r.u, abs=1e-6) for r in u)


def test_a_long_document_does_not_miss_the_share(spark):
    """Sizes of all orders: the last place finds a document of nearly the missing size. Of few sizes: it comes as near as one can."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "a", int(10 ** rng.uniform(0.5, 3.6))) for i in range(3000)] + [(i, "b", 10 if i % 100 else 4000) for i in range(5000, 5300)], DOCS)
    for share in (0.2, 0.41, 0.73, 1.0):
        _, report = M.mix(docs, spark.createDataFrame([("p", share, "a", 0.9, 3), ("p", share, "b", 0.001, 3)], PLANS))
        got = {r.source: r for r in report.collect()}
        assert abs(got["a"].reached_tokens - got["a"].wanted_tokens) <= 100
        assert abs(got["b"].reached_tokens - got["b"].wanted_tokens) <= 2000

def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    plans = spark.createDataFrame([("p", 1.0, "a", 1.0, 1)], PLANS)
    chosen, report = M.mix(none, plans)
    assert chosen.collect() == [] and report.collect()[0].reached_tokens == 0
    chosen, report = M.mix(spark.createDataFrame([(1, "a", 3)], DOCS), plans.limit(0))
    assert chosen.collect() == [] and report.collect() == []


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (2, "a", 3)], DOCS).withColumn("before", F.lit("x")).withColumn("plan_id", F.lit("y"))
    chosen, _ = M.mix(docs, spark.createDataFrame([("p", 1.0, "a", 1.0, 1)], PLANS))
    assert sorted(r.doc_id for r in chosen.collect()) == [1, 1, 2], "rows are what is mixed"
