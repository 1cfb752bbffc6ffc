"""Attribute histories against a plain fold, and reading them back from storage."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from threadstone.operators import history as V

SCHEMA = "e string, at timestamp, ord long, a string, b long"
ATTR = ["a", "b"]


def stamp(s):
    return dt.datetime.fromtimestamp(s, dt.timezone.utc).replace(tzinfo=None)


def log_of(spark, rows, period=1000):
    df = spark.createDataFrame([(e, None if t is None else stamp(t), o, a, b) for e, t, o, a, b in rows], SCHEMA)
    obs = V.observations(df, F.col("e"), F.col("at"), [F.col("ord")], {"a": F.col("a"), "b": F.col("b")}, F.col("a") != "bad")
    return V.change_log(obs, ATTR, period)


def plain(rows):
    last = {}
    for e, t, o, a, b in rows:
        if e is not None and t is not None and a not in (None, "bad") and (e, t) not in last or (e, t) in last and a not in (None, "bad") and o > last[e, t][0]:
            last[e, t] = (o, a, b)
    out = {}
    for (e, t), (_, a, b) in sorted(last.items()):
        runs = out.setdefault(e, [])
        if not runs or runs[-1][1:] != (a, b):
            runs.append((t, a, b))
    return {(e, t, a, b, runs[i + 1][0] if i + 1 < len(runs) else None) for e, runs in out.items() for i, (t, a, b) in enumerate(runs)}


def versions(spark, rows, period=1000):
    return {(r.entity, r.at_s, r.a, r.b, r.valid_to_s) for r in V.fold(log_of(spark, rows, period), ATTR).collect()}


def test_against_plain_fold(spark):
    rnd = random.Random(5)
    rows = [
        (rnd.choice(["e1", "e2", "hot", "hot", None]), rnd.choice([None, *range(0, 9000, 250)]), i, rnd.choice(["x", "x", "y", "bad", None]), rnd.choice([None, 1]))
        for i in range(600)
    ]
    rows += rows[:80]
    for period in (700, 100_000):
        assert versions(spark, rows, period) == plain(rows)


def test_null_attributes_are_values(spark):
    rows = [("e", 0, 1, "x", 1), ("e", 10, 2, "x", None), ("e", 20, 3, "x", None), ("e", 30, 4, "x", 1)]
    assert versions(spark, rows) == {("e", 0, "x", 1, 10), ("e", 10, "x", None, 30), ("e", 30, "x", 1, None)}


def test_storage_holds_checkpoints_and_patches(spark):
    rows = [("e", 0, 1, "x", 1), ("e", 10, 2, "y", 1), ("e", 20, 3, "y", 1), ("e", 1000, 4, "y", 1), ("e", 1010, 5, "y", 2)]
    got = [(r.at_s, r.is_checkpoint, r.is_change, r.patch.a and r.patch.a.v, r.patch.b and r.patch.b.v) for r in log_of(spark, rows).orderBy("at_s").collect()]
    assert got == [(0, True, True, "x", 1), (10, False, True, "y", None), (1000, True, False, "y", 1), (1010, False, True, None, 2)]


def test_as_of(spark):
    log = log_of(spark, [("e", 0, 1, "x", 1), ("e", 10, 2, "y", None), ("f", 2000, 3, "z", 3), ("e", 2000, 4, "y", 7)])
    at = lambda s: {r.entity: (r.a, r.b) for r in V.as_of(log, ATTR, s).collect()}
    assert at(9) == {"e": ("x", 1)}
    assert at(1500) == {"e": ("y", None)}
    assert at(2000) == {"e": ("y", 7), "f": ("z", 3)}


def test_empty(spark):
    assert versions(spark, []) == set()
    assert versions(spark, [(None, 1, 1, "x", 1), ("e", None, 1, "x", 1), ("e", 1, 1, "bad", 1)]) == set()


def test_columns_with_clashing_names_and_long_values(spark):
    df = spark.createDataFrame([("e", stamp(0), 1, "x" * 100_000, 1), ("e", stamp(5), 2, "x" * 100_000, 1)], SCHEMA)
    df = df.withColumns({c: F.lit("clash") for c in ("entity", "state", "period", "at_s", "patch", "o")})
    obs = V.observations(df, F.col("e"), F.col("at"), [F.col("ord")], {"a": F.col("a"), "b": F.col("b")}, F.lit(True))
    rows = V.fold(V.change_log(obs, ATTR), ATTR).collect()
    assert [(r.entity, r.at_s, len(r.a), r.b, r.valid_to_s) for r in rows] == [("e", 0, 100_000, 1, None)]


def test_appended_log_equals_a_whole_one_and_refuses_late_rows(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.choice(["e1", "e2", "hot"]), t, i, rnd.choice(["x", "y"]), rnd.choice([None, 1])) for i, t in enumerate(sorted(rnd.randint(0, 9000) for _ in range(200)))]
    made = lambda part: V.observations(
        spark.createDataFrame([(e, stamp(t), o, a, b) for e, t, o, a, b in part], SCHEMA), F.col("e"), F.col("at"), [F.col("ord")], {"a": F.col("a"), "b": F.col("b")}, F.col("a") != "bad"
    )
    log = V.ChangeLog(spark, str(tmp_path / "log"), ATTR, 1000)
    for low, high in ((-1, 3000), (3000, 3100), (3100, 9001)):
        log.append(made([r for r in rows if low <= r[1] < high]))
    assert {(r.entity, r.at_s, r.a, r.b, r.valid_to_s) for r in log.versions().collect()} == plain(rows)
    seen = {(r.entity, r.a, r.b) for r in log.as_of(4000).collect()}
    assert seen == {(e, a, b) for e, t, a, b, end in plain(rows) if t <= 4000 and (end is None or end > 4000)}
    with pytest.raises(ValueError):
        log.append(made([("e1", 5, 999, "z", None)]))
