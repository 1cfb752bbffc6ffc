"""Hierarchies against walking up parent by parent."""

import random

import pytest
from pyspark.sql import functions as F

from threadstone.operators import hierarchy as H


def walk(links):
    out = {}
    for node in links:
        path, at = [node], node
        while True:
            up = links[at]
            if up is None or up not in links:
                out[node] = (at, len(path) - 1, path[::-1])
                break
            if up in path:
                out[node] = ("", -1, None)
                break
            path.append(up)
            at = up
    return out


def run(spark, links, **kw):
    df = spark.createDataFrame(list(links.items()), "id string, parent string")
    rows = H.hierarchy(df, **kw).collect()
    assert len(rows) == len(links)
    return {r.id: (r.root, r.depth, r.path) for r in rows}, rows


def random_forest(seed):
    rnd = random.Random(seed)
    links = {f"n{i}": None if i < 4 else f"n{rnd.randrange(i)}" for i in range(150)}
    links |= {f"d{i}": f"d{i - 1}" if i else None for i in range(60)}  # a deep chain
    links |= {f"h{i}": "n0" for i in range(80)}  # a hot parent
    links |= {f"c{i}": f"c{(i + 1) % 7}" for i in range(7)} | {"self": "self", "below": "c3", "under": "below"}
    links |= {"two_a": "two_b", "two_b": "two_a", "lost": "nowhere", "child_of_lost": "lost"}
    return links


@pytest.mark.parametrize("seed", [1, 2])
def test_against_walking(spark, seed):
    links = random_forest(seed)
    got, rows = run(spark, links, with_sizes=True)
    want = walk(links)
    below = {k: 0 for k in links}
    for root, depth, path in want.values():
        for up in (path or [])[:-1]:
            below[up] += 1
    assert {r.id: r.n_descendants for r in rows} == below
    assert got == want
    assert {r.id for r in rows if r.on_cycle} == {k for k, v in want.items() if v[1] == -1}


def test_without_paths(spark):
    links = {"a": None, "b": "a", "c": "b", "x": "x"}
    got, _ = run(spark, links, with_path=False)
    assert {k: v[:2] for k, v in got.items()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": ("", -1)}
    assert all(v[2] is None or len(v[2]) <= 1 for v in got.values())


def test_descendants_and_sizes(spark):
    links = {"a": None, "b": "a", "c": "b", "d": "a", "x": "y", "y": "x"}
    tree = H.hierarchy(spark.createDataFrame(list(links.items()), "id string, parent string"))
    got = {(r.ancestor, r.descendant, r.distance) for r in H.descendants(tree).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}
    sized, _ = H.hierarchy(spark.createDataFrame(list(links.items()), "id string, parent string"), with_path=False, with_sizes=True), None
    assert {r.id: r.n_descendants for r in sized.collect()} == {"a": 3, "b": 1, "c": 0, "d": 0, "x": 0, "y": 0}


def test_sizes_of_a_long_chain(spark):
    """No chain is exploded: 2,000 nodes in a row, every tenth with a leaf."""
    n = 2_000
    chain = spark.range(n).select(F.concat(F.lit("c"), F.lpad("id", 6, "0")).alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("c"), F.lpad(F.col("id") - 1, 6, "0"))).alias("parent"))
    leaves = spark.range(0, n, 10).select(F.concat(F.lit("l"), "id").alias("id"), F.concat(F.lit("c"), F.lpad("id", 6, "0")).alias("parent"))
    rows = H.hierarchy(chain.unionByName(leaves), with_path=False, with_sizes=True).filter("id like 'c%'").collect()
    assert len(rows) == n
    for r in rows:
        i = int(r.id[1:])
        assert (r.depth, r.n_descendants) == (i, n - 1 - i + (n - 1) // 10 - (i - 1) // 10)


def test_empty_and_roots_only_and_cycles_only(spark):
    assert run(spark, {})[0] == {}
    assert run(spark, {"a": None})[0] == {"a": ("a", 0, ["a"])}
    assert run(spark, {"a": "a"})[0] == {"a": ("", -1, None)}


def test_repeated_null_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("b", "a", 3), (None, "a", 4)], "id string, parent string, depth int").withColumn("root", F.lit("x")).withColumn("state", F.lit("y"))
    assert {(r.id, r.depth) for r in H.hierarchy(df).collect()} == {("a", 0), ("b", 1)}


def test_latest_parent(spark):
    df = spark.createDataFrame([("a", "p1", 1, 1), ("a", "p2", 2, 2), ("a", "p3", 2, 3), ("b", "p", None, 1), ("b", "q", 1, 0), (None, "z", 5, 5)], "id string, parent string, at int, row int")
    got = {r.id: r.parent for r in H.latest_parent(df, F.col("id"), F.col("parent"), F.col("at"), F.col("row")).collect()}
    assert got == {"a": "p3", "b": "q"}
