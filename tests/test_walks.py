"""Walks from very many roots, of which no hop is stored."""

import random
from pathlib import Path

import pytest

from threadstone import session
from threadstone.operators import graph
from threadstone.plans import catalogue

DATA = "/root/testdata/sf0.001"


def _plain(edges, roots, hops):
    out = set()
    for root in roots:
        front, seen = {root}, {}
        for hop in range(1, hops + 1):
            front = {z for a, z in edges if a in front and z not in seen}
            seen |= dict.fromkeys(front, hop)
        out |= {(root, node, hop) for node, hop in seen.items()}
    return out


@pytest.mark.parametrize("direction", ["callees", "callers"])
def test_walks_from_many_roots(spark, monkeypatch, direction):
    monkeypatch.setattr(graph, "BLOCK_EDGES", 50)
    rng = random.Random(1)
    edges = {(f"n{rng.randrange(120)}", f"n{int(120 * rng.random() ** 3)}") for _ in range(250)} | {("a", "b"), ("b", "a"), ("c", "c"), ("ü", ""), ("", "ü")}
    roots = [f"n{i}" for i in range(120)] + ["a", "c", "ü", "", "nowhere", "n1", None]
    df = spark.createDataFrame(sorted(edges), "src string, dst string").repartition(3)
    asked = spark.createDataFrame([(r,) for r in roots], "root string")
    way = edges if direction == "callees" else {(z, a) for a, z in edges}
    for hops in (1, 3, 99):
        got = graph.neighbourhoods(df, asked, hops, direction).collect()
        assert len(got) == len({(r.root, r.node) for r in got}) and {r.direction for r in got} == {direction}
        assert {(r.root, r.node, r.hop) for r in got} == _plain(way, set(roots) - {None}, min(hops, 5))
    assert graph.neighbourhoods(df.limit(0), asked, 3, direction).collect() == []
    assert graph.neighbourhoods(df, asked.limit(0), 3, direction).collect() == []
    assert graph.neighbourhoods(df, asked, 2, direction).dtypes == graph.neighbourhood(df, asked, 2, direction).dtypes


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["graph_callees_all", "graph_callers_all"])
def test_no_hop_of_many_walks_is_stored(spark, monkeypatch, tmp_path, name):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    assert catalogue.QUERIES[name](spark, DATA).count() > 1
    assert not [*tmp_path.rglob("*")]


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_callees_of_the_names_of_all_symbols(spark):
    symbols = session.table(spark, DATA, "symbols")
    edges = {(r.src, r.dst) for r in graph.name_edges(session.table(spark, DATA, "call_edges"), symbols).collect()}
    names = {r.name for r in symbols.collect()} - {None}
    got = {(r.root, r.node, r.hop) for r in catalogue.QUERIES["graph_callees_all"](spark, DATA).collect()}
    assert got == _plain(edges, names, 3) and {root for root, _, _ in got} == names & {a for a, _ in edges}
