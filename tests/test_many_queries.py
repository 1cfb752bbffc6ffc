"""Searches and graph walks for all queries at once."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadstone.plans import catalogue
from threadstone.session import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def test_every_query_has_lists_and_a_context(spark):
    ids = {r.vec_id for r in table(spark, DATA, "embeddings").filter("vec_id % 50 = 0 and size(embedding) = 64").collect()}
    assert len(ids) > 1
    for name in ("vec_threshold_all", "rrf_fuse_all", "context_pack_all"):
        assert {r.query_id for r in catalogue.QUERIES[name](spark, DATA).select("query_id").distinct().collect()} == ids


def test_full_search_takes_boosted_rows_outside_of_the_vector_list(spark):
    from threadstone.operators import search

    unit = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    df = spark.createDataFrame([(i, unit(0), "n", "o", "body") for i in range(12)] + [(50, unit(1), "the flush", "flush", "flush"), (51, None, "n", "o", "xflushx")], "id int, v array<double>, n string, o string, t string")
    q = spark.createDataFrame([(1, unit(0), "flush"), (2, unit(1), "none")], "query_id int, embedding array<double>, word string")
    got = {(r.query_id, r.rank): (r.id, round(r.score, 3)) for r in search.hybrid_many(df, q, "id", "v", 3, "n", "o", "t", 4, None).collect()}
    assert got == {(1, 1): (50, 1.0), (1, 2): (0, 0.7), (1, 3): (1, 0.7), (2, 1): (50, 0.7)}
    near = search.nearest(df, q, "id", "v", 3, 4).filter(F.col("query_id") == 2).orderBy("rank").collect()
    assert [r.id for r in near] == [50, 0, 1]


def test_walks_start_at_many_roots(spark):
    roots = {r.name for r in table(spark, DATA, "symbols").filter("row_id % 50 = 0").collect()}
    assert len(roots) > 1 and {r.root for r in catalogue.QUERIES["graph_explain_all"](spark, DATA).collect()} == roots
    assert len({r.root for r in catalogue.QUERIES["graph_callees_all"](spark, DATA).collect()}) > 1
