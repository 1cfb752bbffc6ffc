"""Reading levels: held-out agreement on the given labels, and cases without words."""

import os

import pytest
from pyspark.sql import functions as F

from threadstone.llm import reading_level as R
from threadstone.session import table

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_held_out_agreement(spark):
    docs = R.eligible(table(spark, DATA, "documents"))
    labels = table(spark, DATA, "level_labels")
    held = R.consensus(labels, 1.0).filter("doc_id % 4 = 0")
    model = R.fit(docs, labels.filter("doc_id % 4 <> 0"))
    got = R.predict(docs.join(held.select("doc_id"), "doc_id"), model).join(held.withColumnRenamed("level", "want"), "doc_id").collect()
    assert len(got) > 150
    assert sum(r.level == r.want for r in got) / len(got) > 0.95
    assert sum(abs(r.level - r.want) <= 1 for r in got) / len(got) > 0.95


def toy(spark, n=30):
    vocab = {1: "cat sat mat ran", 2: "folder menu window click", 3: "latency buffer thread cache", 4: "axiom monotone lattice functor"}
    docs = [(k * 100 + i, f"{v} {v} the and `code {vocab[5 - k]}`") for k, v in vocab.items() for i in range(n)]
    labels = [(d, f"r{j}", d // 100) for d, _ in docs for j in range(2)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rater string, level long"), vocab


def test_levels_of_plain_vocabularies(spark):
    docs, labels, vocab = toy(spark)
    model = R.fit(docs, labels)
    new = spark.createDataFrame([(k, f"{v} {v} the and unknownword") for k, v in vocab.items()] + [(9, None), (10, ""), (11, "zzz"), (12, f"{vocab[4]} {vocab[4]} the and " * 20000)], "doc_id long, text string")
    got = {r.doc_id: r.level for r in R.predict(new, model).collect()}
    assert {k: got[k] for k in vocab} == {k: k for k in vocab}
    assert all(got[k] in R.LEVELS for k in (9, 10, 11)) and got[12] == 4
    assert "code" not in model.grades


def test_consensus(spark):
    rows = [(1, "a", 2), (1, "a", 2), (1, "b", 2), (2, "a", 1), (2, "b", 4), (3, "a", None), (4, "a", 9), (None, "a", 1), (5, "c", 3), (6, "a", 4), (6, "b", 4), (6, "c", 3)]
    assert {r.doc_id for r in R.consensus(spark.createDataFrame(rows, "doc_id long, rater string, level long"), 1.0).collect()} == {1, 5}
    assert {(r.doc_id, r.level) for r in R.consensus(spark.createDataFrame(rows, "doc_id long, rater string, level long")).collect()} == {(1, 2), (5, 3), (6, 4)}


def test_eligible_and_empty(spark):
    rows = [(1, "x", "en", "markdown"), (2, "x", "EN ", "plain"), (3, "x", "de", "plain"), (4, "x", "en", "code"), (5, " \n\u2003", "en", "plain"), (6, None, "en", "plain"), (7, "x", None, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, doc_format string").withColumn("level", F.lit("clash"))
    assert {r.doc_id for r in R.eligible(df).collect()} == {1, 2}
    none = spark.createDataFrame([], "doc_id long, rater string, level long")
    assert R.fit(R.eligible(df), none) is None
    assert [r.level for r in R.predict(R.eligible(df), None).collect()] == [None, None]
    docs, labels, _ = toy(spark, 5)
    assert R.predict(docs.limit(0), R.fit(docs, labels)).collect() == []


def test_an_open_fence_is_text():
    assert R.words("one\n```\ntwo\n```\nthree `four` five") == ["one", "three", "five"]
    assert R.words("one ```\ntwo three") == ["one", "two", "three"]
