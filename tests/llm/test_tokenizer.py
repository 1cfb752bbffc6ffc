"""Token ids against the public library that the vocabulary belongs to, and against one merge at a time."""

import base64
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadstone.llm import tokenizer as K

BPE = K.load("byte_bpe_50k")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{K.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ids_of(texts):
    ids, at = BPE.encode(texts)
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]


def test_odd_and_long_texts(library):
    texts = [None, "", " ", "  a", "a  b", "\n\n x", "don't I'LL", "x" * 4000, "ab" * 3000, "aaa" * 777, " " * 3000, "\t \n" * 200 + "z", "<|endoftext|>", "漢字かな🙂 é", "１２3 ²"]
    assert ids_of(texts) == library(texts)
    assert ids_of(texts)[:2] == [[], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'ab1<|>_\u00a0\u200b"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_any_text(texts):
    from tokenizers import Tokenizer

    t = test_any_text.__dict__.setdefault("t", Tokenizer.from_file(f"{K.VOCABULARIES}/byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert ids_of(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_matrix_rounds_and_bulk_merges_agree():
    rnd = random.Random(2)
    for _ in range(60):
        raw = bytes(rnd.choice(b"abcth ein") for _ in range(rnd.randint(1, 40)))
        rows = BPE.byte[np.frombuffer(raw, np.uint8)][None, :].copy()
        padded = np.concatenate([rows, np.full((1, 7), -1, np.int32)], 1)
        ids, n = BPE._merge_rows(padded)
        assert ids[0, : n[0]].tolist() == BPE._merge_long(rows[0].copy()).tolist()


def plain(ids):
    """One merge at a time: the leftmost pair of minimum rank."""
    ids = list(ids)
    while len(ids) > 1:
        ranks = BPE.table.lookup(np.array(ids[:-1]), np.array(ids[1:]))
        at = int(ranks.argmin())
        if ranks[at] == K.NONE:
            break
        ids[at : at + 2] = [int(ranks[at])]
    return ids


def unions_before_a_part():
    """Tokens' texts whose rank is smaller than that of a part they are made of: where merging in bulk could go wrong."""
    with open(f"{K.VOCABULARIES}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f)}
    return [t for t, r in ranks.items() for i in range(1, len(t)) if ranks.get(t[:i], -1) > r and t[i:] in ranks or ranks.get(t[i:], -1) > r and t[:i] in ranks]


@pytest.mark.parametrize("seed", range(4))
def test_long_rows_merge_as_one_by_one(seed):
    rnd = random.Random(seed)
    tricky = sorted(set(unions_before_a_part()))
    assert len(tricky) > 5000
    for t in rnd.sample(tricky, 60):
        cuts = [t[:i] for i in range(1, len(t) + 1)] + [t[i:] for i in range(len(t))]
        raw = b"".join(rnd.choice(cuts) for _ in range(rnd.randint(2, 60)))
        row = BPE.byte[np.frombuffer(raw, np.uint8)]
        assert BPE._merge_long(row).tolist() == plain(row), raw


def test_a_run_of_many_letters_takes_seconds():
    rnd = random.Random(3)
    text = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=400_000))
    began = time.perf_counter()
    ids = ids_of([text])[0]
    assert time.perf_counter() - began < 10 and len(ids) < 300_000


def test_pair_table():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 50_000, (5000, 2)), axis=0).astype(np.int32)
    t = K.PairTable(keys[:, 0], keys[:, 1], np.arange(len(keys), dtype=np.int32))
    assert (t.lookup(keys[:, 0], keys[:, 1]) == np.arange(len(keys))).all()
    assert (t.lookup(np.array([60_000, -1, 3]), np.array([1, 5, -1])) == K.NONE).all()


def test_spark_keeps_columns_and_replaces_a_clashing_one(spark, library):
    texts = ["one two", None, "", "one two", "long " * 5000]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = sorted(K.encode(df).collect())
    assert [r.ids for r in rows] == library(texts)
    assert K.encode(df).columns == ["doc_id", "ids"]
    counted = {r.doc_id: r.n_tokens for r in K.count_tokens(df.withColumn("n.b", F.lit(1))).collect()}
    assert counted == {i: len(x) for i, x in enumerate(library(texts))}
    assert K.encode(df.limit(0)).collect() == []
