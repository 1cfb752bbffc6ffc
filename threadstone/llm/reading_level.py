"""Reading level of documents from the grades at which their words are acquired.

The labelled documents give each word a distribution over levels; its acquisition grade is the mean of that distribution, the
levels weighing alike. A document's quantiles of its known words' grades, calibrated on labelled documents, give its level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the fit: labelled documents used, words graded, documents that a graded word must occur in.
FIT_DOCS, FIT_WORDS, MIN_DOCS = 20_000, 200_000, 3
#: Part of a document's labels that must agree for it to be learnt from.
AGREEMENT = 0.6
LEVELS = (1, 2, 3, 4)
QUANTILES = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])

_CODE = re.compile(r"```.*?```|`[^`\n]+`", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def words(text: str | None) -> list[str]:
    """The words of a text's prose in lower case; code between fences or backticks is left out. A fence that nothing closes is no
    fence: what follows is read."""
    return _WORD.findall(_CODE.sub(" ", text).lower()) if text else []


@dataclass
class Model:
    grades: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def features(self, text: str | None) -> np.ndarray:
        """Quantiles of the known words' grades, their mean, the logarithm of their number. Without known words: the middle."""
        known = self.grades
        g = np.array([known[w] for w in words(text) if w in known])
        if not len(g):
            return np.r_[np.full(len(QUANTILES) + 1, np.mean(LEVELS)), 0.0]
        mean = g.mean()
        g.sort()
        at = QUANTILES * (len(g) - 1)
        low = at.astype(np.int64)
        high = np.minimum(low + 1, len(g) - 1)
        return np.r_[g[low] + (g[high] - g[low]) * (at - low), mean, np.log1p(len(g))]

    def levels(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        return np.array(LEVELS)[(z @ self.weights).argmax(1)]


def eligible(docs: DataFrame) -> DataFrame:
    """English prose: lang en, format markdown or plain, a text that isn't null or blank."""
    prose = (F.lower(F.trim("lang")) == "en") & F.lower(F.trim("doc_format")).isin("markdown", "plain")
    return docs.select("doc_id", "text", "lang", "doc_format").filter(prose & F.col("text").rlike(r"(?U)\S")).select("doc_id", "text")


def consensus(labels: DataFrame, agreement: float = AGREEMENT) -> DataFrame:
    """``doc_id, level`` of documents on whose level at least the part ``agreement`` of their labels agrees (of several such levels
    the lowest). Repeated rows count once; levels off the scale and nulls don't count."""
    good = labels.select("doc_id", "rater", "level").filter(F.col("doc_id").isNotNull() & F.col("level").isin(*LEVELS)).distinct()
    votes = good.groupBy("doc_id").agg(*[F.count_if(F.col("level") == k).alias(f"v{k}") for k in LEVELS], F.count(F.lit(1)).alias("n"))
    most = F.greatest(*[f"v{k}" for k in LEVELS])
    level = F.coalesce(*[F.when(F.col(f"v{k}") == most, k) for k in LEVELS]).cast("long")
    return votes.filter(most >= F.lit(agreement) * F.col("n")).select("doc_id", level.alias("level"))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_words: int = FIT_WORDS, min_docs: int = MIN_DOCS) -> Model | None:
    """Word grades and calibration from at most ``fit_docs`` labelled documents, chosen by a hash of their ids; at most
    ``fit_words`` words, the most frequent by documents, are graded. Counting is distributed; what reaches the driver is bounded
    by these two parameters. None if there is nothing to learn from."""
    sc = docs.sparkSession.sparkContext
    sample = consensus(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    labelled = docs.join(F.broadcast(sample), "doc_id")  # at most fit_docs ids and levels

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        d: Counter = Counter()
        for b in batches:
            for text, level in zip(b.column("text").to_pylist(), b.column("level").to_pylist()):
                own = Counter(words(text))
                for w, k in own.items():
                    n[w, level] += k
                    d[w, level] += 1
        keys = list(n)
        yield pa.RecordBatch.from_pydict({"word": [k[0] for k in keys], "level": pa.array([k[1] for k in keys], pa.int64()), "n": pa.array([n[k] for k in keys], pa.int64()), "d": pa.array([d[k] for k in keys], pa.int64())})

    at = lambda k: F.coalesce(F.sum(F.when(F.col("level") == k, F.col("n"))), F.lit(0)).alias(f"l{k}")
    counted = labelled.select("text", "level").mapInArrow(count, "word string, level long, n long, d long")
    counted = counted.groupBy("word").agg(*[at(k) for k in LEVELS], F.sum("d").alias("d")).filter(F.col("d") >= min_docs)
    rows = counted.orderBy(F.desc("d"), "word").limit(fit_words).toPandas()
    if not len(rows):
        return None
    c = rows[[f"l{k}" for k in LEVELS]].to_numpy(float)
    total = np.maximum(c.sum(0), 1)
    rate = (c + 0.5 * total / total.sum()) / total
    grade = (rate / rate.sum(1, keepdims=True)) @ np.array(LEVELS, float)
    model = Model(dict(zip(rows["word"], grade)), np.zeros(1), np.ones(1), np.zeros((1, 4)))
    shared = sc.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [shared.value.features(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"level": b.column("level"), "x": pa.array(x, pa.list_(pa.float64()))})

    seen = labelled.select("text", "level").mapInArrow(describe, "level long, x array<double>").toPandas()
    x, y = np.stack(seen["x"].to_numpy()), seen["level"].to_numpy()
    spread = x.std(0)
    model.mean, model.scale = x.mean(0), np.where(spread > 1e-6, spread, np.inf)  # what never varies tells nothing
    model.weights = _logistic(np.c_[(x - model.mean) / model.scale, np.ones(len(x))], y)
    return model


def _logistic(z: np.ndarray, y: np.ndarray, l2: float = 1e-3, turns: int = 300) -> np.ndarray:
    """Multinomial logistic regression by steps under a fixed bound of the curvature."""
    n, goal = len(z), (y[:, None] == np.array(LEVELS)).astype(float)
    w = np.zeros((z.shape[1], len(LEVELS)))
    step = np.linalg.inv(0.5 * (z.T @ z) / n + 2 * l2 * np.eye(z.shape[1]))
    for _ in range(turns):
        s = z @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= step @ (z.T @ (p - goal) / n + 2 * l2 * w)
    return w


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, level`` for every row of docs (``doc_id, text``). Without a model every level is null. Whole texts are read."""
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("long").alias("level"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if b.num_rows:
                x = np.stack([m.features(t) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "level": pa.array(m.levels(x), pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, level long")
