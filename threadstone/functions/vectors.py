"""Vector expressions and the embedder contract."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rows_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as a matrix, straight from their flat values; null elements are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(-1, width)


@F.arrow_udf(T.DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.zeros(len(a))
    size, other = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (a, b))
    for width in np.unique(size[(size == other) & (size > 0)]):  # one length, as a rule
        at = np.flatnonzero((size == width) & (other == width))
        pick = pa.array(at)
        x, y = (rows_matrix(v if len(at) == len(v) else v.take(pick), int(width)) for v in (a, b))
        norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
        dots = np.einsum("ij,ij->i", x, y)
        out[at] = np.divide(dots, norms, out=np.zeros(len(at)), where=norms > 0)
    return pa.array(np.nan_to_num(out), pa.float64())


def cosine(a, b) -> Column:
    """Cosine of two vectors in double precision, whole Arrow batches at a time; 0.0 for null, empty, unequal lengths or a zero norm.
    Null elements make it 0.0."""
    return _cosine(_c(a), _c(b))


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def hash_embedding(text, dim: int = 384) -> Column:
    """A vector without meaning that depends on the text only: the bytes of its SHA-256, repeated to dim, mapped to -1..1 and
    scaled to length 1. What stands in when no model is at hand. Null gives null."""
    sha = F.sha2(_c(text), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(sha, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(_c(text).isNotNull(), F.transform(raw, lambda v: v / norm))


def embedder(make: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable:
    """A column function from a model: ``make`` loads it once per worker and gives a function from texts to a matrix."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(list(np.asarray(model(s.fillna("").tolist()), np.float32)), index=s.index)

    return embed
