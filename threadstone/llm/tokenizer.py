"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are cut where the vocabulary's own pattern always cuts (before a blank that a non-blank follows). The distinct pieces of a
batch that this worker hasn't seen are encoded together: rows of equal length class form padded numpy matrices, in which every
row merges its leftmost pair of minimum rank each round. Pair ranks come from a hash table, rows are compacted after each merge,
and rows without a pair left leave the matrix.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files of the public tokenizers lie; a parameter of every function that needs one.
VOCABULARIES = "/opt/tokenizers"
#: How the vocabulary's authors split text before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
#: Entries after which a worker forgets its pieces, and the longest piece it remembers; they bound memory, not results.
REMEMBER, REMEMBER_CHARS = 400_000, 64
#: Characters that one Arrow batch's texts are encoded in at a time.
GROUP_CHARS = 4_000_000


class PairTable:
    """Hash table from token pairs to the rank (and id) of their union: open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        key, todo = self._key(left, right), np.arange(len(left))
        slot, self.probes = self._slot(key), 0
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = key[todo[free]]
            won = self.keys[at] == key[todo]
            self.ranks[at[won]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (size - 1)
            self.probes += 1

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 20) | b.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the union is no token or either side is padding (negative)."""
        shape, a, b = a.shape, a.ravel(), b.ravel()
        out = np.full(a.shape, NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = self._key(a[todo], b[todo])
        slot = self._slot(key)
        for _ in range(self.probes):
            seen = self.keys[slot]
            hit = seen == key
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (seen != -1)
            if not on.any():
                break
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Bpe:
    """A byte-level BPE vocabulary given by token ranks, and a memory of encoded pieces."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.table = PairTable(*(np.array(x, np.int32) for x in zip(*pairs)))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.split = regex.compile(PATTERN)
        self.seen: dict[str, np.ndarray] = {}

    def _merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges padded rows of ids to the end; their ids and lengths."""
        n, width = rows.shape
        done, lengths = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        live, ids = np.arange(n), rows
        rank = self.table.lookup(ids[:, :-1], ids[:, 1:])
        while len(live):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(live), np.int64)
            r = np.arange(len(live))
            least = rank[r, best] if rank.shape[1] else np.full(len(live), NONE, np.int32)
            ended = least == NONE
            if ended.any():
                out = ids[ended]
                done[live[ended], : out.shape[1]] = out
                lengths[live[ended]] = (out >= 0).sum(1)
                live, ids, rank, best, least = live[~ended], ids[~ended], rank[~ended], best[~ended], least[~ended]
                if not len(live):
                    break
                r = np.arange(len(live))
            # the token takes its left part's place; what follows moves up by one
            ids[r, best] = least
            columns = np.arange(ids.shape[1] - 1)
            source = columns + (columns[None, :] > best[:, None])
            ids = np.take_along_axis(ids, source, 1)
            rank = np.take_along_axis(rank, source[:, :-1], 1)
            if rank.shape[1]:
                right = np.minimum(best, rank.shape[1] - 1)
                nxt = np.minimum(right + 1, ids.shape[1] - 1)
                rank[r, right] = self.table.lookup(ids[r, right], ids[r, nxt])
                rank[best == rank.shape[1], -1] = self.table.lookup(ids[best == rank.shape[1], -2], ids[best == rank.shape[1], -1])
                left = np.maximum(best - 1, 0)
                rank[r, left] = self.table.lookup(ids[r, left], ids[r, left + 1])
        return done, lengths

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row as a matrix of its own. A round merges the leftmost pair of minimum rank and, of its further occurrences,
        those up to the first one whose union makes a pair of smaller rank with a neighbour: merging one by one would turn to
        that pair next, and to no other pair before. Merged places are skipped by links until half of the row is gone."""
        ids, n = ids.copy(), len(ids)
        while True:
            nxt, prv, kept = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
            rank = np.r_[self.table.lookup(ids[:-1], ids[1:]), NONE]
            alive = n
            while alive > n // 2:
                least = rank.min()
                if least == NONE:
                    return ids[kept]
                at = np.flatnonzero(rank == least)
                touch = np.r_[False, nxt[at[:-1]] == at[1:]]
                start = np.maximum.accumulate(np.where(touch, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]  # of overlapping occurrences, every other one
                right = nxt[at]
                after, before = nxt[right], prv[at]
                left_ids = np.where(before >= 0, ids[np.maximum(before, 0)], -1)
                left_ids[1:][before[1:] == right[:-1]] = least
                union = np.full(len(at), least, np.int32)
                right_ids = np.where(after < n, ids[np.minimum(after, n - 1)], -1)
                turns = np.flatnonzero(np.minimum(self.table.lookup(left_ids, union), self.table.lookup(union, right_ids)) < least)
                if len(turns):
                    k = turns[0] + 1
                    at, right, after, union = at[:k], right[:k], after[:k], union[:k]
                ids[at], rank[right], nxt[at], kept[right] = least, NONE, after, False
                inner = after < n
                prv[after[inner]] = at[inner]
                rank[at] = NONE
                rank[at[inner]] = self.table.lookup(union[inner], ids[after[inner]])
                before = prv[at]
                has = before >= 0
                rank[before[has]] = self.table.lookup(ids[before[has]], union[has])
                alive -= len(at)
            ids = ids[kept]
            n = len(ids)

    def pretokens(self, tokens: list[str]) -> list[np.ndarray]:
        """Ids of each pretoken."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        size = np.array([len(b) for b in raw], np.int64)
        out: list = [None] * len(raw)
        bucket = np.ceil(np.log2(np.maximum(size, 1)) * 2).astype(np.int64)  # lengths of a bucket differ by a factor below 1.5
        for b in np.unique(bucket):
            own = np.flatnonzero(bucket == b)
            width = int(size[own].max())
            if width > 512:
                for i in own:
                    out[i] = self._merge_long(self.byte[np.frombuffer(raw[i], np.uint8)])
                continue
            for part in np.array_split(own, max(1, len(own) * width // 2_000_000)):
                rows = np.full((len(part), width), -1, np.int32)
                mask = np.arange(width)[None, :] < size[part][:, None]
                rows[mask] = self.byte[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                ids, lengths = self._merge_rows(rows)
                for j, i in enumerate(part):
                    out[i] = ids[j, : lengths[j]]
        return out

    def pieces(self, new: list[str]) -> list[np.ndarray]:
        """Ids of pieces: their pretokens are encoded once each."""
        tokens = [self.split.findall(p) for p in new]
        distinct = list(dict.fromkeys(t for ts in tokens for t in ts))
        ids = dict(zip(distinct, self.pretokens(distinct)))
        empty = np.zeros(0, np.int32)
        return [np.concatenate([ids[t] for t in ts]) if ts else empty for ts in tokens]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more offset than texts). None and '' have no ids."""
        cut = _CUT.split
        flat: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                own = cut(t)
                counts[i] = len(own)
                flat += own
        code = {p: i for i, p in enumerate(dict.fromkeys(flat))}
        known = self.seen
        new = [p for p in code if p not in known]
        fresh = dict(zip(new, self.pieces(new)))
        ids = [fresh[p] if p in fresh else known[p] for p in code]
        if len(known) + len(fresh) > REMEMBER:
            known.clear()
        known.update((p, x) for p, x in fresh.items() if len(p) <= REMEMBER_CHARS)
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        size = np.array([len(x) for x in ids], np.int64)
        start = np.r_[0, np.cumsum(size)[:-1]]
        pool = np.concatenate(ids)
        codes = np.fromiter(map(code.__getitem__, flat), np.int64, len(flat))
        n = size[codes]
        ends = np.cumsum(n)
        where = np.repeat(start[codes] - (ends - n), n) + np.arange(ends[-1])
        per_text = np.r_[0, np.cumsum(counts)]
        return pool[where], np.r_[0, ends][per_text]


_CUT = re.compile(r"(?= \S)")


@functools.lru_cache(maxsize=4)
def load(vocabulary: str, folder: str = VOCABULARIES) -> Bpe:
    """The vocabulary, once per worker process."""
    return Bpe(os.path.join(folder, f"{vocabulary}.tiktoken"))


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some million characters: what is encoded at a time, so that a batch of long texts needs no more memory."""
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars > GROUP_CHARS:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """All columns of df but the text, and its token ids as an array of ints, without special tokens.

    Null and empty texts have an empty array. Strings of special tokens inside a text are ordinary text. A column that is
    called like the result is replaced. An empty table gives an empty one. One pass, no shuffle.
    """
    return _per_text(df, text, T.StructField(out, T.ArrayType(T.IntegerType(), False), False), vocabulary, folder)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """As `encode`, but with the number of tokens; 0 for null and empty texts."""
    return _per_text(df, text, T.StructField(out, T.LongType(), False), vocabulary, folder)


def _per_text(df: DataFrame, text: str, field: T.StructField, vocabulary: str, folder: str) -> DataFrame:
    keep = [c for c in df.columns if c not in (text, field.name)]
    names = [f"c{i}" for i in range(len(keep))]  # names with dots don't reach the batches
    schema = T.StructType([T.StructField(n, df.schema[df.columns.index(c)].dataType) for n, c in zip(names, keep)] + [T.StructField("out", field.dataType, False)])
    lists = isinstance(field.dataType, T.ArrayType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, folder)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            rest = batch.select(names)
            for a, b in _groups(texts):
                ids, offsets = bpe.encode(texts[a:b])
                made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())) if lists else pa.array(np.diff(offsets), pa.int64())
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, made], names=[*names, "out"])

    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip([*keep, text], [*names, "text"])])
    return plain.mapInArrow(run, schema).toDF(*keep, field.name)
