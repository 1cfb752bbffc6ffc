"""Bounded traversal of the call graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadstone.functions.ids import bare_callee, canonical_id
from threadstone.session import Workspace

MOST_HOPS = 5
#: Edges that one block of a packed graph holds.
BLOCK_EDGES = 100_000
#: Rows that a walk hands on at once.
WALK_ROWS = 50_000


def name_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls as edges between names: ``src, dst``, each once. The caller's name is that of its symbol's latest row; a caller
    that is no symbol keeps its id. Calls without caller or callee are left out."""
    named = symbols.select(canonical_id("id").alias("sid"), "name", F.struct("indexed_at", "row_id").alias("v"))
    named = named.groupBy("sid").agg(F.max_by("name", "v").alias("name"))
    bare = calls.select(canonical_id("caller_symbol_id").alias("sid"), bare_callee("callee_name").alias("dst"))
    bare = bare.filter(F.col("sid").isNotNull() & F.col("dst").isNotNull()).distinct()
    return bare.join(named, "sid", "left").select(F.coalesce("name", "sid").alias("src"), "dst").distinct()


def neighbourhood(edges: DataFrame, roots: DataFrame, hops: int, direction: str = "callees") -> DataFrame:
    """Nodes within some hops of each root: ``root, node, hop, direction``, each at its first hop. ``roots`` has one column
    ``root``. Callees follow edges forwards, callers backwards. The root itself comes back where a cycle leads to it. Hops are
    clamped to 1..5. All roots are expanded together, one join per hop; nodes seen before are not expanded again."""
    ws = Workspace(edges.sparkSession, "graph")
    near, far = ("src", "dst") if direction == "callees" else ("dst", "src")
    step = ws.cut(edges.select(F.col(near).alias("at"), F.col(far).alias("node")), "edges")  # read once per hop
    front = roots.select("root").distinct().withColumn("at", F.col("root"))
    seen: list[DataFrame] = []
    for hop in range(1, min(max(hops, 1), MOST_HOPS) + 1):
        new = front.join(step, "at").select("root", "node").distinct()
        if seen:
            new = new.join(reduce(DataFrame.unionByName, seen).select("root", "node"), ["root", "node"], "left_anti")
        new = ws.cut(new.withColumn("hop", F.lit(hop)), f"hop{hop}")
        seen.append(new)
        front = new.select("root", F.col("node").alias("at"))
    return reduce(DataFrame.unionByName, seen).withColumn("direction", F.lit(direction))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``near, far`` as compressed blocks: the near names, then the far ones, as codes of the block's own dictionary."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by("near")  # packs better
        rows = pa.record_batch({"name": pa.chunked_array([*t["near"].chunks, *t["far"].chunks]).combine_chunks().dictionary_encode()})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(rows)
        return pa.record_batch({"block": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK_EDGES:
            yield block(held)
            held = []
    if sum(x.num_rows for x in held):
        yield block(held)


class _Graph:
    """Edges as codes, those of a node side by side: node i's are ``far[start[i]:start[i + 1]]``."""

    def __init__(self, blocks: list[bytes]):
        read = pa.chunked_array([pa.ipc.open_stream(b).read_next_batch().column("name") for b in blocks]).unify_dictionaries()
        self.names = read.chunk(0).dictionary
        n, codes = len(self.names), [c.indices.to_numpy() for c in read.chunks]
        near, far = (np.concatenate([np.split(c, 2)[i] for c in codes]) for i in (0, 1))
        edges = np.sort(near.astype(np.int64) * n + far)
        self.far = (edges % n).astype(np.int32)
        self.start = np.searchsorted(edges, np.arange(n + 1, dtype=np.int64) * n)
        self.seen, self.slot = np.zeros(n, bool), np.zeros(n, np.int32)

    def walk(self, root: int, hops: int) -> list[np.ndarray]:
        """The nodes first met at each hop."""
        found, front = [], np.array([root])
        for _ in range(hops):
            begin = self.start[front]
            n = self.start[front + 1] - begin
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            new = self.far[at]
            new = new[~self.seen[new]]
            order = np.arange(len(new), dtype=np.int32)
            self.slot[new] = order  # one of a node's places stays
            front = new[self.slot[new] == order]
            self.seen[front] = True
            found.append(front)
        for x in found:
            self.seen[x] = False
        return found


def _walks(hops: int):
    """Walks from the roots of a task over the whole graph; the graph's blocks and the roots come in any order."""

    def rows(g: _Graph, roots: list[int], found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        nodes = np.concatenate([x for f in found for x in f])
        root = np.repeat(np.array(roots, np.int32), [sum(map(len, f)) for f in found])
        hop = np.repeat(np.tile(np.arange(1, hops + 1, dtype=np.int32), len(found)), [len(x) for f in found for x in f])
        for i in range(0, len(nodes), WALK_ROWS):
            j = slice(i, i + WALK_ROWS)
            yield pa.record_batch({"root": g.names.take(pa.array(root[j])), "node": g.names.take(pa.array(nodes[j])), "hop": pa.array(hop[j])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, asked = [], []
        for b in batches:
            blocks += b.column("block").drop_null().to_pylist()
            asked.append(b.column("root").drop_null())
        if not blocks or not sum(map(len, asked)):
            return
        g = _Graph(blocks)
        blocks.clear()
        known = pc.index_in(pa.chunked_array(asked), value_set=g.names).drop_null()
        roots, found, n = [], [], 0
        for r in np.unique(known.to_numpy()).tolist():
            roots.append(r)
            found.append(g.walk(r, hops))
            n += sum(map(len, found[-1]))
            if n >= WALK_ROWS:
                yield from rows(g, roots, found)
                roots, found, n = [], [], 0
        if n:
            yield from rows(g, roots, found)

    return run


def neighbourhoods(edges: DataFrame, roots: DataFrame, hops: int, direction: str = "callees") -> DataFrame:
    """As `neighbourhood`, for very many roots, whose neighbours together outgrow the edges by far: no hop is stored or shuffled.
    The roots are dealt to tasks, two a core, each of which gets the whole graph as packed blocks, walks from root to root and
    hands the rows on. Only the graph moves, once per task; a task holds it (8 bytes an edge, and the nodes' names)."""
    near, far = ("src", "dst") if direction == "callees" else ("dst", "src")
    tasks = 2 * edges.sparkSession.sparkContext.defaultParallelism
    blocks = edges.select(F.col(near).alias("near"), F.col(far).alias("far")).mapInArrow(_packed, "block binary")
    blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "block", F.lit(None).cast("string").alias("root"))
    own = roots.filter(F.col("root").isNotNull()).select(F.pmod(F.xxhash64("root"), F.lit(tasks)).cast("int").alias("task"), F.lit(None).cast("binary").alias("block"), "root")
    dealt = blocks.unionByName(own).repartitionById(tasks, "task").select("block", "root")
    walked = dealt.mapInArrow(_walks(min(max(hops, 1), MOST_HOPS)), "root string, node string, hop int")
    return walked.withColumn("direction", F.lit(direction))


def impact(edges: DataFrame, roots: DataFrame, hops: int = 2) -> DataFrame:
    """Callees and callers of each root."""
    return neighbourhood(edges, roots, hops, "callees").unionByName(neighbourhood(edges, roots, hops, "callers"))


def doc_references(refs: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Sections that refer to symbols of the given names: ``root, doc_section_id, context``, each once."""
    ids = symbols.select(canonical_id("id").alias("sid"), F.col("name").alias("root")).join(names, "root").distinct()
    return refs.select(canonical_id("symbol_id").alias("sid"), "doc_section_id", F.coalesce("context", F.lit("")).alias("context")).join(ids, "sid").select(
        "root", "doc_section_id", "context"
    ).distinct()


def targets(symbols: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """The first symbol, by id, of each name: ``root, kind, path, signature``. ``files``: ``id, relative_path``."""
    own = symbols.select(F.col("name").alias("root"), canonical_id("id").alias("sid"), "indexed_at", "row_id", "kind", canonical_id("file_id").alias("fid"), "signature").join(names, "root")
    own = own.groupBy("root").agg(F.min_by(F.struct("kind", "fid", "signature"), F.struct("sid", "indexed_at", "row_id")).alias("x")).select("root", "x.*")
    return own.join(files.select(F.col("id").alias("fid"), "relative_path"), "fid", "left").select("root", "kind", F.coalesce("relative_path", F.lit("unknown")).alias("path"), "signature")


def render(about: DataFrame, found: DataFrame, refs: DataFrame) -> DataFrame:
    """A text per root: target, signature, callers, callees and documentation. The lists are those of a bounded neighbourhood."""
    part = lambda d: F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.col("node"))))
    lists = found.groupBy("root").agg(part("callers").alias("callers"), part("callees").alias("callees"))
    docs = refs.groupBy("root").agg(F.array_sort(F.collect_set("doc_section_id")).alias("docs"))
    row = lambda title, c, by: F.when(F.size(c) > 0, F.concat(F.lit(f"[{title}] "), F.array_join(c, by)))
    both = about.join(lists, "root", "left").join(docs, "root", "left")
    head = F.format_string("[Target] %s (%s) in %s", "root", "kind", "path")
    signature = F.when(F.col("signature").isNotNull(), F.concat(F.lit("[Signature] "), "signature"))
    return both.select("root", F.concat_ws("\n", head, signature, row("Callers", "callers", ", "), row("Callees", "callees", ", "), row("Documentation", "docs", " | ")).alias("text"))
