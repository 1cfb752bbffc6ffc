"""Vector search over all rows: top-k lists, thresholds, diversity, leader clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadstone.functions.vectors import cosine, rows_matrix
from threadstone.session import Workspace

#: Query vectors that one search task scores its rows against.
QUERY_BLOCK = 1024
#: Bytes of row vectors, in double precision, that one search task holds.
PART_BYTES = 64 << 20


def top_k(df: DataFrame, key: str, embedding: str, query: Column, k: int, keep: list[str] | None = None) -> DataFrame:
    """The k rows nearest to one query by cosine, ties by key; rows without a vector are left out."""
    scored = df.filter(F.col(embedding).isNotNull()).select(key, *(keep or []), cosine(embedding, query).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def top_k_per_group(df: DataFrame, group: str, key: str, embedding: str, query: Column, k: int, threshold: float | None = None) -> DataFrame:
    """The k nearest rows of each group, and of those the ones at or above a threshold: first the cut to k, then the threshold."""
    scored = df.filter(F.col(embedding).isNotNull()).select(group, key, cosine(embedding, query).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)
    return ranked if threshold is None else ranked.filter(F.col("score") >= threshold)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows; zero where a vector is null, of another length or with null elements."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    good = np.flatnonzero(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) == dim)
    m = np.zeros((len(column), dim))
    if len(good):
        m[good] = np.nan_to_num(rows_matrix(column if len(good) == len(column) else column.take(pa.array(good)), dim))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _scorer(dim: int, k: int):
    """Scores the queries of a group against its rows as matrix products, and keeps k rows per query and group."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.array(left.column("id").to_pylist())
        out: dict = {"query_id": [], "g": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            order = np.argsort(ids, kind="stable")
            base = _matrix(left.column("v"), dim)[order]
            ids = ids[order]
            groups = np.array(left.column("g").to_pylist(), object)[order]
            of: dict = {}
            for i, g in enumerate(groups):
                of.setdefault(g, []).append(i)
            qids, qm = right.column("id").to_pylist(), _matrix(right.column("v"), dim)
            for a in range(0, len(qids), QUERY_BLOCK):
                every = qm[a : a + QUERY_BLOCK] @ base.T
                for g, at in of.items():
                    s, own = (every, ids) if len(of) == 1 else (every[:, at], ids[at])
                    n = min(k, s.shape[1])
                    cut = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                    for i, row in enumerate(s):
                        near = np.flatnonzero(row >= cut[i])
                        near = near[np.argsort(-row[near], kind="stable")][:n]  # equal scores stay in the order of keys
                        out["query_id"] += [qids[a + i]] * len(near)
                        out["g"] += [g] * len(near)
                        out["id"] += own[near].tolist()
                        out["score"] += row[near].tolist()
        kinds = {"query_id": left.schema.field("id").type, "g": pa.string(), "id": left.schema.field("id").type, "score": pa.float64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return score


def search(rows: DataFrame, queries: DataFrame, key: str, embedding: str, k: int, dim: int, group: str | None = None) -> DataFrame:
    """The k nearest rows of every query by exact cosine: ``query_id, rank, <key>, score``; a query may find itself. With a
    ``group`` column of the rows, those of every query and group: ``query_id, <group>, rank, <key>, score``.

    Queries come in blocks, rows in parts; every block meets every part once, in a task of its own, as one matrix product that
    keeps k rows per query; then the lists of a query are merged. Ties go to the smaller key. Vectors that are null or of another length are
    neither found nor have results.
    """
    spark = rows.sparkSession
    # parts by size: a part's vectors fit a task whatever the number of rows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() * dim * 8 // PART_BYTES + 1)
    kind = rows.schema[key].dataType.simpleString()
    good = lambda d: d.filter(F.size(embedding) == dim)
    own = F.col(group).cast("string") if group else F.lit(None).cast("string")
    r = good(rows).select(F.col(key).alias("id"), own.alias("g"), F.col(embedding).alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"))
    q = good(queries).select(F.col(key).alias("id"), F.col(embedding).alias("v"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    r = r.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    near = r.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInArrow(_scorer(dim, k), f"query_id {kind}, g string, id {kind}, score double")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", *(["g"] if group else [])).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    shown = [F.col("g").cast(rows.schema[group].dataType).alias(group)] if group else []
    return best.select("query_id", *shown, "rank", F.col("id").alias(key), "score")


#: Rows of the sample that cells are fitted on, turns of the fit, rows of it that are asked for to see how many cells a query needs,
#: and the part of their nearest rows that those cells have to hold.
CELL_SAMPLE, CELL_TURNS, CELL_QUERIES, CELL_TARGET = 20_000, 12, 256, 0.96


def fit_cells(rows: DataFrame, key: str, embedding: str, dim: int, cells: int, k: int = 10, sample: int = CELL_SAMPLE, target: float = CELL_TARGET) -> tuple[np.ndarray, int]:
    """Unit centres of cells of directions, and how many of them a query has to be scored in: from at most ``sample`` rows, those with
    the smallest hashes of their keys. What reaches the driver is bounded by that number. The number of cells is the smallest in
    which the sample's own queries find the part ``target`` of their k nearest rows."""
    some = rows.filter(F.size(embedding) == dim).select(key, embedding).orderBy(F.xxhash64(key), key).limit(sample).toArrow()
    x = _matrix(some.column(embedding), dim)
    if not len(x):
        return np.zeros((1, dim)), 1
    centre = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(CELL_TURNS):
        own = (x @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.divide(sums, size, out=centre.copy(), where=size > 0)
    own, asked = (x @ centre.T).argmax(1), x[:CELL_QUERIES]
    near = np.argsort(-(asked @ x.T), axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ centre.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, own[near], axis=1).ravel() + 1
    return centre, int(np.ceil(np.quantile(needed, target)))


def _cells_of(centre: np.ndarray, dim: int, n: int):
    """A function of a vector that gives its n nearest cells."""

    @F.arrow_udf("array<int>")
    def run(v: pa.Array) -> pa.Array:
        near = np.argsort(-(_matrix(v, dim) @ centre.T), axis=1, kind="stable")[:, :n].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))

    return run


def search_near(rows: DataFrame, queries: DataFrame, key: str, embedding: str, k: int, dim: int, cells: int | None = None, target: float = CELL_TARGET) -> DataFrame:
    """As `search`, but each query meets only the rows of the cells nearest to it: ``query_id, rank, <key>, score``. Every row is in
    its nearest cell; scores are exact, lists may miss rows of cells that weren't probed (`recall_of` measures it). Cells are about
    the square root of the rows in number, and fitted on a bounded sample. A cell with very many rows is split into parts; the
    queries of a cell go to all of its parts."""
    kind = rows.schema[key].dataType.simpleString()
    n = rows.count()
    centre, probed = fit_cells(rows, key, embedding, dim, cells or max(1, int(n**0.5)), k, target=target)
    good = lambda d: d.filter(F.size(embedding) == dim).select(F.col(key).alias("id"), F.lit(None).cast("string").alias("g"), F.col(embedding).alias("v"))
    r = good(rows).withColumn("cell", _cells_of(centre, dim, 1)("v")[0])
    load = r.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * dim * 8 / PART_BYTES).cast("int").alias("tasks"))  # a row per cell
    r = r.join(F.broadcast(load), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")).drop("tasks")
    q = good(queries).withColumn("cell", F.explode(_cells_of(centre, dim, probed)("v")))
    q = q.join(F.broadcast(load), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    near = r.groupBy("cell", "part").cogroup(q.groupBy("cell", "part")).applyInArrow(_scorer(dim, k), f"query_id {kind}, g string, id {kind}, score double")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(key), "score")


def recall_of(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """One row ``n_exact, n_found, recall``: what part of the exact lists an approximate search has found."""
    hit = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def mmr(candidates: DataFrame, group: str, key: str, embedding: str, query: str, limit: int, lam: float = 0.65) -> DataFrame:
    """Maximal marginal relevance per query: ``<group>, mmr_rank, <key>, score``; the score is the similarity to the query.

    First the candidate nearest to the query, then always the one with the largest ``lam * sim - (1 - lam) * max(0, nearest
    picked one)``; ties to the smaller key. ``candidates`` are the short lists of a search, so groups are small. A weight
    outside 0..1 is clamped; limit 0 gives nothing.
    """
    weight = min(max(lam, 0.0), 1.0)
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in (group, key)}

    def pick(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        dim = len(t.column("q")[0].as_py())
        m, q = _matrix(t.column("v").combine_chunks(), dim), _matrix(t.column("q").combine_chunks(), dim)[0]
        sim, left, picked = m @ q, np.ones(len(m), bool), []
        near = np.zeros(len(m))
        while len(picked) < limit and left.any():
            value = np.where(left, sim if not picked else weight * sim - (1 - weight) * np.maximum(near, 0), -np.inf)
            i = int(value.argmax())
            near = m @ m[i] if not picked else np.maximum(near, m @ m[i])
            left[i] = False
            picked.append(i)
        at = pa.array(picked, pa.int64())
        return pa.table({"g": t.column("g").take(at), "mmr_rank": pa.array(range(1, len(picked) + 1), pa.int32()), "k": t.column("k").take(at), "score": pa.array(sim[picked], pa.float64())})

    few = candidates.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(embedding).alias("v"), F.col(query).alias("q"))
    picked = few.groupBy("g").applyInArrow(pick, f"g {kinds[group]}, mmr_rank int, k {kinds[key]}, score double")
    return picked.toDF(group, "mmr_rank", key, "score")


#: Cells by which leader clustering rules out pairs, at most, and the least rows of a part of them.
LINK_CELLS, LINK_ROWS = 2048, 1024


def _packed(load: list, rows: int) -> dict[int, tuple[int, int]]:
    """Parts of cells: ``cell -> (first part, parts)``. Cells share a part of at most ``rows`` rows; a larger cell has several of its own."""
    parts, at, room = {}, -1, 0
    for c in sorted(load, key=lambda c: c.cell):
        if c.n > rows:
            tasks = -(-c.n // rows)
            parts[c.cell], at, room = (at + 1, tasks), at + tasks, 0
        else:
            if c.n > room:
                at, room = at + 1, rows
            parts[c.cell], room = (at, 1), room - c.n
    return parts


def _links(left: DataFrame, right: DataFrame, dim: int, threshold: float, only_first: bool) -> DataFrame:
    """``id, prev``: for the vectors of the left those of the right with a smaller id whose cosine reaches the threshold, each or the first
    alone. Both sides (``id, v``, ids unique, vectors usable) are put into cells of directions and these into parts; two parts meet in
    a task only if the distance of two of their cells' centres less the cells' radii leaves room for such a pair, so none is lost."""
    spark = left.sparkSession
    kind = left.schema["id"].dataType.simpleString()
    centre, _ = fit_cells(right, "id", "v", dim, max(1, min(LINK_CELLS, int(right.count() ** 0.5))))

    @F.arrow_udf("double")
    def away(v: pa.Array) -> pa.Array:
        return pa.array(np.arccos(np.clip((_matrix(v, dim) @ centre.T).max(axis=1), -1, 1)))

    side, radius, parts = {}, {}, {}
    tasks = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    for name, d in (("left", left), ("right", right)):
        placed = d.withColumn("cell", _cells_of(centre, dim, 1)("v")[0])
        load = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(away("v")).alias("r")).collect()  # a row per cell
        parts[name] = _packed(load, max(LINK_ROWS, min(PART_BYTES // (dim * 8), sum(c.n for c in load) // tasks)))
        radius[name] = {c.cell: c.r for c in load}
        where = spark.createDataFrame([(c, p, n) for c, (p, n) in parts[name].items()], "cell int, first int, tasks int")
        part = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("tasks"))).cast("int")
        side[name] = placed.join(F.broadcast(where), "cell").select("id", "v", part.alias(name))
    a, b = list(radius["left"]), list(radius["right"])
    angle = np.arccos(np.clip(centre[a] @ centre[b].T, -1, 1))
    reach = np.array(list(radius["left"].values()))[:, None] + np.array(list(radius["right"].values())) + np.arccos(min(1.0, max(-1.0, threshold))) + 1e-6
    spread = lambda at: range(at[0], at[0] + at[1])
    meet = {(x, y) for i, j in np.argwhere(angle <= reach) for x in spread(parts["left"][a[i]]) for y in spread(parts["right"][b[j]])}
    pairs = spark.createDataFrame(sorted(meet), "left int, right int")

    def near(one: pa.Table, other: pa.Table) -> pa.Table:
        ids, prev = [], []
        if one.num_rows and other.num_rows:
            other = other.sort_by("before")
            own, before, base = one.column("id").to_pylist(), other.column("before").to_pylist(), _matrix(other.column("base"), dim)
            for at in range(0, one.num_rows, QUERY_BLOCK):
                reached = _matrix(one.column("v").slice(at, QUERY_BLOCK), dim) @ base.T >= threshold
                for i in np.flatnonzero(reached.any(axis=1)):
                    for j in np.flatnonzero(reached[i]):
                        if before[j] >= own[at + i]:
                            break
                        ids.append(own[at + i])
                        prev.append(before[j])
                        if only_first:
                            break
        field = one.schema.field("id").type
        return pa.table({"id": pa.array(ids, field), "prev": pa.array(prev, field)})

    one = side["left"].join(pairs, "left").select("left", "right", "id", "v")
    other = side["right"].join(pairs, "right").select("left", "right", "id", "v").toDF("to_left", "to_right", "before", "base")
    met = one.groupBy("left", "right").cogroup(other.groupBy("to_left", "to_right"))
    return met.applyInArrow(near, f"id {kind}, prev {kind}")


def _settled(ws: Workspace, name: str, rest: DataFrame, links: DataFrame) -> DataFrame:
    """``id, leader`` of rows that no row outside leads: a row is led once a smaller one linked to it leads, and leads once all of those are
    led, so every round settles at least the smallest row left; all rows decide at once."""
    settled = ws.cut(rest.select("id").join(links.select("id").distinct(), "id", "left_anti").select("id", F.lit(True).alias("leads")), f"{name}-0")
    open_, turn = links, 0
    while True:
        turn += 1
        known = open_.join(settled.withColumnRenamed("id", "prev"), "prev", "left")
        state = known.groupBy("id").agg(F.coalesce(F.max("leads"), F.lit(False)).alias("led"), (F.count("leads") == F.count(F.lit(1))).alias("all"))
        new = ws.cut(state.filter("led or all").select("id", (~F.col("led")).alias("leads")), f"{name}-{turn}")
        if new.isEmpty():
            break
        settled = settled.unionByName(new)
        open_ = ws.cut(open_.join(new, "id", "left_anti"), f"{name}-open{turn}")
        if turn % 8 == 0:
            settled = ws.cut(settled, f"{name}-all{turn}")
    ws.drop(*[f"{name}-open{i}" for i in range(1, turn)])
    first = links.join(settled.filter("leads").select(F.col("id").alias("prev")), "prev").groupBy("id").agg(F.min("prev").alias("leader"))
    return settled.filter("leads").select("id", F.col("id").alias("leader")).unionByName(settled.filter("not leads").join(first, "id").select("id", "leader"))


def leader_clusters(df: DataFrame, key: str, embedding: str, dim: int, threshold: float, block: int = 5_000) -> DataFrame:
    """Leader clustering in the order of keys: ``<key>, leader``, one row per key. A row without a leader yet becomes one and takes every
    later row without a leader whose cosine reaches the threshold. Rows of one key count once, with their smallest usable vector;
    rows without one (null, of another length, all zeros, with elements null or not finite) lead themselves, a null key has a
    null leader. A threshold above 1 takes nothing, at 1 or below equal vectors always reach it.

    Copies of a vector follow its first row. Different vectors are taken in stretches of their order that double in size: the rows
    of a stretch look for the first leader of those before, all at once; what finds none, a small rest as a rule, is linked among
    itself (`_links`) and settled in rounds (`_settled`). The first stretch, ``block`` rows, is clustered in one task. What reaches the
    driver is bounded: cells' sizes and a sample of keys. Runs jobs while the frame is being made.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "leaders")
    kind = df.schema[key].dataType.simpleString()
    finite = F.forall(embedding, lambda x: F.abs(x) < float("inf")) & F.exists(embedding, lambda x: x != 0)
    usable = F.coalesce((F.size(embedding) == dim) & finite, F.lit(False)) & F.col(key).isNotNull()
    rows = df.select(F.col(key).alias("id"), F.when(usable, F.col(embedding)).cast("array<double>").alias("v"))
    rows = ws.cut(rows.groupBy("id").agg(F.min("v").alias("v")), "rows")
    alone = rows.filter(F.lit(threshold > 1) | F.col("v").isNull()).select("id", F.col("id").alias("leader"))
    reps = ws.cut(rows.filter(F.lit(threshold <= 1) & F.col("v").isNotNull()).groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "reps")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if own:
            t = pa.Table.from_batches(own).sort_by("id")
            ids, m = t.column("id").to_pylist(), _matrix(t.column("v"), dim)
            lead = np.full(len(m), -1)
            for i in range(len(m)):
                if lead[i] < 0:
                    later = np.flatnonzero(lead[i + 1 :] < 0) + i + 1
                    lead[i] = i
                    lead[later[m[later] @ m[i] >= threshold]] = i
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, t.schema.field("id").type), "leader": pa.array([ids[i] for i in lead], t.schema.field("id").type)})

    n = reps.count()
    if not n:
        return alone.select(F.col("id").alias(key), "leader")
    some = sorted(reps.select("id").orderBy(F.xxhash64("id"), "id").limit(CELL_SAMPLE).toArrow().column("id").to_pylist())
    bounds = [reps.orderBy("id").limit(block).agg(F.max("id")).first()[0]]
    size = block
    while size < n:
        size *= 2
        to = some[-1] if size >= n else some[int(len(some) * size / n)]
        if size < n and to > bounds[-1]:
            bounds.append(to)
    at = F.lit(bounds[0]).cast(kind)
    made = [ws.cut(reps.filter(F.col("id") <= at).coalesce(1).mapInArrow(inside, f"id {kind}, leader {kind}"), "led0")]
    for b, low in enumerate(bounds if n > block else [], 1):
        own = reps.filter(F.col("id") > F.lit(low).cast(kind))
        if b < len(bounds):
            own = own.filter(F.col("id") <= F.lit(bounds[b]).cast(kind))
        before = made[0]
        for d in made[1:]:
            before = before.unionByName(d)
        leaders = ws.cut(reps.join(before.filter("id = leader").select("id"), "id"), f"leaders{b}")
        led = ws.cut(_links(own, leaders, dim, threshold, True).groupBy("id").agg(F.min("prev").alias("leader")), f"found{b}")
        ws.drop(f"leaders{b}")
        rest = ws.cut(own.join(led.select("id"), "id", "left_anti"), f"rest{b}")
        made.append(led)
        if not rest.isEmpty():
            links = ws.cut(_links(rest, rest, dim, threshold, False), f"links{b}")
            made.append(ws.cut(_settled(ws, f"settled{b}", rest, links), f"led{b}"))
    whole = made[0]
    for d in made[1:]:
        whole = whole.unionByName(d)
    first = reps.withColumnRenamed("id", "rep").join(whole.withColumnRenamed("id", "rep"), "rep").select("v", "leader")
    return alone.unionByName(rows.filter("v is not null").join(first, "v").select("id", "leader")).select(F.col("id").alias(key), "leader")
