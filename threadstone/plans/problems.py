"""Queries of the data problems in the core: orphan references, hierarchies, attribute history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadstone.functions.ids import bare_callee, canonical_id
from threadstone.operators import hierarchy as H
from threadstone.operators import history as V
from threadstone.operators import orphans as O
from threadstone.session import Workspace, table

_INTO = {
    ("symbols", "file_id"): "file",
    ("call_edges", "caller_symbol_id"): "symbol",
    ("doc_references", "symbol_id"): "symbol",
    ("call_edges", "callee_name"): "name",
}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    symbols, edges = table(spark, d, "symbols"), table(spark, d, "call_edges")
    builtin = table(spark, d, "builtin_names").select(F.col("name").alias("key")).distinct()
    refs = O.references(symbols, "symbols", "file_id", "row_id", canonical_id("file_id"), "indexed_at")
    refs = refs.unionByName(O.references(edges, "call_edges", "caller_symbol_id", "edge_id", canonical_id("caller_symbol_id"), "valid_from"))
    refs = refs.unionByName(
        O.references(edges, "call_edges", "callee_name", "edge_id", bare_callee("callee_name"), "valid_from").join(builtin, "key", "left_anti")
    )
    docs = table(spark, d, "doc_references")
    refs = refs.unionByName(O.references(docs, "doc_references", "symbol_id", "ref_id", canonical_id("symbol_id"), "created_at"))
    pars = O.parents(table(spark, d, "files"), "file", canonical_id("id"), "last_indexed_at", "deleted_at")
    pars = pars.unionByName(O.parents(symbols, "symbol", canonical_id("id"), "indexed_at", "deleted_at"))
    pars = pars.unionByName(O.parents(symbols, "name", F.trim("name"), "indexed_at", "deleted_at"))
    return O.orphans(refs, pars, _INTO)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(p1_found(spark, d))


_SQL_ID = "nullif(regexp_replace(lower(trim({0})), '^[a-z_]+:|[⟨⟩`\\s]', '', 'g'), '')"
_SQL_CALLEE = r"""nullif(regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(callee_name, '\s+', '', 'g'), '!?\(.*$|!$', ''), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '(::)+$', ''), '([^.:>]*)$', 1), '')"""
_SQL_ORPHANS = f"""
WITH refs AS (
  SELECT 'symbols' AS src_table, 'file_id' AS field_name, row_id, 'file' AS space, {_SQL_ID.format("file_id")} AS key, indexed_at AS t FROM symbols
  UNION SELECT 'call_edges', 'caller_symbol_id', edge_id, 'symbol', {_SQL_ID.format("caller_symbol_id")}, valid_from FROM call_edges
  UNION SELECT 'doc_references', 'symbol_id', ref_id, 'symbol', {_SQL_ID.format("symbol_id")}, created_at FROM doc_references
  UNION SELECT 'call_edges', 'callee_name', edge_id, 'name', {_SQL_CALLEE}, valid_from FROM call_edges
), pars AS (
  SELECT 'file' AS space, {_SQL_ID.format("id")} AS key, last_indexed_at AS a, deleted_at AS b FROM files
  UNION SELECT 'symbol', {_SQL_ID.format("id")}, indexed_at, deleted_at FROM symbols
  UNION SELECT 'name', trim(name), indexed_at, deleted_at FROM symbols
), orphans AS (
  SELECT src_table, field_name, row_id, strftime(t, '%Y-%m') AS period FROM refs r
  WHERE key IS NOT NULL AND (space <> 'name' OR key NOT IN (SELECT name FROM builtin_names))
    AND NOT EXISTS (SELECT 1 FROM pars p WHERE p.space = r.space AND p.key = r.key AND (p.a IS NULL OR p.a <= r.t) AND (p.b IS NULL OR p.b > r.t))
)
"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    return H.latest_parent(table(spark, d, "symbols"), canonical_id("id"), canonical_id("parent_id"), F.col("indexed_at"), F.col("row_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    tree = H.hierarchy(_links(spark, d), with_path=False)
    return tree.select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = H.hierarchy(_links(spark, d), with_sizes=True)
    path = F.array_join("path", "/")
    return tree.select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), "depth", path.alias("path"), "n_descendants", "on_cycle")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(_links(spark, d)))


_SQL_TREE = f"""
WITH RECURSIVE par AS (
  SELECT id, parent FROM (
    SELECT {_SQL_ID.format("id")} AS id, {_SQL_ID.format("parent_id")} AS parent,
           row_number() OVER (PARTITION BY {_SQL_ID.format("id")} ORDER BY indexed_at DESC, row_id DESC) AS rn FROM symbols)
  WHERE rn = 1
), tree AS (
  SELECT id, id AS root, 0::BIGINT AS depth, id AS path FROM par WHERE parent IS NULL OR parent NOT IN (SELECT id FROM par)
  UNION ALL
  SELECT p.id, t.root, t.depth + 1, t.path || '/' || p.id FROM par p JOIN tree t ON p.parent = t.id
)
"""

_ATTRIBUTES = ["status", "superseded_by", "valid_until_s"]


def _memory_observations(spark: SparkSession, d: str) -> tuple[Workspace, DataFrame]:
    df = table(spark, d, "memory_snapshots")
    status = F.nullif(F.lower(F.trim("status")), F.lit(""))
    attributes = {
        "status": status,
        "superseded_by": canonical_id("superseded_by"),
        "valid_until_s": F.floor(F.unix_micros(F.col("valid_until").cast("timestamp")) / 1_000_000).cast("long"),
    }
    order = [F.col("ingested_at"), F.col("row_id")]
    obs = V.observations(df, canonical_id("id"), F.col("snapshot_at"), order, attributes, status.isNotNull(), F.col("created_at"))
    ws = Workspace(spark, "history")
    return ws, ws.cut(obs, "observations")


def _memory_log(spark: SparkSession, d: str, parts: int = 1) -> tuple[V.ChangeLog, DataFrame]:
    """The stored change log, written in so many appends, and the observations."""
    ws, obs = _memory_observations(spark, d)
    log = V.ChangeLog(spark, ws.path("log"), _ATTRIBUTES)
    first, last = obs.agg(F.min("at_s"), F.max("at_s")).first() if parts > 1 else (None, None)
    if first is None:
        log.append(obs)
        return log, obs
    step = (last - first) // parts + 1
    for i in range(parts):
        log.append(obs.filter((F.col("at_s") >= first + i * step) & (F.col("at_s") < first + (i + 1) * step)))
    return log, obs


def _memory_versions(spark: SparkSession, d: str, parts: int = 1) -> DataFrame:
    log, obs = _memory_log(spark, d, parts)
    versions = log.versions()
    # the first version of an entity begins at its birth: one small row per entity
    first = log.log().groupBy("entity").agg(F.min("at_s").alias("at_s")).join(V.births(obs), "entity")
    return versions.join(first, ["entity", "at_s"], "left").select(
        F.col("entity").alias("memory_id"), F.coalesce("born_s", "at_s").alias("valid_from_s"), F.coalesce("valid_to_s", F.lit(-1).cast("long")).alias("valid_to_s"), *_ATTRIBUTES
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _memory_versions(spark, d).select("memory_id", "valid_from_s", "valid_to_s")


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    return _memory_versions(spark, d)


def p5_appended(spark: SparkSession, d: str) -> DataFrame:
    """The same history from a log to which the snapshots were appended in three parts."""
    return _memory_versions(spark, d, 3)


AS_OF_S = 1_735_689_600  # 2025-01-01


def p5_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The state of every memory at one time, from checkpoints and patches."""
    log, _ = _memory_log(spark, d)
    return log.as_of(AS_OF_S).select(F.col("entity").alias("memory_id"), *_ATTRIBUTES)


def p5_storage(spark: SparkSession, d: str) -> DataFrame:
    """The change log itself: checkpoints and patches."""
    log = _memory_log(spark, d)[0].log()
    return log.select(
        F.col("entity").alias("memory_id"), "period", "at_s", "is_checkpoint", "is_change",
        *[F.col(f"patch.{a}").isNotNull().alias(f"patches_{a}") for a in _ATTRIBUTES], *[F.col(f"patch.{a}.v").alias(a) for a in _ATTRIBUTES],
    )


_SQL_HISTORY = f"""
WITH obs AS (
  SELECT * FROM (
    SELECT {_SQL_ID.format("id")} AS id, epoch(date_trunc('second', snapshot_at))::BIGINT AS at_s, lower(trim(status)) AS status,
           {_SQL_ID.format("superseded_by")} AS superseded_by, epoch(date_trunc('second', valid_until))::BIGINT AS valid_until_s,
           row_number() OVER (PARTITION BY {_SQL_ID.format("id")}, snapshot_at ORDER BY ingested_at DESC, row_id DESC) AS rn
    FROM memory_snapshots WHERE trim(status) <> '')
  WHERE rn = 1
), changes AS (
  SELECT *, lag(at_s) OVER w IS NULL AS is_first,
         lag(at_s) OVER w IS NULL OR lag(status) OVER w IS DISTINCT FROM status OR lag(superseded_by) OVER w IS DISTINCT FROM superseded_by
         OR lag(valid_until_s) OVER w IS DISTINCT FROM valid_until_s AS is_change
  FROM obs WINDOW w AS (PARTITION BY id ORDER BY at_s)
), born AS (
  SELECT {_SQL_ID.format("id")} AS id, min(epoch(date_trunc('second', created_at))::BIGINT) AS born FROM memory_snapshots GROUP BY 1
), versions AS (
  SELECT c.id AS memory_id, CASE WHEN is_first THEN coalesce(born, at_s) ELSE at_s END AS valid_from_s,
         coalesce(lead(at_s) OVER (PARTITION BY c.id ORDER BY at_s), -1)::BIGINT AS valid_to_s, status, superseded_by, valid_until_s
  FROM changes c LEFT JOIN born b ON b.id = c.id WHERE is_change
)
"""


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_paths": p2_paths,
    "p2_descendants": p2_descendants,
    "p5_found": p5_found,
    "p5_history": p5_history,
    "p5_appended": p5_appended,
    "p5_as_of": p5_as_of,
    "p5_storage": p5_storage,
}

SQL = {
    "p1_found": _SQL_ORPHANS + "SELECT DISTINCT src_table, field_name, row_id, period FROM orphans",
    "p1_report": _SQL_ORPHANS + "SELECT src_table, field_name, period, count(*) AS n_orphans FROM (SELECT DISTINCT * FROM orphans) GROUP BY ALL",
    "p2_found": _SQL_TREE + "SELECT p.id AS symbol_id, coalesce(t.root, '') AS root_id, coalesce(t.depth, -1) AS depth FROM par p LEFT JOIN tree t ON t.id = p.id",
    "p2_paths": _SQL_TREE
    + """, pairs AS (SELECT unnest(string_split(path, '/')) AS a, id FROM tree), sizes AS (SELECT a, count(*) - 1 AS n FROM pairs GROUP BY 1)
    SELECT p.id AS symbol_id, coalesce(t.root, '') AS root_id, coalesce(t.depth, -1) AS depth, t.path AS path, coalesce(s.n, 0)::BIGINT AS n_descendants,
           t.root IS NULL AS on_cycle FROM par p LEFT JOIN tree t ON t.id = p.id LEFT JOIN sizes s ON s.a = p.id""",
    "p2_descendants": _SQL_TREE
    + """SELECT ancestor, id AS descendant, (depth + 1 - pos)::BIGINT AS distance FROM (
      SELECT id, depth, unnest(string_split(path, '/')) AS ancestor, generate_subscripts(string_split(path, '/'), 1) AS pos FROM tree) WHERE ancestor <> id""",
    "p5_found": _SQL_HISTORY + "SELECT memory_id, valid_from_s, valid_to_s FROM versions",
    "p5_history": _SQL_HISTORY + "SELECT * FROM versions",
    "p5_appended": _SQL_HISTORY + "SELECT * FROM versions",
    "p5_as_of": _SQL_HISTORY
    + f"""SELECT id AS memory_id, status, superseded_by, valid_until_s FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY at_s DESC) AS n FROM changes WHERE at_s <= {AS_OF_S}) WHERE n = 1""",
    "p5_storage": _SQL_HISTORY
    + """, periods AS (SELECT *, at_s // 7776000 AS period, lag(at_s // 7776000) OVER w IS DISTINCT FROM at_s // 7776000 AS is_checkpoint,
      lag(status) OVER w AS s0, lag(superseded_by) OVER w AS b0, lag(valid_until_s) OVER w AS u0 FROM changes WINDOW w AS (PARTITION BY id ORDER BY at_s)),
    marks AS (SELECT *, is_checkpoint OR status IS DISTINCT FROM s0 AS ps, is_checkpoint OR superseded_by IS DISTINCT FROM b0 AS pb, is_checkpoint OR valid_until_s IS DISTINCT FROM u0 AS pu FROM periods)
    SELECT id AS memory_id, period, at_s, is_checkpoint, is_change, ps AS patches_status, pb AS patches_superseded_by, pu AS patches_valid_until_s, CASE WHEN ps THEN status END AS status,
      CASE WHEN pb THEN superseded_by END AS superseded_by, CASE WHEN pu THEN valid_until_s END AS valid_until_s FROM marks WHERE is_checkpoint OR is_change""",
}
