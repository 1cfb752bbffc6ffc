"""Queries of the retrieval, graph, memory, hygiene and text operators over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadstone.functions import ids as I
from threadstone.functions import text as T
from threadstone.functions import tokens as K
from threadstone.functions import vectors as V
from threadstone.operators import delta, graph, hygiene, memory, packing, search, synthesis, textual
from threadstone.operators import vectors as VO
from threadstone.plans.problems import _SQL_CALLEE, _SQL_ID
from threadstone.session import table
from threadstone.streaming import events as ST

QUERIES: dict = {}
SQL: dict[str, str] = {}

ROOT, WORD, NOW, AS_OF = "dispatch", "retry", "2026-01-01 00:00:00", "2025-06-01 00:00:00"
TAGS = ["budget", "digest", "vault"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _cid(c: str) -> str:
    return _SQL_ID.format(c)


_LINES = r"(CASE WHEN list_extract(string_split(replace({0}, chr(13)||chr(10), chr(10)), chr(10)), -1) = '' THEN list_slice(string_split(replace({0}, chr(13)||chr(10), chr(10)), chr(10)), 1, -2) ELSE string_split(replace({0}, chr(13)||chr(10), chr(10)), chr(10)) END)"
_TOKENS = r"(CASE WHEN {0} IS NULL OR {0} = '' THEN 0 ELSE greatest(ceil(length({0}) / 3.0)::BIGINT, len(list_filter(string_split_regex({0}, '[\s\x0B\x{{85}}\p{{Z}}]+'), lambda x: x <> '')), 1) END)::BIGINT"
_SOURCE = "nullif(replace(lower(trim(source)), '-', '_'), '')"
_SQL_FILES = f"(SELECT id, project_id, relative_path, content_hash, deleted_at FROM (SELECT {_cid('id')} AS id, project_id, relative_path, content_hash, deleted_at, row_number() OVER (PARTITION BY {_cid('id')} ORDER BY last_indexed_at DESC NULLS LAST, content_hash DESC NULLS LAST) AS rn FROM files) WHERE rn = 1)"
_SQL_FIRST_FILES = f"(SELECT id, project_id, relative_path, content_hash FROM (SELECT {_cid('id')} AS id, project_id, relative_path, content_hash, row_number() OVER (PARTITION BY {_cid('id')} ORDER BY last_indexed_at NULLS FIRST, content_hash NULLS FIRST) AS rn FROM files) WHERE rn = 1)"
_SQL_MEMORY = f"(SELECT * EXCLUDE (rn, status, id), lower(trim(status)) AS status, {_cid('id')} AS id FROM (SELECT *, row_number() OVER (PARTITION BY {_cid('id')} ORDER BY snapshot_at DESC, ingested_at DESC, row_id DESC) AS rn FROM memory_snapshots WHERE trim(status) <> '') WHERE rn = 1)"
_SQL_SYMBOLS = f"(SELECT * EXCLUDE (rn, id), {_cid('id')} AS id FROM (SELECT *, row_number() OVER (PARTITION BY {_cid('id')} ORDER BY indexed_at DESC, row_id DESC) AS rn FROM symbols) WHERE rn = 1)"
_SQL_NAME_EDGES = f"(SELECT DISTINCT coalesce(s.name, e.sid) AS src, e.dst FROM (SELECT DISTINCT {_cid('caller_symbol_id')} AS sid, {_SQL_CALLEE} AS dst FROM call_edges) e LEFT JOIN {_SQL_SYMBOLS} s ON s.id = e.sid WHERE e.sid IS NOT NULL AND e.dst IS NOT NULL)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").withColumn("id", I.canonical_id("id"))
    return delta.latest(f.select("id", "project_id", "relative_path", "content_hash", "deleted_at", "last_indexed_at"), ["id"], ["last_indexed_at", "content_hash"])


def _first_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select(I.canonical_id("id").alias("id"), "project_id", "relative_path", "content_hash", "last_indexed_at")
    o = F.struct("last_indexed_at", "content_hash")
    return f.groupBy("id").agg(F.min_by(F.struct("project_id", "relative_path", "content_hash"), o).alias("x")).select("id", "x.*")


def _memories(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memory_snapshots").withColumn("id", I.canonical_id("id")).withColumn("status", F.lower(F.trim("status")))
    return delta.latest(m.filter(F.col("status") != ""), ["id"], ["snapshot_at", "ingested_at", "row_id"])


def _symbols(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    s = table(spark, d, "symbols").withColumn("id", I.canonical_id("id"))
    return delta.latest(s.select("id", "indexed_at", "row_id", *columns), ["id"], ["indexed_at", "row_id"]).select("id", *columns)


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", *columns).distinct()


def _ntz(x: str):
    return F.lit(x).cast("timestamp_ntz")


# ---- identifiers, counts, scans -------------------------------------------------------------------------------------


@query("SELECT DISTINCT id, sha256(replace(relative_path, '\\', '/')) AS path_id FROM files")
def ids_files(spark, d):
    return table(spark, d, "files").select("id", I.file_id("relative_path").alias("path_id")).distinct()


@query(f"SELECT DISTINCT row_id, sha256({_cid('file_id')} || '::' || qualified_name) AS derived_id FROM symbols")
def ids_symbols(spark, d):
    return table(spark, d, "symbols").select("row_id", I.symbol_id(I.canonical_id("file_id"), "qualified_name").alias("derived_id")).distinct()


@query(
    f"SELECT DISTINCT id, sha256({_cid('file_id')} || coalesce({_cid('symbol_id')}, '') || kind || content_hash) AS derived_id, "
    "sha256(embedding_model || 'f32' || embedding_dim::VARCHAR || 'Mean' || 'norm:true') AS vector_set FROM chunks"
)
def ids_chunks(spark, d):
    made = I.chunk_id(I.canonical_id("file_id"), I.canonical_id("symbol_id"), "kind", "content_hash")
    vectors = I.vector_set_id("embedding_model", F.lit("f32"), "embedding_dim", F.lit("Mean"), F.lit(True))
    return table(spark, d, "chunks").select("id", made.alias("derived_id"), vectors.alias("vector_set")).distinct()


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys FROM {t}" for t, k in (("files", "id"), ("symbols", "id"), ("chunks", "id"), ("call_edges", "edge_id"), ("doc_sections", "id")))
)
def count_all(spark, d):
    out = None
    for t, k in (("files", "id"), ("symbols", "id"), ("chunks", "id"), ("call_edges", "edge_id"), ("doc_sections", "id")):
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(k).alias("n_keys")).select(F.lit(t).alias("table_name"), "n_rows", "n_keys")
        out = one if out is None else out.unionByName(one)
    return out


_DUMPED = {
    "files": ["id", "relative_path", "size_bytes"], "symbols": ["row_id", "name", "kind", "start_line"], "call_edges": ["edge_id", "callee_name", "line"], "chunks": ["id", "kind", "start_line"],
    "doc_sections": ["id", "heading"], "doc_references": ["ref_id", "doc_section_id"], "memory_snapshots": ["row_id", "kind", "title"], "source_texts": ["source_id", "path"],
    "level_labels": ["doc_id", "rater", "level"], "mix_targets": ["plan_id", "source", "max_repeats"], "project_manifests": ["project_id", "app"], "builtin_names": ["name", "language"],
}


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, record FROM (SELECT DISTINCT to_json({{{', '.join(f'{chr(39)}{c}{chr(39)}: {c}' for c in cs)}}})::VARCHAR AS record FROM {t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cs)})"
        for t, cs in _DUMPED.items()
    )
)
def dump_json(spark, d):
    """Twelve tables as JSON records."""
    out = None
    for t, cs in _DUMPED.items():
        one = table(spark, d, t).dropna(subset=cs).select(F.lit(t).alias("table_name"), F.to_json(F.struct(*cs)).alias("record")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT DISTINCT c.id, coalesce(f.relative_path, 'unknown') AS path, coalesce(s.name, '') AS symbol_name FROM chunks c LEFT JOIN {_SQL_FILES} f ON f.id = {_cid('c.file_id')} LEFT JOIN {_SQL_SYMBOLS} s ON s.id = {_cid('c.symbol_id')}")
def lookup_join(spark, d):
    c = table(spark, d, "chunks").select("id", I.canonical_id("file_id").alias("fid"), I.canonical_id("symbol_id").alias("sid")).distinct()
    f = _files(spark, d).select(F.col("id").alias("fid"), "relative_path")
    s = _symbols(spark, d, ["name"]).select(F.col("id").alias("sid"), "name")
    out = c.join(f, "fid", "left").join(s, "sid", "left")
    return out.select("id", F.coalesce("relative_path", F.lit("unknown")).alias("path"), F.coalesce("name", F.lit("")).alias("symbol_name")).distinct()


_ENDINGS = [*(e for ends in T.LANGUAGE_ENDINGS.values() for e in ends.split() if e.isascii()), "zzz"]
_SQL_ENDED = f"(SELECT DISTINCT relative_path || '.' || list_extract({_ENDINGS}, (length(relative_path) * 7 + ascii(right(id, 1))) % {len(_ENDINGS)} + 1) AS path FROM files)"
_SQL_LANGUAGE = "CASE WHEN path LIKE '%.gradle' THEN 'gradle' " + " ".join(f"WHEN regexp_extract(path, '\\.([^.]+)$', 1) IN ({', '.join(repr(x) for x in ends.split())}) THEN '{lang}'" for lang, ends in T.LANGUAGE_ENDINGS.items()) + " ELSE 'unknown' END"


@query(f"SELECT detected, count(*) AS n_files FROM (SELECT {_SQL_LANGUAGE} AS detected FROM {_SQL_ENDED}) GROUP BY 1")
def languages(spark, d):
    """Languages by ending; the tables' files have six of them, so each path is given one of all by its length and id."""
    at = (F.length("relative_path") * 7 + F.ascii(F.right("id", F.lit(1)))) % len(_ENDINGS) + 1
    path = F.concat("relative_path", F.lit("."), F.element_at(F.array(*[F.lit(x) for x in _ENDINGS]), at.cast("int")))
    return table(spark, d, "files").select(path.alias("path")).distinct().groupBy(T.language("path").alias("detected")).agg(F.count(F.lit(1)).alias("n_files"))


@query(f"SELECT sha256(text) AS content, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return docs.groupBy(I.content_hash("text").alias("content")).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n_docs > 1")


@query(
    "SELECT row_id, name, CASE WHEN contains(lower(name), 'flush') OR contains(lower(coalesce(qualified_name, '')), 'flush') THEN 'name' ELSE 'breadcrumb' END AS found_in "
    "FROM (SELECT DISTINCT row_id, name, qualified_name, breadcrumbs FROM symbols) WHERE contains(lower(name), 'flush') OR contains(lower(coalesce(qualified_name, '')), 'flush') "
    "OR len(list_filter(coalesce(breadcrumbs, []), lambda b: contains(lower(b), 'flush'))) > 0"
)
def find_symbols(spark, d):
    s = table(spark, d, "symbols").select("row_id", "name", "qualified_name", "breadcrumbs").distinct()
    by_name = search.has("name", "flush") | search.has("qualified_name", "flush")
    crumb = F.coalesce(F.exists("breadcrumbs", lambda b: F.lower(b).contains("flush")), F.lit(False))
    return s.filter(by_name | crumb).select("row_id", "name", F.when(by_name, "name").otherwise("breadcrumb").alias("found_in"))


@query(f"SELECT id, relative_path FROM {_SQL_FILES} WHERE contains(relative_path, 'src/') ORDER BY relative_path = 'src/' DESC, relative_path, id LIMIT 1")
def find_file(spark, d):
    hit = _files(spark, d).filter(F.col("relative_path").contains("src/"))
    return hit.orderBy((F.col("relative_path") == "src/").desc(), "relative_path", "id").limit(1).select("id", "relative_path")


# ---- tokens and packing ---------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_TOKENS.format('text')} AS tokens, coalesce(strlen(text) // 4, 0)::BIGINT AS byte_tokens FROM documents")
def tok_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", K.estimate_tokens("text").alias("tokens"), K.byte_tokens("text").alias("byte_tokens"))


_SQL_FILE_TOKENS = f"(SELECT f.relative_path, sum({_TOKENS.format('c.text')})::BIGINT AS tokens FROM (SELECT DISTINCT id, {_cid('file_id')} AS fid, text FROM chunks) c JOIN {_SQL_FILES} f ON f.id = c.fid GROUP BY 1)"


def _file_tokens(spark, d):
    c = table(spark, d, "chunks").select("id", I.canonical_id("file_id").alias("fid"), F.sha2("text", 256).alias("h"), K.estimate_tokens("text").alias("tokens")).distinct()  # texts don't move
    f = _files(spark, d).select(F.col("id").alias("fid"), "relative_path")
    return c.join(f, "fid").groupBy("relative_path").agg(F.sum("tokens").alias("tokens"))


@query(
    f"SELECT folder, tokens, round(100.0 * tokens / sum(tokens) OVER (), 1)::DOUBLE AS pct, (tokens * 4 / 1024.0)::DOUBLE AS kb FROM "
    f"(SELECT CASE WHEN contains(relative_path, '/') THEN regexp_extract(relative_path, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder, sum(tokens)::BIGINT AS tokens FROM {_SQL_FILE_TOKENS} GROUP BY 1)"
)
def tokenmap(spark, d):
    return hygiene.token_map(_file_tokens(spark, d), "relative_path", "tokens")


@query(f"SELECT relative_path, tokens FROM {_SQL_FILE_TOKENS} ORDER BY tokens DESC, relative_path LIMIT 10")
def top_files_tokens(spark, d):
    return _file_tokens(spark, d).orderBy(F.desc("tokens"), "relative_path").limit(10)


def _items(spark, d):
    score = (F.coalesce("n_chars", F.lit(0)) % 97 + 1).cast("double")
    return table(spark, d, "documents").select("project_id", "doc_id", "created_at", score.alias("score"), K.estimate_tokens("text").alias("tokens"))


_SQL_ITEMS = f"(SELECT project_id, doc_id, created_at, (coalesce(n_chars, 0) % 97 + 1)::DOUBLE AS score, {_TOKENS.format('text')} AS tokens FROM documents)"


@query(
    f"""WITH RECURSIVE o AS (SELECT project_id, doc_id, tokens, row_number() OVER (PARTITION BY project_id ORDER BY -score / tokens, -score, tokens, doc_id) AS rn
      FROM {_SQL_ITEMS} WHERE tokens > 0 AND tokens <= 4000),
    walk AS (SELECT DISTINCT project_id, 0::BIGINT AS rn, 0::BIGINT AS used, NULL::BIGINT AS doc_id, 0::BIGINT AS tokens, false AS taken FROM o
      UNION ALL SELECT w.project_id, o.rn, CASE WHEN w.used + o.tokens <= 4000 THEN w.used + o.tokens ELSE w.used END, o.doc_id, o.tokens, w.used + o.tokens <= 4000
      FROM walk w JOIN o ON o.project_id = w.project_id AND o.rn = w.rn + 1)
    SELECT project_id, doc_id, tokens, row_number() OVER (PARTITION BY project_id ORDER BY rn) AS pack_rank, used FROM walk WHERE taken
    UNION ALL SELECT project_id, doc_id, tokens, 0, 0 FROM {_SQL_ITEMS} WHERE tokens = 0"""
)
def pack_greedy(spark, d):
    return packing.pack(_items(spark, d), ["project_id"], "doc_id", "score", "tokens", 4000)


@query(
    f"SELECT project_id, doc_id, tokens, used FROM (SELECT *, sum(greatest(tokens, 1)) OVER (PARTITION BY project_id ORDER BY created_at DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM {_SQL_ITEMS}) WHERE used <= 1000"
)
def pack_prefix(spark, d):
    return packing.pack_prefix(_items(spark, d), ["project_id"], [F.desc("created_at"), F.col("doc_id")], "tokens", 1000).select("project_id", "doc_id", "tokens", "used")


# ---- vectors and search ---------------------------------------------------------------------------------------------


def _with_query(spark, d, df):
    """df beside the query vector, that of vec_id 0: one row."""
    q = table(spark, d, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return df.join(F.broadcast(q.limit(1)), F.lit(True))


_COS = "list_cosine_similarity({0}::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"


@query(f"SELECT vec_id, round({_COS.format('embedding')}, 6) AS score FROM embeddings")
def vec_cosine_all(spark, d):
    return _with_query(spark, d, table(spark, d, "embeddings")).select("vec_id", F.round(V.cosine("embedding", "q"), 6).alias("score"))


@query(f"SELECT vec_id, label, round(s, 6) AS score FROM (SELECT vec_id, label, {_COS.format('embedding')} AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10")
def vec_topk(spark, d):
    top = VO.top_k(_with_query(spark, d, table(spark, d, "embeddings")), "vec_id", "embedding", F.col("q"), 10, ["label"])
    return top.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    f"SELECT label, vec_id, rank, round(s, 6) AS score FROM (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM (SELECT label, vec_id, {_COS.format('embedding')} AS s FROM embeddings)) WHERE rank <= 5 AND s >= 0.2"
)
def vec_threshold_after_topk(spark, d):
    near = VO.top_k_per_group(_with_query(spark, d, table(spark, d, "embeddings")), "label", "vec_id", "embedding", F.col("q"), 5, 0.2)
    return near.select("label", "vec_id", "rank", F.round("score", 6).alias("score"))


_SQL_SEARCH = "(SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0))"


def _found(spark, d, k):
    rows = table(spark, d, "embeddings")
    return VO.search(rows, rows.filter("vec_id % 50 = 0"), "vec_id", "embedding", k, 64)


@query(f"SELECT query_id, vec_id, rank, round(s, 6) AS score FROM {_SQL_SEARCH} WHERE rank <= 10")
def vec_search(spark, d):
    return _found(spark, d, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _sql_mmr(limit: int) -> str:
    """Diversity reranking of the fifty nearest rows, step by step."""
    cos = "list_cosine_similarity(c.embedding::DOUBLE[], e.embedding::DOUBLE[])"
    steps = [
        f"c AS (SELECT x.*, e.embedding FROM {_SQL_SEARCH} x JOIN embeddings e ON e.vec_id = x.vec_id WHERE rank <= 50)",
        "p1 AS (SELECT query_id, vec_id, s, 1 AS mmr_rank FROM c WHERE rank = 1)",
    ]
    for i in range(2, limit + 1):
        steps.append(
            f"p{i} AS (SELECT query_id, vec_id, s, mmr_rank FROM p{i - 1} UNION ALL SELECT query_id, vec_id, s, {i} FROM (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, vec_id) AS n FROM ("
            f"SELECT c.query_id, c.vec_id, c.s, c.rank, 0.65 * c.s - 0.35 * greatest(0, max({cos})) AS v FROM c JOIN p{i - 1} t ON t.query_id = c.query_id JOIN embeddings e ON e.vec_id = t.vec_id "
            f"WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} u WHERE u.query_id = c.query_id AND u.vec_id = c.vec_id) GROUP BY c.query_id, c.vec_id, c.s, c.rank)) WHERE n = 1)"
        )
    return f"WITH {', '.join(steps)} SELECT query_id, mmr_rank, vec_id, round(s, 6) AS score FROM p{limit}"


@query(_sql_mmr(5))
def vec_mmr(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = _found(spark, d, 50).join(e, "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    return VO.mmr(near, "query_id", "vec_id", "embedding", "q", 5).withColumn("score", F.round("score", 6))


@query()
def vec_search_near(spark, d):
    """The approximate search of all queries, against all rows."""
    rows = table(spark, d, "embeddings")
    return VO.search_near(rows, rows.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10, 64)


@query()
def vec_recall(spark, d):
    """What part of the exact lists the approximate search finds."""
    return VO.recall_of(vec_search_near(spark, d), _found(spark, d, 10), "vec_id")


_LED = "list_filter(o.prevs, lambda y: list_contains(w.leaders, y))[1]"
_SQL_LEADERS = f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings),
  p AS MATERIALIZED (SELECT b.n, list(a.vec_id ORDER BY a.vec_id) AS prevs FROM e a JOIN e b ON a.n < b.n AND list_cosine_similarity(a.v, b.v) >= %s GROUP BY b.n),
  o AS MATERIALIZED (SELECT e.n, e.vec_id, coalesce(p.prevs, []) AS prevs FROM e LEFT JOIN p ON p.n = e.n),
  w AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS vec_id, NULL::BIGINT AS leader, []::BIGINT[] AS leaders
        UNION ALL SELECT o.n, o.vec_id, coalesce({_LED}, o.vec_id), CASE WHEN {_LED} IS NULL THEN list_append(w.leaders, o.vec_id) ELSE w.leaders END
        FROM w JOIN o ON o.n = w.n + 1)
  SELECT vec_id, leader FROM w WHERE n > 0"""


@query(_SQL_LEADERS % 0.85)
def vec_leaders(spark, d):
    return VO.leader_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 0.85)


@query(_SQL_LEADERS % 0.3)
def vec_leaders_wide(spark, d):
    """Clusters wide enough to hold several of these vectors, which are hardly alike; in short stretches, so that rows are linked and settled too."""
    return VO.leader_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 0.3, block=200)


def _doc_vectors(spark, d):
    docs = table(spark, d, "documents").select("doc_id", search_source("source").alias("source"), T.slice_lines("text", F.lit(1), F.lit(1)).alias("outline"), "text", "created_at", "project_id")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(e, "doc_id", "left")


def search_source(c):
    return F.nullif(F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_")), F.lit(""))


_SQL_HYBRID = f"""
SELECT doc_id, round(score, 6) AS score, source FROM (
  SELECT doc_id, source, 0.7 * cos + CASE WHEN contains(lower(coalesce(source, '')), '{WORD}') THEN 0.5 ELSE 0 END
    + CASE WHEN contains(lower(coalesce({_LINES.format('text')}[1], '')), '{WORD}') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(coalesce(text, '')), '{WORD}') THEN 0.2 ELSE 0 END AS score
  FROM (SELECT d.doc_id, {_SOURCE} AS source, d.text, coalesce({_COS.format('e.embedding')}, 0.0) AS cos FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id ORDER BY cos DESC, doc_id LIMIT {{k}})
) WHERE score > 0.05 ORDER BY score DESC, doc_id LIMIT 10"""


@query(_SQL_HYBRID.format(k=10))
def hybrid_search(spark, d):
    return search.hybrid(_with_query(spark, d, _doc_vectors(spark, d)), "doc_id", "embedding", F.col("q"), WORD, 10, "source", "outline", "text").select("doc_id", F.round("score", 6).alias("score"), "source")


@query(_SQL_HYBRID.format(k=1_000_000_000))
def hybrid_search_full(spark, d):
    return search.hybrid(_with_query(spark, d, _doc_vectors(spark, d)), "doc_id", "embedding", F.col("q"), WORD, 10, "source", "outline", "text", None).select("doc_id", F.round("score", 6).alias("score"), "source")


@query(
    """SELECT row_id, name, qualified_name, confidence, macro_parent, body FROM (SELECT row_id, name, coalesce(qualified_name, '') AS qualified_name,
      CASE WHEN lower(name) = 'flush' THEN 1.0 WHEN contains(lower(name), 'flush') THEN 0.8 WHEN contains(lower(qualified_name), 'flush') THEN 0.7 WHEN contains(lower(summary), 'flush') THEN 0.5
           WHEN len(list_filter(breadcrumbs, lambda b: contains(lower(b), 'flush'))) > 0 THEN 0.4 END::DOUBLE AS confidence, coalesce(breadcrumbs[1], '') AS macro_parent, coalesce(summary, '') AS body
    FROM (SELECT DISTINCT row_id, name, qualified_name, summary, breadcrumbs FROM symbols)) WHERE confidence IS NOT NULL ORDER BY confidence DESC, row_id LIMIT 50"""
)
def stair_search(spark, d):
    s = table(spark, d, "symbols").select("row_id", "name", "qualified_name", "summary", "breadcrumbs").distinct()
    return search.hierarchical(s, "row_id", "flush", 50)


def _streams(spark, d):
    e = _with_query(spark, d, table(spark, d, "embeddings")).select("vec_id", "label", V.cosine("embedding", "q").alias("s"))
    docs = table(spark, d, "documents").select("doc_id", "text", "created_at", "n_chars")
    zero = table(spark, d, "embeddings").filter("vec_id = 0").select("label").limit(1)
    return [
        search.ranked(e, "vector", "vec_id", [F.desc("s"), F.col("vec_id")], 50),
        search.ranked(docs.filter(search.has("text", WORD)), "lexical", "doc_id", [F.col("n_chars"), F.col("doc_id")], 50),
        search.ranked(e.join(F.broadcast(zero), "label"), "graph", "vec_id", [F.col("vec_id")], 50),
        search.ranked(docs, "temporal", "doc_id", [F.desc("created_at"), F.col("doc_id")], 50),
    ]


_SQL_STREAMS = f"""(
  SELECT 'vector' AS stream, key, row_number() OVER (ORDER BY s DESC, key) AS rank FROM (SELECT vec_id AS key, {_COS.format('embedding')} AS s FROM embeddings ORDER BY s DESC, key LIMIT 50)
  UNION ALL SELECT 'lexical', doc_id, row_number() OVER (ORDER BY n_chars, doc_id) FROM (SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), '{WORD}') ORDER BY n_chars, doc_id LIMIT 50)
  UNION ALL SELECT 'graph', vec_id, row_number() OVER (ORDER BY vec_id) FROM (SELECT vec_id FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY vec_id LIMIT 50)
  UNION ALL SELECT 'temporal', doc_id, row_number() OVER (ORDER BY created_at DESC, doc_id) FROM (SELECT doc_id, created_at FROM documents ORDER BY created_at DESC, doc_id LIMIT 50))"""
_SQL_FUSED = f"""(SELECT key, coalesce(0.35 / (60 + v), 0) + coalesce(0.35 / (60 + l), 0) + coalesce(0.20 / (60 + g), 0) + coalesce(0.10 / (60 + t), 0) AS score, v, l, g, t FROM (
  SELECT key, max(CASE WHEN stream = 'vector' THEN rank END) AS v, max(CASE WHEN stream = 'lexical' THEN rank END) AS l, max(CASE WHEN stream = 'graph' THEN rank END) AS g,
         max(CASE WHEN stream = 'temporal' THEN rank END) AS t FROM {_SQL_STREAMS} GROUP BY key))"""


@query(f"SELECT key, round(score, 9) AS score, v AS vector_rank, l AS lexical_rank, g AS graph_rank, t AS temporal_rank FROM {_SQL_FUSED}")
def rrf_fuse(spark, d):
    return search.fuse(_streams(spark, d)).select("key", F.round("score", 9).alias("score"), *[f"{s}_rank" for s in search.RRF_WEIGHTS])


def sql_pack(items: str, budget: int) -> str:
    """Greedy packing of ``key, score, tokens``: ``key, pack_rank, used``."""
    return f"""(WITH RECURSIVE o AS (SELECT key, tokens, row_number() OVER (ORDER BY -score / tokens, -score, tokens, key) AS rn FROM {items} WHERE tokens > 0 AND tokens <= {budget}),
      walk AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS used, NULL::VARCHAR AS key, false AS taken
        UNION ALL SELECT o.rn, CASE WHEN w.used + o.tokens <= {budget} THEN w.used + o.tokens ELSE w.used END, o.key::VARCHAR, w.used + o.tokens <= {budget} FROM walk w JOIN o ON o.rn = w.rn + 1)
      SELECT key, row_number() OVER (ORDER BY rn) AS pack_rank, used FROM walk WHERE taken UNION ALL SELECT key::VARCHAR, 0, 0 FROM {items} WHERE tokens = 0)"""


_SQL_CANDIDATES = f"""(SELECT f.key, round(f.score, 9) AS score, coalesce({_SOURCE}, '') AS title, coalesce(d.text, '') AS text, {_TOKENS.format('d.text')} AS tokens FROM {_SQL_FUSED} f JOIN documents d ON d.doc_id = f.key)"""


@query(
    f"""WITH c AS {_SQL_CANDIDATES}, p AS {sql_pack('c', 2000)} SELECT '{WORD}' AS task, string_agg('### ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY pack_rank, c.key) AS context,
      max(used)::BIGINT AS used, count(*) AS n_included FROM p JOIN c ON c.key::VARCHAR = p.key"""
)
def context_pack(spark, d):
    """Four ranked streams fused, joined with their documents and packed into a token budget."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", F.coalesce(search_source("source"), F.lit("")).alias("title"), K.estimate_tokens("text").alias("tokens"))
    return synthesis.packed_context(search.fuse(_streams(spark, d)).select("key", F.round("score", 9).alias("score")).join(docs, "key").withColumn("task", F.lit(WORD)), "key", "score", "tokens", "title", "text", 2000, ["task"])


# The same for every query: all rows with vec_id % 50 = 0, each with a word, the first of four letters in its own document.
_SQL_QUERIES = (
    "(SELECT e.vec_id AS query_id, e.embedding AS q, e.label, coalesce(nullif(regexp_extract(lower(d.text), '[a-z][a-z][a-z][a-z]+'), ''), '" + WORD + "') AS word "
    "FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 50 = 0)"
)
_SQL_COS_ALL = "coalesce(list_cosine_similarity(e.embedding::DOUBLE[], q.q::DOUBLE[]), 0.0)"


def _queries(spark, d):
    e = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    word = F.coalesce(F.nullif(F.regexp_extract(F.lower("text"), "[a-z][a-z][a-z][a-z]+", 0), F.lit("")), F.lit(WORD))
    return e.join(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text"), "query_id", "left").select("query_id", "embedding", "label", word.alias("word"))


@query(
    f"SELECT query_id, label, vec_id, rank, round(s, 6) AS score FROM (SELECT query_id, e.label, e.vec_id, {_SQL_COS_ALL} AS s, row_number() OVER (PARTITION BY query_id, e.label ORDER BY {_SQL_COS_ALL} DESC, e.vec_id) AS rank FROM {_SQL_QUERIES} q, embeddings e) WHERE rank <= 5 AND s >= 0.2"
)
def vec_threshold_all(spark, d):
    rows = table(spark, d, "embeddings")
    near = VO.search(rows, rows.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5, 64, "label").filter("score >= 0.2")
    return near.select("query_id", "label", "vec_id", "rank", F.round("score", 6).alias("score"))


_SQL_HYBRID_ALL = f"""
SELECT query_id, rank, doc_id, round(score, 6) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, source, 0.7 * cos + CASE WHEN contains(lower(coalesce(source, '')), word) THEN 0.5 ELSE 0 END
    + CASE WHEN contains(lower(coalesce({_LINES.format('text')}[1], '')), word) THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(coalesce(text, '')), word) THEN 0.2 ELSE 0 END AS score
  FROM (SELECT query_id, word, d.doc_id, {_SOURCE} AS source, d.text, {_SQL_COS_ALL} AS cos, row_number() OVER (PARTITION BY query_id ORDER BY {_SQL_COS_ALL} DESC, d.doc_id) AS n
    FROM {_SQL_QUERIES} q CROSS JOIN documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id) WHERE n <= {{k}}) WHERE score > 0.05) WHERE rank <= 10"""


def _hybrid_all(spark, d, candidates):
    found = search.hybrid_many(_doc_vectors(spark, d), _queries(spark, d), "doc_id", "embedding", 10, "source", "outline", "text", 64, candidates)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "source")


@query(_SQL_HYBRID_ALL.format(k=10))
def hybrid_search_all(spark, d):
    return _hybrid_all(spark, d, 10)


@query(_SQL_HYBRID_ALL.format(k=1_000_000_000))
def hybrid_search_full_all(spark, d):
    return _hybrid_all(spark, d, None)


def _streams_all(spark, d):
    q, e = _queries(spark, d), table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    docs = table(spark, d, "documents").select("doc_id", "text", "created_at", "n_chars")
    words = q.select("query_id", "word")
    lexical = textual.mentions(docs, "doc_id", ["text"], words.select("word").distinct(), "word").join(docs.select("doc_id", "n_chars"), "doc_id")
    lexical = search.ranked(lexical, "lexical", "doc_id", [F.col("n_chars"), F.col("doc_id")], 50, ["word"]).join(words, "word").drop("word")
    same = search.ranked(e, "graph", "vec_id", [F.col("vec_id")], 50, ["label"]).join(q.select("query_id", "label"), "label").drop("label")
    newest = search.ranked(docs, "temporal", "doc_id", [F.desc("created_at"), F.col("doc_id")], 50)
    near = search.nearest(e, q, "vec_id", "embedding", 50, 64).select("query_id", F.lit("vector").alias("stream"), F.col("vec_id").alias("key"), "rank")
    return [near, lexical, same, q.select("query_id").join(F.broadcast(newest), F.lit(True))]  # 50 rows


_SQL_STREAMS_ALL = f"""(
  SELECT query_id, 'vector' AS stream, e.vec_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY {_SQL_COS_ALL} DESC, e.vec_id) AS rank FROM {_SQL_QUERIES} q, embeddings e
  UNION ALL SELECT query_id, 'lexical', doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars NULLS FIRST, doc_id) FROM {_SQL_QUERIES} q JOIN documents d ON contains(lower(d.text), q.word)
  UNION ALL SELECT query_id, 'graph', e.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY e.vec_id) FROM {_SQL_QUERIES} q JOIN embeddings e ON e.label = q.label
  UNION ALL SELECT query_id, 'temporal', doc_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC NULLS LAST, doc_id) FROM {_SQL_QUERIES} q, documents)"""


@query(
    f"""SELECT query_id, key, round(coalesce(0.35 / (60 + v), 0) + coalesce(0.35 / (60 + l), 0) + coalesce(0.20 / (60 + g), 0) + coalesce(0.10 / (60 + t), 0), 9) AS score, v AS vector_rank, l AS lexical_rank, g AS graph_rank, t AS temporal_rank FROM (
  SELECT query_id, key, max(CASE WHEN stream = 'vector' THEN rank END) AS v, max(CASE WHEN stream = 'lexical' THEN rank END) AS l, max(CASE WHEN stream = 'graph' THEN rank END) AS g,
         max(CASE WHEN stream = 'temporal' THEN rank END) AS t FROM {_SQL_STREAMS_ALL} WHERE rank <= 50 GROUP BY query_id, key)"""
)
def rrf_fuse_all(spark, d):
    return search.fuse(_streams_all(spark, d), by=["query_id"]).select("query_id", "key", F.round("score", 9).alias("score"), *[f"{s}_rank" for s in search.RRF_WEIGHTS])


@query()
def context_pack_all(spark, d):
    """A packed context for every query."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", F.coalesce(search_source("source"), F.lit("")).alias("title"), K.estimate_tokens("text").alias("tokens"))
    fused = search.fuse(_streams_all(spark, d), by=["query_id"]).select("query_id", "key", F.round("score", 9).alias("score"))
    packed = fused.join(docs, "key").join(_queries(spark, d).select("query_id", F.col("word").alias("task")), "query_id")
    return synthesis.packed_context(packed, "key", "score", "tokens", "title", "text", 2000, ["query_id", "task"])


@query(
    f"SELECT doc_id, round(list_sum(e), 4) AS total, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS e0, round(e[32] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS e31 FROM "
    "(SELECT doc_id, list_transform(range(0, 32), lambda i: ('0x' || substr(sha256(text), (2 * i + 1)::BIGINT, 2))::INT / 255.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE) AS e FROM documents WHERE text IS NOT NULL)"
)
def hash_embedding(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    sha = F.sha2("text", 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(sha, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0)
    e = docs.select("doc_id", V.hash_embedding("text", 32).alias("e"), F.aggregate(raw, F.lit(0.0), lambda s, v: s + v).alias("total"))
    return e.select("doc_id", F.round("total", 4).alias("total"), F.round(F.col("e")[0], 6).alias("e0"), F.round(F.col("e")[31], 6).alias("e31"))


# ---- graph ----------------------------------------------------------------------------------------------------------


def _edges(spark, d):
    return graph.name_edges(table(spark, d, "call_edges"), table(spark, d, "symbols"))


def _roots(spark):
    return spark.range(1).select(F.lit(ROOT).alias("root"))


def _sql_walk(near: str, far: str, hops: int) -> str:
    return (
        f"(WITH RECURSIVE e AS {_SQL_NAME_EDGES}, w AS (SELECT '{ROOT}' AS node, 0 AS hop UNION SELECT e.{far}, w.hop + 1 FROM w JOIN e ON e.{near} = w.node WHERE w.hop < {hops}) "
        f"SELECT '{ROOT}' AS root, node, min(hop) AS hop FROM w WHERE hop > 0 GROUP BY node)"
    )


@query(f"SELECT *, 'callees' AS direction FROM {_sql_walk('src', 'dst', 3)}")
def graph_callees(spark, d):
    return graph.neighbourhood(_edges(spark, d), _roots(spark), 3, "callees")


@query(f"SELECT *, 'callers' AS direction FROM {_sql_walk('dst', 'src', 3)}")
def graph_callers(spark, d):
    return graph.neighbourhood(_edges(spark, d), _roots(spark), 3, "callers")


@query(f"SELECT *, 'callees' AS direction FROM {_sql_walk('src', 'dst', 2)} UNION ALL SELECT *, 'callers' AS direction FROM {_sql_walk('dst', 'src', 2)}")
def graph_impact(spark, d):
    return graph.impact(_edges(spark, d), _roots(spark))


_SQL_DOCREFS = f"(SELECT DISTINCT '{ROOT}' AS root, r.doc_section_id, coalesce(r.context, '') AS context FROM doc_references r JOIN symbols s ON {_cid('s.id')} = {_cid('r.symbol_id')} WHERE s.name = '{ROOT}')"


@query(f"SELECT * FROM {_SQL_DOCREFS}")
def graph_docs(spark, d):
    return graph.doc_references(table(spark, d, "doc_references"), table(spark, d, "symbols"), _roots(spark))


@query(
    f"""SELECT '{ROOT}' AS root, '[Target] {ROOT} (' || t.kind || ') in ' || t.path || coalesce(chr(10) || '[Signature] ' || t.signature, '')
      || coalesce(chr(10) || '[Callers] ' || (SELECT string_agg(node, ', ' ORDER BY node) FROM {_sql_walk('dst', 'src', 1)}), '')
      || coalesce(chr(10) || '[Callees] ' || (SELECT string_agg(node, ', ' ORDER BY node) FROM {_sql_walk('src', 'dst', 1)}), '')
      || coalesce(chr(10) || '[Documentation] ' || (SELECT string_agg(DISTINCT doc_section_id, ' | ' ORDER BY doc_section_id) FROM {_SQL_DOCREFS}), '') AS text
      FROM (SELECT s.kind, coalesce(f.relative_path, 'unknown') AS path, s.signature FROM symbols s LEFT JOIN {_SQL_FILES} f ON f.id = {_cid('s.file_id')} WHERE s.name = '{ROOT}' ORDER BY {_cid('s.id')}, s.indexed_at, s.row_id LIMIT 1) t"""
)
def graph_explain(spark, d):
    about = graph.targets(table(spark, d, "symbols"), _files(spark, d), _roots(spark))
    return graph.render(about, graph.impact(_edges(spark, d), _roots(spark), 1), graph_docs(spark, d))


# The same for many roots: the names of all symbols with row_id % 50 = 0, and for callees those of all symbols.
_SQL_ROOTS = "(SELECT DISTINCT name AS root FROM symbols WHERE row_id % 50 = 0 AND name IS NOT NULL)"
_SQL_ALL_ROOTS = "(SELECT DISTINCT name AS root FROM symbols WHERE name IS NOT NULL)"


def _all_roots(spark, d):
    return table(spark, d, "symbols").filter("name IS NOT NULL").select(F.col("name").alias("root")).distinct()


def _many_roots(spark, d):
    return table(spark, d, "symbols").filter("row_id % 50 = 0 AND name IS NOT NULL").select(F.col("name").alias("root")).distinct()


def _sql_walk_all(near: str, far: str, hops: int, roots: str = _SQL_ROOTS) -> str:
    return (
        f"(WITH RECURSIVE e AS {_SQL_NAME_EDGES}, w AS (SELECT root, root AS node, 0 AS hop FROM {roots} UNION SELECT w.root, e.{far}, w.hop + 1 FROM w JOIN e ON e.{near} = w.node WHERE w.hop < {hops}) "
        "SELECT root, node, min(hop) AS hop FROM w WHERE hop > 0 GROUP BY root, node)"
    )


@query(f"SELECT *, 'callees' AS direction FROM {_sql_walk_all('src', 'dst', 3, _SQL_ALL_ROOTS)}")
def graph_callees_all(spark, d):
    return graph.neighbourhoods(_edges(spark, d), _all_roots(spark, d), 3, "callees")


@query(f"SELECT *, 'callers' AS direction FROM {_sql_walk_all('dst', 'src', 3)}")
def graph_callers_all(spark, d):
    return graph.neighbourhoods(_edges(spark, d), _many_roots(spark, d), 3, "callers")


@query(f"SELECT *, 'callees' AS direction FROM {_sql_walk_all('src', 'dst', 2)} UNION ALL SELECT *, 'callers' AS direction FROM {_sql_walk_all('dst', 'src', 2)}")
def graph_impact_all(spark, d):
    return graph.impact(_edges(spark, d), _many_roots(spark, d))


_SQL_DOCREFS_ALL = f"(SELECT DISTINCT s.name AS root, r.doc_section_id, coalesce(r.context, '') AS context FROM doc_references r JOIN symbols s ON {_cid('s.id')} = {_cid('r.symbol_id')} WHERE s.name IN (SELECT root FROM {_SQL_ROOTS}))"


@query(f"SELECT * FROM {_SQL_DOCREFS_ALL}")
def graph_docs_all(spark, d):
    return graph.doc_references(table(spark, d, "doc_references"), table(spark, d, "symbols"), _many_roots(spark, d))


@query(
    f"""SELECT t.root, '[Target] ' || t.root || ' (' || t.kind || ') in ' || t.path || coalesce(chr(10) || '[Signature] ' || t.signature, '') || coalesce(chr(10) || '[Callers] ' || i.x, '')
      || coalesce(chr(10) || '[Callees] ' || o.x, '') || coalesce(chr(10) || '[Documentation] ' || r.x, '') AS text
      FROM (SELECT s.name AS root, s.kind, coalesce(f.relative_path, 'unknown') AS path, s.signature, row_number() OVER (PARTITION BY s.name ORDER BY {_cid('s.id')}, s.indexed_at, s.row_id) AS n
        FROM symbols s LEFT JOIN {_SQL_FILES} f ON f.id = {_cid('s.file_id')} WHERE s.name IN (SELECT root FROM {_SQL_ROOTS})) t
      LEFT JOIN (SELECT root, string_agg(node, ', ' ORDER BY node) AS x FROM {_sql_walk_all('dst', 'src', 1)} GROUP BY 1) i ON i.root = t.root
      LEFT JOIN (SELECT root, string_agg(node, ', ' ORDER BY node) AS x FROM {_sql_walk_all('src', 'dst', 1)} GROUP BY 1) o ON o.root = t.root
      LEFT JOIN (SELECT root, string_agg(DISTINCT doc_section_id, ' | ' ORDER BY doc_section_id) AS x FROM {_SQL_DOCREFS_ALL} GROUP BY 1) r ON r.root = t.root WHERE t.n = 1"""
)
def graph_explain_all(spark, d):
    about = graph.targets(table(spark, d, "symbols"), _files(spark, d), _many_roots(spark, d))
    return graph.render(about, graph.impact(_edges(spark, d), _many_roots(spark, d), 1), graph_docs_all(spark, d))


@query(
    f"""SELECT a.caller_id, a.callee_name, coalesce(s.name, a.caller_id) AS caller_name, a.line, a.n_calls FROM (
      SELECT caller_id, callee_name, arg_max(line, (valid_from, line, edge_id)) AS line, count(DISTINCT edge_id) AS n_calls FROM (
        SELECT {_cid('caller_symbol_id')} AS caller_id, {_SQL_CALLEE} AS callee_name, line, valid_from, edge_id FROM call_edges) WHERE caller_id IS NOT NULL AND callee_name IS NOT NULL GROUP BY 1, 2) a
    LEFT JOIN {_SQL_SYMBOLS} s ON s.id = a.caller_id"""
)
def enrich_calls(spark, d):
    names = _symbols(spark, d, ["name"]).select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"))
    return delta.enrich_calls(table(spark, d, "call_edges"), names, I.canonical_id("caller_symbol_id"), I.bare_callee("callee_name"))


@query(
    f"""SELECT edge_id, arg_min(symbol_id, (start_line, -end_line, symbol_id)) AS symbol_id FROM (SELECT DISTINCT edge_id, line, {_cid('caller_symbol_id')} AS sid FROM call_edges) c
      JOIN (SELECT id AS sid, {_cid('file_id')} AS fid FROM {_SQL_SYMBOLS}) o ON o.sid = c.sid
      JOIN (SELECT id AS symbol_id, {_cid('file_id')} AS fid, start_line, end_line FROM {_SQL_SYMBOLS} WHERE kind IN ('function', 'method')) s ON s.fid = o.fid AND c.line BETWEEN s.start_line AND s.end_line GROUP BY 1"""
)
def interval_enclosing(spark, d):
    s = _symbols(spark, d, ["file_id", "kind", "start_line", "end_line"]).withColumn("file_id", I.canonical_id("file_id"))
    calls = table(spark, d, "call_edges").select("edge_id", "line", I.canonical_id("caller_symbol_id").alias("id")).distinct().join(s.select("id", "file_id"), "id")
    spans = s.filter(F.col("kind").isin("function", "method")).select("file_id", F.col("id").alias("symbol_id"), "start_line", "end_line")
    return textual.enclosing(calls.select("edge_id", "line", "file_id"), spans, ["file_id"], "edge_id", "line")


# ---- memories and edges over time -----------------------------------------------------------------------------------


@query(
    f"SELECT id, kind, title, created_at, valid_until FROM {_SQL_MEMORY} WHERE created_at <= TIMESTAMP '{AS_OF}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{AS_OF}') AND list_has_any(tags, {TAGS}) ORDER BY created_at DESC NULLS LAST, id LIMIT 50"
)
def asof_recall(spark, d):
    return search.recall(_memories(spark, d), "id", 50, tags=TAGS, as_of=_ntz(AS_OF)).select("id", "kind", "title", "created_at", "valid_until")


@query(f"SELECT id, title, created_at FROM {_SQL_MEMORY} WHERE status = 'active' AND kind = 'error' ORDER BY created_at DESC NULLS LAST, id LIMIT 20")
def active_recall(spark, d):
    return search.recall(_memories(spark, d), "id", 20, kind="error").select("id", "title", "created_at")


_SQL_RULES = f"(SELECT * FROM {_SQL_MEMORY} WHERE status = 'active' AND kind IN ('instruction', 'decision', 'preference', 'fact') ORDER BY created_at DESC NULLS LAST, id LIMIT 50)"


@query(f"SELECT id, kind, title FROM {_SQL_RULES}")
def active_rules(spark, d):
    return search.active_rules(_memories(spark, d), "id").select("id", "kind", "title")


_OPPOSED_SQL = " OR ".join(
    f"(contains(lower(a.content), '{p}') AND contains(lower(b.content), '{q}')) OR (contains(lower(a.content), '{q}') AND contains(lower(b.content), '{p}'))" for p, q in T.OPPOSED
)
_WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: strlen(w) > 3 AND w NOT IN ('never', 'always', 'prefer', 'avoid')))"


_SQL_SAYINGS = f"(SELECT * REPLACE (CASE WHEN ascii(right(id, 1)) % 2 = 0 THEN 'Always use: ' ELSE 'Never use: ' END || coalesce(content, '') AS content) FROM {_SQL_RULES})"


@query(
    f"WITH r AS (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS n FROM {_SQL_SAYINGS}) SELECT a.id AS first, b.id AS second, a.kind AS kind FROM r a JOIN r b ON a.kind = b.kind AND a.n < b.n "
    f"WHERE ({_OPPOSED_SQL}) AND len(list_intersect({_WORDS_SQL.format('a.content')}, {_WORDS_SQL.format('b.content')})) >= 2"
)
def conflict_pairs(spark, d):
    """Conflicts among the newest rules. The tables' rules take no sides, so every rule is made to say always or never by its id."""
    says = F.when(F.ascii(F.right("id", F.lit(1))) % 2 == 0, "Always use: ").otherwise("Never use: ")
    rules = search.active_rules(_memories(spark, d), "id").withColumn("content", F.concat(says, F.coalesce("content", F.lit(""))))
    return memory.conflicts(rules, "id", "kind", "content", [F.desc_nulls_last("created_at"), F.col("id")])


@query(
    "SELECT event_id, lead(ts) OVER w AS valid_until, lead(event_id) OVER w AS superseded_by, CASE WHEN lead(event_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts NULLS FIRST, event_id)"
)
def supersede_versions(spark, d):
    return memory.supersede(table(spark, d, "events"), ["user_id", "event_type"], "event_id", "ts").select("event_id", "valid_until", "superseded_by", "status")


@query("SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return delta.latest(e, ["user_id", "event_type"], ["ts", "event_id"])


_AGED = f"(SELECT DISTINCT edge_id, {_cid('caller_symbol_id')} AS caller, {_SQL_CALLEE} AS callee, weight, greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(last_traversed_at, valid_from))) / 86400000000.0::DOUBLE, 0) AS days FROM call_edges)"


def _aged(spark, d):
    days = memory.days_between(F.coalesce("last_traversed_at", "valid_from"), F.lit(NOW))
    return table(spark, d, "call_edges").select("edge_id", I.canonical_id("caller_symbol_id").alias("caller"), I.bare_callee("callee_name").alias("callee"), "weight", days.alias("days")).distinct()


@query(f"SELECT edge_id, round(least(greatest(weight * exp(-days / 30.0::DOUBLE), 0), 1), 6) AS exponential, round(weight * pow(0.5::DOUBLE, days / 30.0::DOUBLE), 6) AS half_life FROM {_AGED}")
def decay_edges(spark, d):
    e, h = memory.decay_exponential(F.col("weight"), F.col("days")), memory.decay_half_life(F.col("weight"), F.col("days"))
    return _aged(spark, d).select("edge_id", F.round(e, 6).alias("exponential"), F.round(h, 6).alias("half_life"))


@query(f"SELECT edge_id FROM {_AGED} WHERE weight * pow(0.5::DOUBLE, days / 180.0::DOUBLE) >= 0.15")
def prune_edges(spark, d):
    return memory.prune(_aged(spark, d).withColumn("w", memory.decay_half_life(F.col("weight"), F.col("days"), 180.0)), "w").select("edge_id")


@query(
    f"SELECT id, name FROM {_SQL_SYMBOLS} s WHERE NOT EXISTS (SELECT 1 FROM {_AGED} e WHERE e.callee = s.name AND weight * pow(0.5::DOUBLE, days / 180.0::DOUBLE) >= 0.15)"
)
def orphan_symbols(spark, d):
    kept = memory.prune(_aged(spark, d).withColumn("w", memory.decay_half_life(F.col("weight"), F.col("days"), 180.0)), "w")
    return _symbols(spark, d, ["name"]).join(kept.select(F.col("callee").alias("name")).filter("name IS NOT NULL").distinct(), "name", "left_anti").select("id", "name")


@query(
    f"""SELECT 'rule_' || regexp_replace(lower(component), '[ /-]', '_', 'g') AS rule_id, component, count(*) AS n_incidents, string_agg(title, ' | ' ORDER BY n) AS condition_pattern, least(1.0, 0.5 + 0.1 * count(*))::DOUBLE AS confidence,
      string_agg(id, ',' ORDER BY n) AS incident_ids, string_agg(k::VARCHAR || '. ' || content, chr(10) ORDER BY n) AS prescribed_solution FROM (
      SELECT *, row_number() OVER (PARTITION BY component ORDER BY n) AS k FROM (
        SELECT id, coalesce(title, '') AS title, coalesce(content, '') AS content, coalesce(tags[1], 'core') AS component, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS n FROM (
          SELECT * FROM {_SQL_MEMORY} WHERE status = 'active' AND kind = 'error' ORDER BY created_at DESC NULLS LAST, id LIMIT 100))) GROUP BY component"""
)
def consolidate_rules(spark, d):
    newest = search.recall(_memories(spark, d), "id", 100, kind="error")
    return memory.consolidate(newest, F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("core")), "id", "title", "content", [F.desc_nulls_last("created_at"), F.col("id")])


@query(
    f"""SELECT s.project_id, bool_or(c.relative_path IS NULL OR c.content_hash IS DISTINCT FROM s.content_hash) AS is_stale, count(*) FILTER (c.relative_path IS NOT NULL AND c.content_hash IS DISTINCT FROM s.content_hash) AS n_changed,
      count(*) FILTER (c.relative_path IS NULL) AS n_missing FROM {_SQL_FIRST_FILES} s LEFT JOIN (SELECT * FROM {_SQL_FILES} WHERE deleted_at IS NULL) c ON c.id = s.id GROUP BY 1"""
)
def stale_models(spark, d):
    now = _files(spark, d).filter("deleted_at IS NULL")
    return memory.stale(_first_files(spark, d), "project_id", "id", "content_hash", now.select("id", "content_hash"), "id", "content_hash")


@query(
    f"""SELECT id, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN ac = bc THEN 'unchanged' ELSE 'updated' END AS change FROM (
      SELECT coalesce(s.id, c.id) AS id, s.id AS a, c.id AS b, s.content_hash AS ac, c.content_hash AS bc FROM {_SQL_FIRST_FILES} s FULL OUTER JOIN (SELECT * FROM {_SQL_FILES} WHERE deleted_at IS NULL) c ON c.id = s.id)"""
)
def delta_classify(spark, d):
    return delta.classify(_first_files(spark, d), _files(spark, d).filter("deleted_at IS NULL"), "id", "content_hash")


@query(
    f"SELECT c.id, c.content_hash FROM {_SQL_FILES} c WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM {_SQL_FIRST_FILES} s WHERE s.id = c.id AND s.content_hash = c.content_hash)"
)
def delta_unknown(spark, d):
    return delta.unknown(_files(spark, d).filter("deleted_at IS NULL").select("id", "content_hash"), _first_files(spark, d), "id", "content_hash")


@query(f"SELECT DISTINCT c.id FROM chunks c WHERE {_cid('c.file_id')} IS NULL OR {_cid('c.file_id')} NOT IN (SELECT id FROM {_SQL_FILES} WHERE deleted_at IS NOT NULL)")
def cascade_delete(spark, d):
    gone = _files(spark, d).filter("deleted_at IS NOT NULL")
    return delta.without(table(spark, d, "chunks").select("id", "file_id"), I.canonical_id("file_id"), gone, "id").select("id").distinct()


@query(
    f"""WITH w AS (SELECT DISTINCT edge_id, {_SQL_CALLEE} AS n FROM call_edges), s AS (SELECT id, name, qualified_name FROM {_SQL_SYMBOLS})
      SELECT edge_id, min(id) AS symbol_id FROM (SELECT edge_id, id FROM w JOIN s ON s.name = n UNION ALL SELECT edge_id, id FROM w JOIN s ON s.qualified_name = n) GROUP BY 1"""
)
def govern_links(spark, d):
    """The first symbol that a call's name or qualified name means."""
    s = _symbols(spark, d, ["name", "qualified_name"]).withColumnRenamed("id", "symbol_id")
    names = table(spark, d, "call_edges").select("edge_id", I.bare_callee("callee_name").alias("callee"))
    return delta.link_by_name(names, "edge_id", "callee", s)


@query(
    "SELECT doc_id AS source_hash, kind, title, says || ' ' || doc_id::VARCHAR || ': ' || t AS content, 'git:import' AS author FROM (SELECT doc_id, t, "
    "CASE regexp_extract(f, '^(feat|fix|refactor|perf|docs)(\\([^)]*\\))?:\\s*(.*)$', 1) WHEN 'feat' THEN 'Commit' WHEN 'fix' THEN 'Resolved issue in commit' WHEN 'refactor' THEN 'Refactoring in commit' WHEN 'perf' THEN 'Performance optimization in' WHEN 'docs' THEN 'Documentation update in' END AS says, "
    "regexp_replace(regexp_extract(f, '^(feat|fix|refactor|perf|docs)(\\([^)]*\\))?:\\s*(.*)$', 3), '^[\\s\\x0B\\p{Z}]+|[\\s\\x0B\\p{Z}]+$', '', 'g') AS title, "
    "CASE regexp_extract(f, '^(feat|fix|refactor|perf|docs)(\\([^)]*\\))?:\\s*(.*)$', 1) WHEN 'feat' THEN 'decision' WHEN 'fix' THEN 'error' WHEN 'refactor' THEN 'decision' WHEN 'perf' THEN 'learning' WHEN 'docs' THEN 'fact' END AS kind "
    "FROM (SELECT doc_id, t, regexp_extract(t, '^([^\\r\\n]*)', 1) AS f FROM (SELECT doc_id, regexp_replace(text, '^[\\s\\x0B\\p{Z}]+|[\\s\\x0B\\p{Z}]+$', '', 'g') AS t FROM documents WHERE doc_format = 'commit' AND text IS NOT NULL))) WHERE kind IS NOT NULL"
)
def commit_distill(spark, d):
    commits = table(spark, d, "documents").filter("doc_format = 'commit'")
    return memory.distill(commits, "doc_id", "text", F.lit("import")).drop("tags")


@query(f"SELECT id, kind, title FROM {_SQL_MEMORY} m WHERE source_hash IS NULL OR source_hash NOT IN (SELECT source_hash FROM {_SQL_MEMORY} WHERE source_hash IS NOT NULL AND status = 'superseded')")
def not_yet_stored(spark, d):
    m = _memories(spark, d)
    return memory.not_stored(m, m.filter("status = 'superseded'"), "source_hash").select("id", "kind", "title")


@query(
    f"""SELECT id, '## ' || coalesce(title, '') || chr(10) || '- **ID**: `' || id || '`' || chr(10) || '- **Status**: `' || status || '`' || coalesce(chr(10) || '- **Created**: `' || strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') || '`', '')
      || coalesce(chr(10) || '- **Tags**: ' || nullif(array_to_string(list_transform(tags, lambda t: '#' || t), ' '), ''), '') || coalesce(chr(10) || '- **Governs Symbol**: `' || nullif(symbol_ref, '') || '`', '') || coalesce(chr(10) || '- **Author**: `' || nullif(author, '') || '`', '')
      || chr(10) || chr(10) || coalesce(content, '') || chr(10) || chr(10) || '---' || chr(10) AS block FROM {_SQL_MEMORY}"""
)
def memory_blocks(spark, d):
    return _memories(spark, d).select("id", synthesis.memory_block().alias("block"))


# ---- hygiene --------------------------------------------------------------------------------------------------------


@query(
    f"""SELECT input_tokens, output_tokens, cached_tokens, round(input_tokens * 5e-7 + output_tokens * 1.5e-6, 9) AS cost FROM (
      SELECT sum({_TOKENS.format('text')})::BIGINT AS input_tokens, sum({_TOKENS.format('outline')})::BIGINT AS output_tokens, sum(strlen(text) // 4)::BIGINT AS cached_tokens FROM (SELECT DISTINCT id, text, outline FROM chunks))"""
)
def ledger_totals(spark, d):
    usage = _chunks(spark, d, "text", "outline").select(K.estimate_tokens("text").alias("input_tokens"), K.estimate_tokens("outline").alias("output_tokens"), K.byte_tokens("text").alias("cached_tokens"))
    return hygiene.ledger_totals(usage).withColumn("cost", F.round("cost", 9))


@query(
    "SELECT category, sum(saved)::BIGINT AS saved_bytes, sum(saved // 4)::BIGINT AS saved_tokens FROM (SELECT kind AS category, strlen(text) - coalesce(strlen(outline), 0) AS saved FROM (SELECT DISTINCT id, kind, text, outline FROM chunks) WHERE strlen(text) >= coalesce(strlen(outline), 0)) GROUP BY 1"
)
def ledger_by_category(spark, d):
    saved = (F.octet_length("text") - F.coalesce(F.octet_length("outline"), F.lit(0))).cast("long")
    return hygiene.ledger_by_category(_chunks(spark, d, "kind", "text", "outline").select(F.col("kind").alias("category"), saved.alias("saved_bytes")).filter("saved_bytes >= 0"))


@query("SELECT event_type, sum((props::JSON->>'$.k')::BIGINT)::BIGINT AS input_tokens, count(*) AS n_lines FROM events GROUP BY 1")
def transcript_usage(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("input_tokens"), F.count(F.lit(1)).alias("n_lines"))


_HIT = " OR ".join(f"contains(lower(x), '{h}')" for h in hygiene.HIGHLIGHTS)


@query(
    f"""SELECT doc_id, mode, n_lines, n_highlights, CASE mode WHEN 'passthrough' THEN t WHEN 'highlights' THEN 'Key error/warning highlights (' || n_highlights || ' total found):' || chr(10) || array_to_string(h[1:40], chr(10))
      ELSE array_to_string(l[1:15], chr(10)) || chr(10) || chr(10) || '[... ' || greatest(n_lines - 30, 0)::VARCHAR || ' lines condensed ...]' || chr(10) || chr(10) || array_to_string(l[-15:], chr(10)) END AS condensed FROM (
      SELECT doc_id, t, l, h, len(l) AS n_lines, len(h) AS n_highlights, CASE WHEN strlen(t) <= 512 AND doc_id % 2 = 0 THEN 'passthrough' WHEN len(h) > 0 THEN 'highlights' ELSE 'head_tail' END AS mode FROM (
        SELECT doc_id, t, l, list_filter(l, lambda x: {_HIT}) AS h FROM (SELECT doc_id, coalesce(text, '') AS t, {_LINES.format("coalesce(text, '')")} AS l FROM documents)))"""
)
def condense_logs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", *hygiene.condense("text", (F.col("doc_id") % 2).cast("int"), 512))


@query(
    """SELECT event_id, suppressed, is_first, row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY ts, event_id) AS count FROM (
      SELECT *, sum(CASE WHEN suppressed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, coalesce(lag(props) OVER w = props, false) AS suppressed, row_number() OVER w = 1 AS is_first FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)))"""
)
def read_guard(spark, d):
    return hygiene.read_guard(table(spark, d, "events"), ["user_id", "event_type"], "props", "ts", "event_id").select("event_id", "suppressed", "is_first", "count")


# ---- texts ----------------------------------------------------------------------------------------------------------


@query(
    f"SELECT doc_id, line_no, length(regexp_extract(line, '^\\s*(#+)', 1)) AS level, regexp_extract(line, '^\\s*#+\\s*(.*?)\\s*$', 1) AS heading FROM (SELECT doc_id, unnest({_LINES.format('text')}) AS line, generate_subscripts({_LINES.format('text')}, 1) AS line_no FROM documents WHERE text IS NOT NULL AND doc_format = 'markdown') WHERE regexp_matches(line, '^\\s*#')"
)
def md_headings(spark, d):
    return textual.headings(table(spark, d, "documents").filter("doc_format = 'markdown'"), ["doc_id"], "text")


@query(
    f"""WITH l AS (SELECT doc_id, unnest({_LINES.format('text')}) AS line, generate_subscripts({_LINES.format('text')}, 1) AS n FROM documents WHERE text IS NOT NULL AND text <> ''),
    g AS (SELECT *, starts_with(ltrim(line), '#') AS head, sum(CASE WHEN starts_with(ltrim(line), '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM l),
    s AS (SELECT doc_id, sec, coalesce(max(CASE WHEN head THEN trim(regexp_replace(trim(line), '^#+', '')) END), 'Overview') AS heading, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), ''), '^\\s+|\\s+$', '', 'g') AS content FROM g GROUP BY 1, 2)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_no, heading, content FROM s WHERE content <> ''"""
)
def doc_sections(spark, d):
    return textual.sections(table(spark, d, "documents"), "doc_id", "text")


_PREFIX_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in textual.OUTLINE_PREFIX.items())


@query(
    f"SELECT file_id, string_agg(line, chr(10) ORDER BY start_line, end_line, name, id) AS outline, count(*) AS n_symbols FROM (SELECT {_cid('file_id')} AS file_id, start_line, end_line, name, id, CASE kind {_PREFIX_SQL} ELSE 'symbol' END || ': L' || start_line || '-L' || end_line || ' | ' || coalesce(signature, qualified_name, name) AS line FROM {_SQL_SYMBOLS}) WHERE file_id IS NOT NULL GROUP BY 1"
)
def file_outlines(spark, d):
    s = _symbols(spark, d, ["file_id", "kind", "name", "qualified_name", "start_line", "end_line", "signature"]).withColumn("file_id", I.canonical_id("file_id"))
    return textual.outlines(s, "file_id", ["start_line", "end_line", "name", "id"])


@query(f"SELECT DISTINCT id, array_to_string({_LINES.format('text')}[2:4], chr(10)) AS part FROM chunks")
def slice_lines(spark, d):
    return table(spark, d, "chunks").select("id", T.slice_lines("text", F.lit(2), F.lit(4)).alias("part")).distinct()


@query(
    f"SELECT DISTINCT d.id AS section_id, s.name, coalesce(list_filter(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), lambda l: contains(lower(l), lower(s.name)))[1], heading) AS context "
    f"FROM (SELECT DISTINCT id, heading, content, lower(coalesce(heading || ' ', '') || coalesce(content, '')) AS t FROM doc_sections) d JOIN (SELECT DISTINCT name FROM symbols WHERE strlen(name) >= 3) s ON contains(d.t, lower(s.name))"
)
def doc_link(spark, d):
    docs = table(spark, d, "doc_sections").select(F.col("id").alias("section_id"), "heading", "content").distinct()
    found = textual.mentions(docs, "section_id", ["heading", "content"], table(spark, d, "symbols").select("name"), "name")
    return found.join(docs, "section_id").select("section_id", "name", textual.mention_context("name", "heading", "content").alias("context")).distinct()


def _sources(spark, d):
    lang = T.language("path")
    return table(spark, d, "source_texts").select("source_id", F.when(lang == "javascript", "typescript").otherwise(lang).alias("language"), "content").distinct()


@query(
    f"SELECT DISTINCT file_id, relative_path, n_symbols, names FROM (SELECT {_cid('file_id')} AS file_id, count(*) AS n_symbols, string_agg(name, ',' ORDER BY start_line, end_line, name, id) AS names FROM {_SQL_SYMBOLS} GROUP BY 1) s JOIN {_SQL_FILES} f ON f.id = s.file_id WHERE f.deleted_at IS NULL"
)
def anatomy(spark, d):
    """Files that are there with their symbols in order of position."""
    s = _symbols(spark, d, ["file_id", "name", "start_line", "end_line"]).withColumn("file_id", I.canonical_id("file_id"))
    rows = s.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_symbols"), F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name", "id"))).alias("x"))
    f = _files(spark, d).filter("deleted_at IS NULL").select(F.col("id").alias("file_id"), "relative_path")
    return rows.join(f, "file_id").select("file_id", "relative_path", "n_symbols", F.array_join(F.transform("x", lambda v: v["name"]), ",").alias("names"))


@query(
    "SELECT id, count(*) FILTER (deep) AS n_fields, count(*) AS n_lines FROM (SELECT DISTINCT id, text FROM chunks WHERE kind = 'config_chunk' AND starts_with(ltrim(text), '{')) c, "
    f"LATERAL (SELECT unnest({_LINES.format('c.text')}) AS line), LATERAL (SELECT regexp_matches(line, '^\\s*\"([^\"]+)\"\\s*:\\s*[^{{\\[\\s]') AS deep) GROUP BY id"
)
def json_fields(spark, d):
    """Scalar members of JSON chunks, by their lines."""
    j = table(spark, d, "chunks").filter((F.col("kind") == "config_chunk") & F.ltrim("text").startswith("{")).select("id", "text", F.lit("json").alias("language")).distinct()
    n = textual.numbered_lines(j, ["id"], "text").groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"))
    f = textual.declared_symbols(j, "id", "language", "text").filter("kind = 'field'").groupBy("id").agg(F.count(F.lit(1)).alias("n_fields"))
    return n.join(f, "id", "left").select("id", F.coalesce("n_fields", F.lit(0)).cast("long").alias("n_fields"), "n_lines")


@query()
def search_with_graph(spark, d):
    """Hits of the hierarchical search, each with its callers and callees: all hits expanded together."""
    hits = search.hierarchical(table(spark, d, "symbols").select("row_id", "name", "qualified_name", "summary", "breadcrumbs").distinct(), "row_id", "flush", 10)
    near = graph.impact(_edges(spark, d), hits.select(F.col("name").alias("root")), 1)
    refs = graph.doc_references(table(spark, d, "doc_references"), table(spark, d, "symbols"), hits.select(F.col("name").alias("root")).distinct())
    about = graph.targets(table(spark, d, "symbols"), _files(spark, d), hits.select(F.col("name").alias("root")).distinct())
    return hits.join(graph.render(about, near, refs).withColumnRenamed("root", "name"), "name", "left").select("row_id", "name", "confidence", F.coalesce("text", F.lit("")).alias("graph"))


_SQL_CALLERS = f"(SELECT node, {_TOKENS.format('node')} AS tokens FROM {_sql_walk('dst', 'src', 1)})"


@query(f"SELECT '{ROOT}' AS root, node, tokens, row_number() OVER (ORDER BY tokens, node) AS pack_rank, used FROM (SELECT node, tokens, sum(tokens) OVER (ORDER BY tokens, node ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM {_SQL_CALLERS}) WHERE used <= 200")
def pack_callers(spark, d):
    """Callers packed into a budget, all of the same score, so the shortest first."""
    near = graph.neighbourhood(_edges(spark, d), _roots(spark), 1, "callers").select("root", "node", F.lit(1.0).alias("score"), K.estimate_tokens("node").alias("tokens"))
    return packing.pack(near, ["root"], "node", "score", "tokens", 200)


@query(
    f"""SELECT root, node, tokens, row_number() OVER (PARTITION BY root ORDER BY tokens, node) AS pack_rank, used FROM (SELECT root, node, tokens, sum(tokens) OVER (PARTITION BY root ORDER BY tokens, node ROWS UNBOUNDED PRECEDING)::BIGINT AS used
      FROM (SELECT root, node, {_TOKENS.format('node')} AS tokens FROM {_sql_walk_all('dst', 'src', 1)})) WHERE used <= 200"""
)
def pack_callers_all(spark, d):
    """Callers of each root packed into a budget."""
    near = graph.neighbourhood(_edges(spark, d), _many_roots(spark, d), 1, "callers").select("root", "node", F.lit(1.0).alias("score"), K.estimate_tokens("node").alias("tokens"))
    return packing.pack(near, ["root"], "node", "score", "tokens", 200)


_SQL_RECALLED = f"(SELECT id, kind, coalesce(title, '') AS title, coalesce(content, '') AS content, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS n FROM {_SQL_MEMORY} WHERE status = 'active' AND kind = 'error')"


@query(
    f"""WITH m AS (SELECT * FROM {_SQL_RECALLED} WHERE n <= 5), r AS (SELECT title FROM {_SQL_RULES} ORDER BY created_at DESC NULLS LAST, id LIMIT 1),
      h AS (SELECT coalesce(d.text, '') AS t, row_number() OVER (ORDER BY x.score DESC, x.doc_id) AS n FROM ({_SQL_HYBRID.format(k=10).rpartition("LIMIT 10")[0]} LIMIT 3) x JOIN documents d ON d.doc_id = x.doc_id),
      whole AS (SELECT '### 🎯 Answer for: "{WORD}"' || chr(10) || chr(10)
        || coalesce((SELECT 'Based on active project **' || upper(kind) || '** (`' || title || '`):' || chr(10) || '> ' || content || chr(10) || chr(10) FROM m WHERE n = 1),
                    (SELECT 'According to active architectural constraints:' || chr(10) || '> ' || title || chr(10) || chr(10) FROM r),
                    'No direct prescriptive rule or decision found for this query in project memory.' || chr(10) || chr(10))
        || coalesce((SELECT '#### 📌 Key Supporting Decisions & Facts:' || chr(10) || string_agg('- **[' || upper(kind) || '] ' || title || '**: ' || content || chr(10), '' ORDER BY n) || chr(10) FROM m WHERE n > 1 HAVING count(*) > 0), '')
        || coalesce((SELECT '#### 🧩 Code Symbols & Graph Context:' || chr(10) || string_agg('```' || chr(10) || t || chr(10) || '```' || chr(10), '' ORDER BY n) FROM h HAVING count(*) > 0), '') AS t)
    SELECT '{WORD}' AS question, coalesce((SELECT string_agg(id, ',' ORDER BY n) FROM m), (SELECT 'rule_0' FROM r), '') AS citations,
      CASE WHEN {_TOKENS.format("t")} > 1000 AND length(t) > 3000 THEN substr(t, 1, 3000) || chr(10) || chr(10) || '*(Truncated to fit 1000 token budget constraint)*' || chr(10) ELSE t END AS answer FROM whole"""
)
def grounded_answer(spark, d):
    """An answer from recalled memories, rules and snippets, each in the order of their rank, within a budget; with citations."""
    m = _memories(spark, d)
    newest = F.struct(F.col("created_at").isNull(), -F.unix_micros(F.col("created_at").cast("timestamp")), "id")
    listed = lambda df, rank, c, out: df.agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), c.alias("v")))).alias("x")).select(F.transform("x", lambda v: v["v"]).alias(out))
    recalled = listed(search.recall(m, "id", 5, kind="error"), newest, F.struct("kind", "title", "content", "id"), "m")
    rules = listed(search.active_rules(m, "id"), newest, F.coalesce("title", F.lit("")), "r")
    hits = search.hybrid(_with_query(spark, d, _doc_vectors(spark, d)), "doc_id", "embedding", F.col("q"), WORD, 3, "source", "outline", "text")
    texts = hits.select("doc_id", "score").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    snippets = listed(texts, F.struct(-F.round("score", 6), "doc_id"), F.coalesce("text", F.lit("")), "s")
    one = recalled.join(rules, F.lit(True)).join(snippets, F.lit(True))  # a row each
    cited = synthesis.citations(F.transform("m", lambda x: x["id"]), F.col("r"))
    return one.select(F.lit(WORD).alias("question"), cited.alias("citations"), synthesis.answer(F.lit(WORD), F.col("m"), F.col("r"), F.col("s"), 1000).alias("answer"))


@query()
def symbol_extract(spark, d):
    return textual.declared_symbols(_sources(spark, d), "source_id", "language", "content")


@query()
def call_extract(spark, d):
    return textual.called_names(_sources(spark, d), "source_id", "content")


@query()
def import_extract(spark, d):
    return textual.imported_paths(_sources(spark, d), "source_id", "content")


# ---- streams --------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    out = ST.run_to_table(ST.windowed_counts(ST.read_events(spark, d), "event_type"), "windows", "update", ["window_start", "event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT DISTINCT date_trunc('day', ts) AS window_start, user_id, event_type, props FROM events")
def stream_dedup(spark, d):
    out = ST.run_to_table(ST.distinct_within(ST.read_events(spark, d), ["user_id", "event_type", "props"]), "dedup")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(SQL["read_guard"].replace("SELECT event_id, suppressed, is_first, row_number()", "SELECT event_id, suppressed, row_number()", 1))
def stream_guard(spark, d):
    e = ST.read_events(spark, d).select("event_id", "ts", "user_id", "event_type", F.col("props").alias("content"))
    return ST.guard_to_table(e, ["user_id", "event_type"])
