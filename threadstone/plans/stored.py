"""Queries of sources, sinks and the memory commands: the tables are written through a sink and read back through a source, and
the result is what SQL gives on the tables. Names begin with the operator's id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadstone.functions import ids as I
from threadstone.functions import text as T
from threadstone.functions import tokens as K
from threadstone.functions import vectors as V
from threadstone.operators import delta, hygiene, memory, search, synthesis
from threadstone.plans import catalogue as C
from threadstone.session import Workspace, table
from threadstone.sources import files as FS
from threadstone.sources.store import Store
from threadstone.streaming import events as ST

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _store(spark: SparkSession) -> Store:
    return Store(spark, Workspace(spark, "store").root)


def _folder(spark: SparkSession, name: str) -> str:
    return Workspace(spark, name).root.removeprefix("file:")


def _plain(df: DataFrame) -> DataFrame:
    """Times without zone, as the tables have them."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema])


def _vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]]


# ---- sources --------------------------------------------------------------------------------------------------------

_ENDINGS = "CASE regexp_extract(lower(path), '\\.([^.]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'go' THEN 'go' ELSE 'unknown' END"
_SQL_TREE = "(SELECT DISTINCT source_id::VARCHAR || '/' || path AS path, content FROM source_texts WHERE content IS NOT NULL)"


def _tree(spark, d) -> DataFrame:
    """The source texts as a tree of files with an ignore file, walked."""
    root = _folder(spark, "tree")
    rows = table(spark, d, "source_texts").select(F.concat_ws("/", F.col("source_id").cast("string"), "path").alias("path"), "content").distinct()
    FS.write_tree(rows, root, "path", "content")
    rules = spark.createDataFrame([(".gitignore", "# builds\n*.go\n!/1*/**/*.go\n/2*/\n")], "path string, content string")
    FS.write_tree(rules, root, "path", "content")
    return FS.walk(spark, root).filter(~F.col("relative_path").startswith(".git"))


@query(
    f"SELECT sha256(path) AS id, path AS relative_path, {_ENDINGS} AS language, strlen(content)::BIGINT AS size_bytes, sha256(content) AS content_hash FROM {_SQL_TREE} "
    "WHERE strlen(content) <= 512 * 1024 AND NOT (path LIKE '%.go' AND NOT path LIKE '1%/%.go') AND NOT path LIKE '2%'"
)
def src_01_walk(spark, d):
    return _tree(spark, d).select("id", "relative_path", "language", "size_bytes", "content_hash")


@query(
    f"""SELECT language, count(*) AS n_files, sum(len({C._LINES.format('content')}))::BIGINT AS n_lines, count(*) FILTER (known) AS n_known FROM (
      SELECT {_ENDINGS} AS language, content, path LIKE '%7.%' AS known FROM {_SQL_TREE} WHERE strlen(content) <= 512 * 1024 AND NOT (path LIKE '%.go' AND NOT path LIKE '1%/%.go') AND NOT path LIKE '2%')
      GROUP BY language"""
)
def src_04_anatomy_scan(spark, d):
    """Line counts by language, and how many files a scan with an older index skips since their hashes are stored."""
    now = _tree(spark, d)
    index = now.filter(F.col("relative_path").like("%7.%")).select("relative_path", "content_hash")
    fresh = delta.unknown(now, index, "relative_path", "content_hash").select("relative_path", F.lit(True).alias("fresh"))
    counted = now.join(fresh, "relative_path", "left").select("language", F.size(T.lines("content")).cast("long").alias("n"), "fresh")
    return counted.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_lines"), F.count_if(F.col("fresh").isNull()).alias("n_known"))


@query(f"SELECT id, kind, title, created_at FROM {C._SQL_MEMORY} WHERE id IN (SELECT {C._cid('superseded_by')} FROM memory_snapshots)")
def src_06_point_lookups(spark, d):
    """The memories that supersede others, looked up by their ids."""
    store = _store(spark)
    store.replace("memory_record", C._memories(spark, d))
    keys = table(spark, d, "memory_snapshots").select(I.canonical_id("superseded_by").alias("id")).filter("id IS NOT NULL")
    return _plain(store.lookup("memory_record", keys).select("id", "kind", "title", "created_at"))


_SQL_FIRST_PATH = f"(SELECT min(f.relative_path) AS p FROM {C._SQL_FILES} f JOIN {C._SQL_SYMBOLS} s ON {C._cid('s.file_id')} = f.id)"


def _indexed(spark, d) -> Store:
    """Files, symbols and chunks in a store, under the ids that their paths give."""
    store = _store(spark)
    files = C._files(spark, d).select(F.col("id").alias("old"), I.file_id("relative_path").alias("id"), "project_id", "relative_path", "content_hash")
    own = files.select("old", F.col("id").alias("new_file"))
    s = C._symbols(spark, d, ["file_id", "kind", "name", "qualified_name", "start_line", "end_line", "signature"]).withColumn("old", I.canonical_id("file_id"))
    c = table(spark, d, "chunks").select("id", "kind", "text", "file_id").distinct().withColumn("old", I.canonical_id("file_id"))
    store.replace("file", files)
    store.replace("symbol", s.join(own, "old").withColumn("file_id", F.col("new_file")))
    store.replace("chunk", c.join(own, "old").withColumn("file_id", F.col("new_file")))
    return store


@query(f"SELECT s.id, s.name, s.start_line FROM {C._SQL_SYMBOLS} s JOIN {C._SQL_FILES} f ON f.id = {C._cid('s.file_id')} WHERE f.relative_path = (SELECT p FROM {_SQL_FIRST_PATH})")
def src_07_file_symbols(spark, d):
    store = _indexed(spark, d)
    used = store.table("symbol").select(F.col("file_id").alias("id")).distinct()
    path = store.table("file").join(used, "id", "left_semi").agg(F.min("relative_path")).first()[0]
    return store.file_symbols(path).select("id", "name", "start_line")


@query(
    "SELECT substr(sha256(doc_id::VARCHAR), 1, 10) AS hash, project_id AS author, regexp_replace(text, '[\\s\\x0B]+$', '', 'g') AS message FROM documents WHERE doc_format = 'commit' AND text IS NOT NULL"
)
def src_08_commit_log(spark, d):
    """Commits written as a log and read from it."""
    at = _folder(spark, "log")
    docs = table(spark, d, "documents").filter("doc_format = 'commit' AND text IS NOT NULL")
    line = F.concat(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 10), F.lit("|"), "project_id", F.lit("|"), "text", F.lit("\n"))
    docs.select(line.alias("value")).write.option("lineSep", "---COMMIT_END---").text(at)
    return FS.commits(spark, at)


_SQL_TRANSCRIPT = """(SELECT CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN strlen('{"token_usage":{"input_tokens":0,"output_tokens":0,"cached_tokens":' || event_id || '}}') // 4 END AS i,
  CASE event_id % 4 WHEN 0 THEN event_id % 7 + 1 WHEN 1 THEN 0 END AS o, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN event_id END AS c, event_type FROM (SELECT *, coalesce((props::JSON->>'$.k')::BIGINT, 0) AS k FROM events))"""


@query(
    f"SELECT count(i) AS n_lines, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(c)::BIGINT AS cached_tokens, round(sum(i) * 5e-7 + sum(o) * 1.5e-6, 9) AS cost FROM {_SQL_TRANSCRIPT}"
)
def src_09_transcripts(spark, d):
    """Usage lines, lines of the other form, broken lines and foreign objects, as transcripts, and what they sum to."""
    at = _folder(spark, "transcripts")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    usage = F.to_json(F.struct(F.struct(k.alias("input_tokens"), (F.col("event_id") % 7 + 1).alias("output_tokens"), F.lit(1).alias("cached_tokens")).alias("usage")))
    other = F.to_json(F.struct(F.struct(F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.col("event_id").alias("cached_tokens")).alias("token_usage")))
    line = F.when(F.col("event_id") % 4 == 0, usage).when(F.col("event_id") % 4 == 1, other).when(F.col("event_id") % 4 == 2, '{"usage": broken').otherwise('{"role": "user"}')
    table(spark, d, "events").select(line.alias("value")).write.text(at)
    found = FS.transcript_usage(spark, at)
    return hygiene.ledger_totals(found).join(found.agg(F.count(F.lit(1)).alias("n_lines")), F.lit(True)).withColumn("cost", F.round("cost", 9))


@query(
    "SELECT DISTINCT project_name AS crate_name, CASE WHEN tree_sitter THEN '0.' || schema_version || '.0' ELSE '0.1.0' END AS version, app AS description, coalesce(secrets_scan, false) AS no_std FROM project_manifests"
)
def src_10_packages(spark, d):
    """A manifest per project, catalogued."""
    root = _folder(spark, "packages")
    version = F.when(F.col("tree_sitter"), F.concat(F.lit('version = "0.'), F.col("schema_version").cast("string"), F.lit('.0"\n'))).otherwise("")
    text = F.concat(
        F.lit('[package]\nname = "'), "project_name", F.lit('"\n'), version, F.lit('description = "'), "app", F.lit('"\n\n[features]\n'), F.when(F.col("secrets_scan"), "no_std = []\n").otherwise("x = []\n"),
    )
    m = table(spark, d, "project_manifests").select(F.concat("project_name", F.lit("/Cargo.toml")).alias("path"), text.alias("content")).distinct()
    FS.write_tree(m, root, "path", "content")
    return FS.packages(spark, [root]).select("crate_name", "version", "description", "no_std")


_SQL_KIND = "CASE WHEN lower(trim(kind)) = 'procedural' THEN 'skill' WHEN lower(trim(kind)) IN ('" + "', '".join(T.MEMORY_KINDS) + "') THEN lower(trim(kind)) ELSE 'fact' END"
_SQL_NOTE = f"SELECT id, {_SQL_KIND} AS kind, coalesce(trim(title), '') AS title, status, symbol_ref, author, regexp_replace(coalesce(content, ''), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS content, coalesce(array_to_string(tags, ','), '') AS tags FROM " + C._SQL_MEMORY


@query(_SQL_NOTE)
def src_11_vault(spark, d):
    """Memories written as notes and read from them."""
    at = _folder(spark, "vault")
    FS.write_vault(C._memories(spark, d), at)
    read = FS.read_vault(spark, f"{at}/*", kind_from_folder=True)
    return read.select("id", "kind", "title", "status", "symbol_ref", "author", "content", F.array_join("tags", ",").alias("tags"))


_FEATURES = ["tree_sitter", "symbol_graph", "token_stats", "egress_scan"]


@query(
    "SELECT project_id AS session_id, project_name AS active_goal, app AS next_action, " + " || ',' || ".join(f"CASE WHEN {f} THEN '{f}' ELSE '' END" for f in _FEATURES) + " AS done, "
    "len(list_filter([" + ", ".join(f"NOT {f}" for f in _FEATURES) + "], lambda x: x)) AS n_pending, 0 AS n_decisions FROM (SELECT DISTINCT * FROM project_manifests)"
)
def src_12_handoffs(spark, d):
    """Handoff notes written and read: what a manifest turns on is done, the rest is pending, and nothing is decided."""
    root = _folder(spark, "handoffs")
    m = table(spark, d, "project_manifests").distinct()
    some = lambda yes: F.filter(F.array(*[F.when(F.col(f) if yes else ~F.col(f), F.lit(f)) for f in _FEATURES]), lambda x: x.isNotNull())
    rows = m.select(
        F.col("project_id").alias("session_id"), F.col("project_name").alias("active_goal"), F.col("app").alias("next_action"), F.lit(None).cast("timestamp").alias("at"),
        some(True).alias("completed_tasks"), some(False).alias("pending_tasks"), F.array().cast("array<string>").alias("key_decisions"), F.array("app").alias("modified_files"),
    )
    FS.write_tree(rows.select(F.concat("session_id", F.lit(".md")).alias("path"), synthesis.handoff_text().alias("content")), root, "path", "content")
    read = FS.read_handoff(spark, root)
    done = F.array_join(F.array(*[F.when(F.array_contains("completed_tasks", f), f).otherwise("") for f in _FEATURES]), ",")
    return read.select("session_id", "active_goal", "next_action", done.alias("done"), F.size("pending_tasks").alias("n_pending"), F.size("key_decisions").alias("n_decisions"))


_SQL_STORED = f"(SELECT * FROM {C._SQL_SYMBOLS} s JOIN (SELECT id AS fid, relative_path FROM {C._SQL_FILES}) f ON f.fid = {C._cid('s.file_id')})"


@query(
    f"""SELECT 'file' AS table_name, count(*) AS n_rows, count(DISTINCT sha256(relative_path)) AS n_keys FROM (SELECT DISTINCT relative_path FROM {C._SQL_FILES})
      UNION ALL SELECT 'symbol', count(*), count(DISTINCT id) FROM {_SQL_STORED}
      UNION ALL SELECT 'memory_record', count(*), count(DISTINCT id) FROM {C._SQL_MEMORY}"""
)
def src_13_bundle(spark, d):
    """A store exported as a bundle and imported into another."""
    store, other, at = _indexed(spark, d), _store(spark), _folder(spark, "bundle")
    store.replace("memory_record", C._memories(spark, d))
    store.export_bundle(at)
    other.import_bundle(at)
    out = None
    for name in ("file", "symbol", "memory_record"):
        one = other.table(name).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_keys")).select(F.lit(name).alias("table_name"), "n_rows", "n_keys")
        out = one if out is None else out.unionByName(one)
    return out


_SQL_NOTES = "(SELECT DISTINCT sha256(id) AS note, content FROM doc_sections WHERE content IS NOT NULL)"


@query(f"SELECT note, sha256(content) AS content_hash FROM {_SQL_NOTES} WHERE contains(lower(content), 'the worker')")
def src_14_note_recall(spark, d):
    """Notes, a file each, that hold a text."""
    root = _folder(spark, "notes")
    docs = table(spark, d, "doc_sections").select(F.concat(F.sha2("id", 256), F.lit(".md")).alias("path"), "content").distinct()
    FS.write_tree(docs, root, "path", "content")
    hits = FS.find_notes(spark, root, "The Worker")
    return hits.select(F.regexp_extract("file", r"([^/]+)\.md$", 1).alias("note"), F.sha2("content", 256).alias("content_hash"))


@query(
    f"""SELECT title, count(*) AS n, 0.9::DOUBLE AS confidence FROM (SELECT trim(regexp_replace(line, '^\\s*[-*] ', '')) AS title FROM (
      SELECT unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM documents WHERE doc_format = 'markdown' AND text IS NOT NULL) WHERE regexp_matches(line, '^\\s*[-*] \\S')) GROUP BY 1"""
)
def src_15_rule_bullets(spark, d):
    at = _folder(spark, "rules")
    table(spark, d, "documents").filter("doc_format = 'markdown' AND text IS NOT NULL").select(F.col("text").alias("value")).write.text(at)
    return FS.rule_bullets(spark, at).groupBy("title", "confidence").agg(F.count(F.lit(1)).alias("n"))


# ---- sinks ----------------------------------------------------------------------------------------------------------


@query(f"SELECT id, kind, status, title, created_at, valid_until FROM {C._SQL_MEMORY}")
def snk_01_upsert(spark, d):
    """Snapshots upserted in two halves, several rows of a memory in each: the last one stands."""
    store = _store(spark)
    m = table(spark, d, "memory_snapshots").withColumn("id", I.canonical_id("id")).withColumn("status", F.lower(F.trim("status"))).filter("status <> ''")
    middle = m.agg(F.timestamp_micros(((F.min(F.unix_micros(F.col("snapshot_at").cast("timestamp"))) + F.max(F.unix_micros(F.col("snapshot_at").cast("timestamp")))) / 2).cast("long")).alias("t")).first().t
    for part in (F.col("snapshot_at").cast("timestamp") <= F.lit(middle), F.col("snapshot_at").cast("timestamp") > F.lit(middle)):
        store.upsert("memory_record", m.filter(part), ["snapshot_at", "ingested_at", "row_id"])
    return _plain(store.table("memory_record").select("id", "kind", "status", "title", "created_at", "valid_until"))


@query(f"SELECT DISTINCT doc_section_id AS memory_id, {C._cid('symbol_id')} AS symbol_id, 'governs' AS relation FROM doc_references WHERE {C._cid('symbol_id')} IS NOT NULL")
def snk_05_links(spark, d):
    """Links, written twice, are there once."""
    store = _store(spark)
    links = table(spark, d, "doc_references").select(F.col("doc_section_id").alias("memory_id"), I.canonical_id("symbol_id").alias("symbol_id"), F.lit("governs").alias("relation"))
    links = links.filter("symbol_id IS NOT NULL")
    store.upsert("governs", links.filter("hash(symbol_id) % 2 = 0"))
    store.upsert("governs", links)
    return store.table("governs").select("memory_id", "symbol_id", "relation")


_SQL_MODELS = f"(SELECT project_id AS topic, list(DISTINCT relative_path) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY relative_path, id) AS n FROM {C._SQL_FILES}) WHERE n <= 5 GROUP BY 1)"


def _file_models(spark, d) -> DataFrame:
    """A model per project that refers to the project's first five files, with their hashes."""
    from pyspark.sql import Window

    first = C._files(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy("relative_path", "id"))).filter("n <= 5")
    snap = F.map_from_entries(F.array_distinct(F.collect_list(F.struct("id", F.coalesce("content_hash", F.lit(""))))))
    return first.groupBy(F.col("project_id").alias("topic")).agg(F.collect_set("relative_path").alias("referenced_files"), snap.alias("file_hashes_snapshot"))


@query(f"SELECT topic, len(list_intersect(paths, (SELECT list(relative_path) FROM {C._SQL_FILES} WHERE deleted_at IS NOT NULL))) > 0 AS is_stale FROM {_SQL_MODELS}")
def snk_06_mark_stale(spark, d):
    """Models that refer to a deleted file."""
    store = _store(spark)
    store.replace("mental_model", _file_models(spark, d).withColumn("is_stale", F.lit(False)))
    store.mark_stale(C._files(spark, d).filter("deleted_at IS NOT NULL").select(F.col("relative_path").alias("path")))
    return store.models().select("topic", "is_stale")


@query(
    f"""SELECT topic, count(*) FILTER (c.content_hash IS NULL) AS n_gone, count(*) FILTER (c.content_hash IS NOT NULL AND c.content_hash <> o.h) AS n_changed FROM (
      SELECT project_id AS topic, id, coalesce(content_hash, '') AS h FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY relative_path, id) AS n FROM {C._SQL_FILES}) WHERE n <= 5) o
      LEFT JOIN (SELECT id, coalesce(content_hash, '') AS content_hash FROM {C._SQL_FIRST_FILES}) c ON c.id = o.id GROUP BY 1"""
)
def mem_09_hash_snapshots(spark, d):
    """Models' snapshots of hashes (a map) against the hashes of another state of the files."""
    store = _store(spark)
    store.upsert("mental_model", _file_models(spark, d))
    old = store.table("mental_model").select("topic", F.explode("file_hashes_snapshot").alias("id", "h"))
    now = C._first_files(spark, d).select("id", F.coalesce("content_hash", F.lit("")).alias("content_hash"))
    both = old.join(now, "id", "left")
    return both.groupBy("topic").agg(F.count_if(F.col("content_hash").isNull()).alias("n_gone"), F.count_if(F.col("content_hash") != F.col("h")).alias("n_changed"))


_SQL_GONE = f"(SELECT id FROM {C._SQL_FILES} WHERE deleted_at IS NOT NULL)"


@query(
    f"""SELECT 'symbol' AS table_name, count(*) AS n_rows FROM {C._SQL_SYMBOLS} WHERE {C._cid('file_id')} IS NULL OR {C._cid('file_id')} NOT IN (SELECT id FROM {_SQL_GONE})
      UNION ALL SELECT 'chunk', count(*) FROM (SELECT DISTINCT id, file_id FROM chunks) WHERE {C._cid('file_id')} IS NULL OR {C._cid('file_id')} NOT IN (SELECT id FROM {_SQL_GONE})
      UNION ALL SELECT 'file', count(*) FROM {C._SQL_FILES} WHERE deleted_at IS NULL
      UNION ALL SELECT 'doc_reference', count(*) FROM (SELECT DISTINCT doc_section_id, {C._cid('symbol_id')} AS sid FROM doc_references) WHERE sid IS NULL OR sid NOT IN (SELECT id FROM {C._SQL_SYMBOLS} WHERE {C._cid('file_id')} IN (SELECT id FROM {_SQL_GONE}))"""
)
def snk_07_delete_files(spark, d):
    """What is left of a store's tables when the deleted files and all that hangs on them have gone."""
    store = _store(spark)
    store.replace("file", C._files(spark, d))
    store.replace("symbol", C._symbols(spark, d, ["file_id", "name"]).withColumn("file_id", I.canonical_id("file_id")))
    store.replace("chunk", table(spark, d, "chunks").select("id", I.canonical_id("file_id").alias("file_id")).distinct())
    store.replace("doc_reference", table(spark, d, "doc_references").select("doc_section_id", I.canonical_id("symbol_id").alias("symbol_id")).distinct())
    store.delete_files(C._files(spark, d).filter("deleted_at IS NOT NULL").select("id", "relative_path"))
    out = None
    for name in ("symbol", "chunk", "file", "doc_reference"):
        one = store.table(name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT path AS relative_path, sha256(content) AS content_hash, count(*) OVER (PARTITION BY sha256(content)) AS n_copies FROM (
      SELECT *, row_number() OVER (PARTITION BY path ORDER BY fetched_at DESC, sha256(content) DESC) AS n FROM source_texts WHERE content IS NOT NULL AND content <> '') WHERE n = 1"""
)
def snk_08_reindex_stream(spark, d):
    """Change events of files as a stream: each batch purges what was indexed of its files and puts in what they hold now."""
    store = _store(spark)

    def apply(batch: DataFrame, no: int) -> None:
        files = batch.select(I.file_id("path").alias("id"), F.col("path").alias("relative_path"), I.content_hash("content").alias("content_hash"), F.col("fetched_at").cast("timestamp").alias("last_indexed_at"), "content")
        chunks = FS.chunked(files, files.select(F.col("id").alias("file_id"), F.lit("").alias("symbol_id"), F.lit(1).alias("start_line"), F.lit(0).alias("end_line")).limit(0))
        store.purge_and_replace(files, store.table("symbol").limit(0), chunks.withColumn("id", F.concat("file_id", "kind")).withColumn("content_hash", I.content_hash("text")))

    stream = ST.read_changes(spark, d, "source_texts").filter("content IS NOT NULL AND content <> ''")
    ST.apply_changes(stream, "path", F.struct("fetched_at", I.content_hash("content")), apply, "reindex")
    one = store.table("file").select("relative_path", "content_hash")
    copies = one.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_copies"))  # as many rows as contents, not a window over one of them
    return one.join(copies, "content_hash").select("relative_path", "content_hash", "n_copies")


@query("SELECT doc_id, doc_id::VARCHAR || '-' || substr(sha256(text), 1, 8) || '.log' AS file, strlen(text)::BIGINT AS raw_bytes FROM documents WHERE doc_format = 'log' AND strlen(text) > 512")
def snk_14_log_cache(spark, d):
    """Raw logs that don't pass through, kept under a name of time and hash."""
    logs = table(spark, d, "documents").filter("doc_format = 'log'").withColumn("epoch", F.col("doc_id"))
    kept = hygiene.cached_logs(logs, "text", "epoch", F.lit(0), 512)
    return kept.select("doc_id", F.col("cache_file").alias("file"), F.octet_length("raw").cast("long").alias("raw_bytes"))


@query(f"SELECT id, {_SQL_KIND} AS kind, coalesce(trim(title), '') AS title, status, regexp_replace(coalesce(content, ''), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS content FROM {C._SQL_MEMORY}")
def snk_15_vault_sync(spark, d):
    """Notes of one store taken into another, both ways."""
    first, second, a, b = _store(spark), _store(spark), _folder(spark, "vault"), _folder(spark, "vault")
    m = C._memories(spark, d)
    first.replace("memory_record", m.filter("ascii(right(id, 1)) % 2 = 0"))
    FS.write_vault(m.filter("ascii(right(id, 1)) % 2 = 1"), a)
    first.sync_vault(f"{a}/*", b, kind_from_folder=True)
    second.sync_vault(f"{b}/*", _folder(spark, "vault"), kind_from_folder=True)
    return second.table("memory_record").select("id", "kind", F.trim("title").alias("title"), "status", F.regexp_replace("content", r"^\s+|\s+$", "").alias("content"))


@query("SELECT user_id::VARCHAR AS session_id, count(*) AS n, sum(coalesce((props::JSON->>'$.k')::BIGINT, 0))::BIGINT AS input_tokens FROM events GROUP BY 1")
def snk_16_ledger(spark, d):
    """Usage appended to a ledger in three parts, and its sums."""
    store = _store(spark)
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    rows = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"), k.alias("input_tokens"), F.col("ts").alias("recorded_at"))
    for i in range(3):
        store.append("token_ledger", rows.filter(F.col("event_id") % 3 == i))
    return store.table("token_ledger").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"))


# ---- memories and models --------------------------------------------------------------------------------------------

_SQL_COS0 = "list_cosine_similarity({0}::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"
_SQL_TOPICS = f"(SELECT *, row_number() OVER (ORDER BY s DESC, vec_id::VARCHAR) AS n FROM (SELECT vec_id, label, {_SQL_COS0.format('embedding')} AS s FROM embeddings))"


def _modelled(spark, d) -> Store:
    """A model per vector; every third one is stale."""
    store = _store(spark)
    e = table(spark, d, "embeddings")
    topic = F.col("vec_id").cast("string")
    store.upsert("mental_model", e.select(topic.alias("id"), topic.alias("topic"), F.concat(F.lit("answer "), topic).alias("standing_answer"), (F.col("vec_id") % 3 == 0).alias("is_stale"), "embedding"))
    store.upsert("crate_catalog", e.select(topic.alias("crate_name"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("description"), "embedding"))
    return store


@query(f"SELECT vec_id::VARCHAR AS topic, round(s, 6) AS score FROM {_SQL_TOPICS} WHERE n <= 3 AND vec_id % 3 <> 0 ORDER BY n LIMIT 1")
def ret_10_standing_model(spark, d):
    return _modelled(spark, d).standing_model(_vector(spark, d)).select("topic", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id::VARCHAR AS crate_name, 'label ' || label AS description, round(s, 6) AS score FROM {_SQL_TOPICS} WHERE n <= 10")
def ret_11_catalogue(spark, d):
    return _modelled(spark, d).crates(_vector(spark, d), 10).select("crate_name", "description", F.round("score", 6).alias("score"))


@query("SELECT 'answer ' || vec_id AS standing_answer, vec_id::VARCHAR AS topic, vec_id % 3 = 0 AS is_stale FROM embeddings")
def mem_10_models(spark, d):
    """Models created and listed."""
    return _modelled(spark, d).models().select("topic", "standing_answer", "is_stale")


_SQL_RECORDS = f"""(SELECT m.*, e.embedding FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM {C._SQL_MEMORY}) m LEFT JOIN embeddings e ON e.vec_id = m.pos)"""


def _remembering(spark, d) -> Store:
    """Memories with vectors: the k-th by id has the vector k. What they say takes sides by the id."""
    store = _store(spark)
    m = C._memories(spark, d)
    ids = m.select("id").orderBy("id")
    # vectors are given by position, so the ids are numbered: range by range, as a sort has them
    numbered = ids.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - (F.spark_partition_id().cast("long") * F.lit(2**33)))
    numbered = Workspace(spark, "numbered").cut(numbered, "ids")
    starts = {r["_p"]: r["n"] for r in numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    before, total = {}, 0
    for p in sorted(starts):
        before[p], total = total, total + starts[p]
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    numbered = numbered.select("id", (F.element_at(base, F.col("_p")).cast("long") + F.col("_i")).alias("vec_id"))
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    says = F.when(F.ascii(F.right("id", F.lit(1))) % 2 == 0, "Always use: ").otherwise("Never use: ")
    rows = m.join(numbered, "id").join(e, "vec_id", "left").withColumn("content", F.concat(says, F.coalesce("content", F.lit(""))))
    store.replace("memory_record", rows)
    return store


_SQL_NEAR = f"(SELECT * FROM (SELECT id, kind, title, content, status, {_SQL_COS0.format('embedding')} AS s FROM {_SQL_RECORDS} WHERE status = 'active' AND kind = 'decision' AND embedding IS NOT NULL) ORDER BY s DESC, id LIMIT 5)"


@query(f"SELECT id, title, round(s, 6) AS score FROM {_SQL_NEAR} WHERE s >= 0.0")
def ret_08_conflict_candidates(spark, d):
    """Of the five nearest active memories of a kind those at or above a similarity."""
    store = _remembering(spark, d)
    return store.near(_vector(spark, d), "decision", 0.0).select("id", "title", F.round("score", 6).alias("score"))


_SAYS = "(CASE WHEN ascii(right(id, 1)) % 2 = 0 THEN 'always use: ' ELSE 'never use: ' END || lower(coalesce(content, '')))"
_SHARED = f"len(list_intersect({C._WORDS_SQL.format(_SAYS)}, {C._WORDS_SQL.format(chr(39) + 'Always use: this worker pool is stateless because callers must lock before they release the queue' + chr(39))})) >= 2"
_INCOMING = "Always use: this worker pool is stateless because callers must lock before they release the queue"


@query(
    f"""SELECT count(*) AS n_records, count(*) FILTER (status = 'superseded') AS n_superseded, count(*) FILTER (id IN (SELECT id FROM {_SQL_NEAR} WHERE s >= 0.0 AND {_SAYS} LIKE '%never %' AND {_SHARED})) AS n_resolved
      FROM (SELECT id, CASE WHEN id IN (SELECT id FROM {_SQL_NEAR} WHERE s >= 0.0 AND {_SAYS} LIKE '%never %' AND {_SHARED}) THEN 'superseded' ELSE status END AS status FROM {C._SQL_MEMORY} UNION ALL SELECT 'new', 'active')"""
)
def mem_02_remember(spark, d):
    """A new decision that contradicts near ones supersedes them."""
    store = _remembering(spark, d)
    new, against = store.remember(_INCOMING, _vector(spark, d), "decision", resolve=True, threshold=0.0)
    t = store.table("memory_record")
    return t.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("status") == "superseded").alias("n_superseded"), F.count_if(F.col("superseded_by") == new).alias("n_resolved"))


# ---- reflections and contexts ---------------------------------------------------------------------------------------

_SQL_REFLECTED = f"""WITH c AS {C._SQL_CANDIDATES}, p AS {C.sql_pack('c', 1500)} SELECT '{C.WORD}' AS question, '# Reflection: {C.WORD}' || chr(10) || chr(10) || '## Grounded Evidence' || chr(10) || chr(10)
  || string_agg('### ' || title || chr(10) || text || chr(10) || chr(10), '' ORDER BY pack_rank, c.key) AS answer, string_agg(c.key::VARCHAR, ',' ORDER BY pack_rank, c.key) AS citations, false AS from_model
  FROM p JOIN c ON c.key::VARCHAR = p.key"""


def _evidence(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(C.search_source("source"), F.lit("")).alias("title"), K.estimate_tokens("text").alias("tokens"))
    return search.fuse(C._streams(spark, d)).select("key", F.round("score", 9).alias("score")).join(docs, "key")


@query(_SQL_REFLECTED)
def ret_12_reflect(spark, d):
    """Every model is stale, so the fused evidence answers."""
    store = _store(spark)
    return synthesis.reflection(C.WORD, store.standing_model(_vector(spark, d)), _evidence(spark, d), 1500)


@query(f"SELECT '{C.WORD}' AS question, 'answer ' || vec_id AS answer, vec_id::VARCHAR AS citations, true AS from_model FROM {_SQL_TOPICS} WHERE n <= 3 AND vec_id % 3 <> 0 ORDER BY n LIMIT 1")
def ret_12_reflect_standing(spark, d):
    """The nearest model that isn't stale answers."""
    return synthesis.reflection(C.WORD, _modelled(spark, d).standing_model(_vector(spark, d)), _evidence(spark, d), 1500)


_SQL_CONTEXT_RULES = f"(SELECT n - 1 AS n, '[' || upper(kind) || '] ' || coalesce(title, '') AS title, kind AS pattern, coalesce(content, '') AS solution FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS n FROM {C._SQL_RULES}))"
_SQL_RULE_TEXT = "'- **[Rule: ' || title || ']** When `' || pattern || '` => `' || solution || '` (confidence: 0.95)'"
_SAID = "## 🎯 Active Project Objective\n- **Active Goal**: goal\n- **Next Action**: act\n\n"
_SQL_SAID = "'" + _SAID.replace("\n", "' || chr(10) || '") + "'"


def _sql_context() -> str:
    left = f"(2000 - {C._TOKENS.format('(' + _SQL_SAID + ')')} - 50)"
    return f"""WITH r AS (SELECT 'rule_' || lpad(n::VARCHAR, 6, '0') AS key, 90.0::DOUBLE AS score, title, {_SQL_RULE_TEXT} AS text FROM {_SQL_CONTEXT_RULES}),
      i AS (SELECT key, score, title, text, {C._TOKENS.format('text')} AS tokens FROM r UNION ALL SELECT 'doc_' || lpad(key::VARCHAR, 12, '0'), score, title, text, tokens FROM {C._SQL_CANDIDATES}),
      p AS {C.sql_pack('i', 'BUDGET')}, t AS (SELECT i.*, pack_rank FROM p JOIN i ON i.key = p.key)
      SELECT '{C.WORD}' AS task, '# 🧠 Cognitive Context (Budget: 2000 tokens)' || chr(10) || chr(10) || '**Task**: `{C.WORD}`' || chr(10) || chr(10) || {_SQL_SAID}
        || coalesce((SELECT '## 📜 Active Architectural Constraints' || chr(10) || string_agg(text || chr(10), '' ORDER BY pack_rank, key) || chr(10) FROM t WHERE starts_with(key, 'rule_') HAVING count(*) > 0), '')
        || coalesce((SELECT '## 🧩 Relevant Symbols & Code Subgraphs' || chr(10) || string_agg('### ' || title || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY pack_rank, key) FROM t WHERE starts_with(key, 'doc_') HAVING count(*) > 0), '') AS context,
        (SELECT count(*) FROM t WHERE starts_with(key, 'rule_')) AS n_rules, (SELECT count(*) FROM t WHERE starts_with(key, 'doc_')) AS n_snippets""".replace("BUDGET", left)


@query(_sql_context())
def ret_13_context(spark, d):
    """Active rules and fused candidates in what a handoff leaves of the budget, in sections."""
    from pyspark.sql import Window

    rules = search.active_rules(C._memories(spark, d), "id")
    n = F.row_number().over(Window.orderBy(F.desc_nulls_last("created_at"), "id")) - 1  # fifty rows
    rules = rules.select(n.alias("n"), F.concat(F.lit("["), F.upper("kind"), F.lit("] "), F.coalesce("title", F.lit(""))).alias("title"), F.col("kind").alias("pattern"), F.col("content").alias("solution"), F.lit(0.95).alias("confidence"))
    return synthesis.context(C.WORD, rules, _evidence(spark, d), "goal", "act", 2000)


# ---- counters, slices, kinds ----------------------------------------------------------------------------------------


@query(f"SELECT change, count(*) AS n FROM ({C.SQL['delta_classify']}) GROUP BY 1")
def agg_10_delta_counters(spark, d):
    return C.delta_classify(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n_files, sum(n_symbols)::BIGINT AS n_symbols, max(n_symbols) AS most FROM ({C.SQL['anatomy']})")
def agg_08_anatomy_totals(spark, d):
    return C.anatomy(spark, d).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_symbols").alias("n_symbols"), F.max("n_symbols").alias("most"))


@query("SELECT embedding_model, count(DISTINCT id) AS n_vectors, round(count(DISTINCT id) / (epoch_us(max(updated_at)) - epoch_us(min(updated_at))) * 1e6, 9) AS per_second FROM chunks GROUP BY 1 HAVING max(updated_at) > min(updated_at)")
def agg_11_throughput(spark, d):
    """Vectors a second of each model, between its first and last update."""
    us = lambda f: F.unix_micros(f("updated_at").cast("timestamp"))
    by = table(spark, d, "chunks").groupBy("embedding_model").agg(F.countDistinct("id").alias("n_vectors"), (us(F.max) - us(F.min)).alias("t")).filter("t > 0")
    return by.select("embedding_model", "n_vectors", F.round(F.col("n_vectors") / F.col("t") * 1e6, 9).alias("per_second"))


@query(
    f"""WITH s AS (SELECT id, {C._cid('file_id')} AS fid, name, start_line, end_line FROM {C._SQL_SYMBOLS}), f AS (SELECT id, text FROM (SELECT {C._cid('file_id')} AS id, text, row_number() OVER (PARTITION BY {C._cid('file_id')} ORDER BY id, sha256(text)) AS n FROM chunks WHERE {C._cid('file_id')} IS NOT NULL) WHERE n = 1),
      p AS (SELECT f.id AS file_id, s.id AS symbol_id, array_to_string({C._LINES.format('text')}[greatest(start_line, 1):end_line], chr(10)) AS t, greatest(start_line, 1) AS a, end_line AS b, len({C._LINES.format('text')}) AS k FROM f JOIN s ON s.fid = f.id)
      SELECT file_id, 'symbol_chunk' AS kind, count(*) AS n, sum(length(t))::BIGINT AS chars FROM p WHERE t <> '' GROUP BY 1
      UNION ALL SELECT id, 'file_summary', 1, length(text) FROM f WHERE id NOT IN (SELECT fid FROM s WHERE fid IS NOT NULL) AND regexp_matches(text, '\\S')
      UNION ALL SELECT file_id, 'file_outline', 1, length(outline) FROM ({C.SQL['file_outlines']}) o WHERE file_id IN (SELECT id FROM f)"""
)
def ext_15_chunks(spark, d):
    """Outlines, symbols' lines and whole texts of files; a file's first chunk stands for its text."""
    c = table(spark, d, "chunks").select(I.canonical_id("file_id").alias("id"), "text", F.col("id").alias("k")).filter("id IS NOT NULL")
    texts = c.groupBy("id").agg(F.min_by("text", F.struct("k", F.sha2("text", 256))).alias("content"))
    s = C._symbols(spark, d, ["file_id", "kind", "name", "qualified_name", "start_line", "end_line", "signature"])
    s = s.withColumn("file_id", I.canonical_id("file_id")).withColumnRenamed("id", "symbol_id")
    return FS.chunked(texts, s, outlined=True).groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    f"""SELECT c.id, arg_min(array_to_string({C._LINES.format('c.text')}[1:greatest(s.end_line - s.start_line + 1, 0)], chr(10)), (s.start_line, s.end_line, s.id)) AS part
      FROM (SELECT DISTINCT id, text, {C._cid('symbol_id')} AS sid FROM chunks) c JOIN {C._SQL_SYMBOLS} o ON o.id = c.sid JOIN {C._SQL_SYMBOLS} s ON s.name = o.name AND {C._cid('s.file_id')} = {C._cid('o.file_id')} GROUP BY 1"""
)
def ext_17_slice_by_name(spark, d):
    """The lines of the first symbol of a name in a file; chunks begin where their symbol does."""
    s = C._symbols(spark, d, ["file_id", "name", "start_line", "end_line"]).withColumn("file_id", I.canonical_id("file_id"))
    first = s.groupBy("file_id", "name").agg(F.min(F.struct("start_line", "end_line", "id")).alias("f"))
    c = table(spark, d, "chunks").select("id", "text", I.canonical_id("symbol_id").alias("sid")).distinct()
    at = c.join(s.select(F.col("id").alias("sid"), "file_id", "name"), "sid").join(first, ["file_id", "name"])
    return at.select("id", T.slice_lines("text", F.lit(1), F.col("f.end_line") - F.col("f.start_line") + 1).alias("part"))


@query(
    "SELECT doc_id, CASE WHEN strlen(f) <= 512 AND doc_id % 2 = 0 THEN 'passthrough' WHEN regexp_matches(lower(f), 'error:|failed|failure|panic|warning:|exception') THEN 'highlights' ELSE 'head_tail' END AS mode, strlen(f)::BIGINT AS bytes "
    "FROM (SELECT doc_id, 'STDOUT:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'STDERR:' || chr(10) || coalesce(source, '') AS f FROM documents)"
)
def ext_18_framed(spark, d):
    """Both outputs of a command in one frame, condensed."""
    framed = table(spark, d, "documents").select("doc_id", hygiene.frame("text", "source").alias("f"))
    return framed.select("doc_id", hygiene.condense("f", (F.col("doc_id") % 2).cast("int"), 512)[0], F.octet_length("f").cast("long").alias("bytes"))


@query(
    "SELECT DISTINCT kind, CASE WHEN k = 'procedural' THEN 'skill' WHEN k IN ('" + "', '".join(T.MEMORY_KINDS) + "') THEN k END AS parsed FROM (SELECT kind, lower(trim(kind)) AS k FROM memory_snapshots)"
)
def fil_12_kinds(spark, d):
    return table(spark, d, "memory_snapshots").select("kind", T.memory_kind("kind").alias("parsed")).distinct()


@query(
    "SELECT DISTINCT relative_path, NOT regexp_matches(relative_path, '(^|/)(target|\\.git|\\.index)/') AND regexp_extract(lower(relative_path), '\\.([^.]+)$', 1) IN ('rs', 'py', 'ts', 'c', 'h', 'cpp', 'hpp', 'go', 'md', 'json', 'yaml', 'toml') AS watched FROM files"
)
def fil_13_watched(spark, d):
    return table(spark, d, "files").select("relative_path", T.is_watched("relative_path").alias("watched")).distinct()


_SQL_JSON = "(SELECT DISTINCT id, text FROM chunks WHERE kind = 'config_chunk' AND starts_with(ltrim(text), '{') AND json_valid(text))"


@query(
    f"""SELECT id, path, kind, count(*) AS n FROM (SELECT c.id, replace(regexp_replace(substr(t.fullkey, 3), '\\[\\d+\\]', '', 'g'), '"', '') AS path, CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN 'struct' ELSE 'field' END AS kind
      FROM {_SQL_JSON} c, json_tree(c.text) t WHERE t.key IS NOT NULL AND NOT regexp_matches(t.fullkey, '\\[\\d+\\]$')) GROUP BY ALL"""
)
def ext_08_json_paths(spark, d):
    """Members of JSON texts as dotted paths: containers are structs, scalars fields."""
    from threadstone.operators.textual import json_paths

    j = table(spark, d, "chunks").filter((F.col("kind") == "config_chunk") & F.ltrim("text").startswith("{")).select("id", "text").distinct()
    return json_paths(j, "id", "text").groupBy("id", "path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def ext_09_yaml_paths(spark, d):
    """Members of YAML texts as dotted paths. A configuration is YAML if its first line that is no comment is a key and a colon."""
    from threadstone.operators.textual import yaml_paths

    first = r"^(?:\s*(?:#[^\n]*|---)?\n)*(?:- )?[\w.-]+:(?:\s|$)"
    y = table(spark, d, "chunks").filter((F.col("kind") == "config_chunk") & F.col("text").rlike(first)).select("id", "text").distinct()
    return yaml_paths(y, "id", "text").groupBy("id", "path", "kind").agg(F.count(F.lit(1)).alias("n"))
