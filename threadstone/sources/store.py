"""A store of tables over parquet folders: scans, upserts, cascades, export and import, and the memory commands on top."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadstone.functions.ids import file_id
from threadstone.functions.text import is_conflict
from threadstone.functions.vectors import cosine
from threadstone.operators import delta, search
from threadstone.sources.files import read_vault, write_vault

VERSION = 1

# The tables, their keys and columns.
_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_LIST, _VEC, _MAP = T.ArrayType(T.StringType()), T.ArrayType(T.FloatType()), T.MapType(T.StringType(), T.StringType())


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SCHEMAS = {
    "file": _schema(id=_S, project_id=_S, relative_path=_S, language=_S, content_hash=_S, size_bytes=_L, last_indexed_at=_TS),
    "symbol": _schema(id=_S, file_id=_S, kind=_S, name=_S, qualified_name=_S, start_line=_L, end_line=_L, signature=_S, doc=_S, fingerprint=_S, is_macro_node=_B, parent_id=_S, breadcrumbs=_LIST, summary=_S),
    "chunk": _schema(id=_S, file_id=_S, symbol_id=_S, kind=_S, text=_S, outline=_S, content_hash=_S, start_line=_L, end_line=_L, embedding=_VEC, embedding_model=_S, embedding_dim=_L, vector_set_id=_S, updated_at=_TS),
    "calls": _schema(caller_id=_S, callee_name=_S, caller_name=_S, line=_L, weight=_D, traversal_count=_L, last_traversed_at=_TS, valid_from=_TS, valid_to=_TS),
    "imports": _schema(file_id=_S, imported_path=_S, imported_symbols=_LIST, weight=_D),
    "doc_section": _schema(id=_S, file_path=_S, heading=_S, content=_S, embedding=_VEC),
    "doc_reference": _schema(doc_section_id=_S, symbol_id=_S, symbol_name=_S, context=_S, created_at=_TS),
    "memory_record": _schema(id=_S, project_id=_S, session_id=_S, kind=_S, title=_S, content=_S, tags=_LIST, symbol_ref=_S, status=_S, superseded_by=_S, author=_S, confidence=_D, source_hash=_S, embedding=_VEC, created_at=_TS, valid_until=_TS),
    "governs": _schema(memory_id=_S, symbol_id=_S, relation=_S, created_at=_TS),
    "mental_model": _schema(id=_S, topic=_S, question=_S, standing_answer=_S, referenced_symbols=_LIST, referenced_files=_LIST, source_memory_ids=_LIST, file_hashes_snapshot=_MAP, is_stale=_B, last_refreshed_at=_TS, embedding=_VEC),
    "procedural_skill": _schema(name=_S, description=_S, triggers=_LIST, workflow_steps=_LIST, required_tools=_LIST, status=_S, success_count=_L, last_executed_at=_TS),
    "crate_catalog": _schema(crate_name=_S, root_path=_S, version=_S, description=_S, exported_types=_LIST, exported_traits=_LIST, updated_at=_TS, embedding=_VEC),
    "token_ledger": _schema(session_id=_S, model_id=_S, input_tokens=_L, output_tokens=_L, cached_tokens=_L, recorded_at=_TS),
}
KEYS = {
    "calls": ["caller_id", "callee_name"], "imports": ["file_id", "imported_path"], "doc_reference": ["doc_section_id", "symbol_id"], "governs": ["memory_id", "symbol_id"],
    "mental_model": ["topic"], "procedural_skill": ["name"], "crate_catalog": ["crate_name"], "token_ledger": ["session_id", "recorded_at"],
}


class Store:
    """Tables as versioned parquet folders below ``base``. A write makes the next version of a table, then points to it; a
    reader keeps the version it has read. One writer at a time."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self, name: str) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.base}/{name}")
        if not fs.exists(at):
            return []
        done = [p.getPath() for p in fs.listStatus(at) if fs.exists(path(p.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done if p.getName().startswith("v"))

    def table(self, name: str) -> DataFrame:
        """The current state of a table; empty before its first write."""
        have = self._versions(name)
        if not have:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.base}/{name}/v{have[-1]}")

    def replace(self, name: str, df: DataFrame) -> None:
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
        df.select(*fields).write.parquet(f"{self.base}/{name}/v{(self._versions(name) or [0])[-1] + 1}")

    def upsert(self, name: str, new: DataFrame, order: list[str] | None = None) -> None:
        """Whole rows in place of those of equal keys. Of several new rows of a key the last by the ``order`` columns counts, of
        equals the largest."""
        key = KEYS.get(name, ["id"])
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
        given = new.select(*fields, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [])])
        plain = [f.name for f in SCHEMAS[name] if f.name not in key and not isinstance(f.dataType, T.MapType)]
        one = delta.latest(given, key, [f"_o{i}" for i in range(len(order or []))] + plain).select(*[f.name for f in SCHEMAS[name]])
        self.replace(name, delta.upsert(self.table(name), one, key))

    def append(self, name: str, new: DataFrame) -> None:
        """Adds rows to the current version, as ledgers and logs grow; nothing that is there is rewritten."""
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
        new.select(*fields).write.mode("append").parquet(f"{self.base}/{name}/v{(self._versions(name) or [1])[-1]}")

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of many keys at once: ``keys`` has one column."""
        key = KEYS.get(name, ["id"])[0]
        return self.table(name).join(keys.toDF(key).distinct(), key, "left_semi")

    def purge_and_replace(self, files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> None:
        """Files that have changed: what was indexed of them (symbols, chunks, imports) goes, what is given comes."""
        gone = files.select("id").distinct()
        for name, new in (("symbol", symbols), ("chunk", chunks), ("imports", None)):
            kept = delta.without(self.table(name), F.col("file_id"), gone, "id")
            if new is not None:
                fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
                kept = kept.select(*[f.name for f in SCHEMAS[name]]).unionByName(new.select(*fields))
            self.replace(name, kept)
        self.upsert("file", files)

    def models(self) -> DataFrame:
        """The mental models, last refreshed first."""
        return self.table("mental_model").orderBy(F.desc_nulls_last("last_refreshed_at"), "topic")

    def get(self, name: str, value: str) -> DataFrame:
        return self.table(name).filter(F.col(KEYS.get(name, ["id"])[0]) == value).limit(1)

    def file_symbols(self, path: str) -> DataFrame:
        """The symbols of a file, by position."""
        return self.table("symbol").filter(F.col("file_id") == file_id(F.lit(path))).orderBy("start_line", "end_line", "id")

    def file_outline(self, path: str) -> DataFrame:
        return self.table("chunk").filter((F.col("file_id") == file_id(F.lit(path))) & (F.col("kind") == "file_outline")).limit(1)

    def sync_vault(self, folder: str, out: str, kind_from_folder: bool = False) -> None:
        """Takes in the notes of a folder, keeping the vectors of memories whose text hasn't changed, and writes all notes."""
        old = self.table("memory_record")
        seen = read_vault(self.spark, folder, kind_from_folder).filter(F.col("id").isNotNull()).withColumnRenamed("created", "created_at").dropDuplicates(["id"])
        kept = old.select("id", F.col("content").alias("_was"), "embedding", "project_id", "session_id", "confidence", "source_hash", "superseded_by", "valid_until")
        new = seen.join(kept, "id", "left").withColumn("embedding", F.when(F.col("_was") == F.col("content"), F.col("embedding"))).drop("_was")
        self.upsert("memory_record", new)
        write_vault(self.table("memory_record"), out)

    def delete_files(self, gone: DataFrame) -> None:
        """Files (``id, relative_path``) with their symbols, chunks, calls, imports, sections and references."""
        symbols = self.table("symbol").join(gone.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        sections = self.table("doc_section").join(gone.select(F.col("relative_path").alias("file_path")), "file_path", "left_semi")
        dead = symbols.select("id")
        after = {
            "chunk": delta.without(self.table("chunk"), F.col("file_id"), gone, "id"),
            "imports": delta.without(self.table("imports"), F.col("file_id"), gone, "id"),
            "calls": delta.without(self.table("calls"), F.col("caller_id"), dead, "id"),
            "doc_reference": delta.without(delta.without(self.table("doc_reference"), F.col("symbol_id"), dead, "id"), F.col("doc_section_id"), sections, "id"),
            "doc_section": delta.without(self.table("doc_section"), F.col("file_path"), gone, "relative_path"),
            "symbol": delta.without(self.table("symbol"), F.col("file_id"), gone, "id"),
            "file": delta.without(self.table("file"), F.col("id"), gone, "id"),
        }
        for name, df in after.items():
            self.replace(name, df)

    def mark_stale(self, paths: DataFrame) -> int:
        """Models that refer to one of the paths (``path``) become stale; how many weren't before."""
        models = self.table("mental_model")
        hit = models.select("topic", F.explode("referenced_files").alias("path")).join(paths, "path", "left_semi").select("topic").distinct().withColumn("hit", F.lit(True))
        marked = models.join(hit, "topic", "left")
        n = marked.filter(F.col("hit") & ~F.coalesce("is_stale", F.lit(False))).count()
        self.replace("mental_model", marked.withColumn("is_stale", F.coalesce("hit", F.lit(False)) | F.coalesce("is_stale", F.lit(False))).drop("hit"))
        return n

    # ---- memories

    def remember(self, content: str, embedding: list[float] | None = None, kind: str = "fact", title: str | None = None, tags: list[str] | None = None, at=None, project: str = "", resolve: bool = False, threshold: float = 0.85, **more) -> tuple[str, list[str]]:
        """Adds a memory; its id and those of active ones of its kind it contradicts: of the five nearest by vector those at or
        above the threshold with opposed wording. With ``resolve`` these are superseded by it; their vectors stay."""
        new = {"id": f"mem_{uuid.uuid4().hex}", "project_id": project, "kind": kind, "title": title or content.split("\n")[0][:60], "content": content, "tags": tags or [], "status": "active", "confidence": 1.0, "embedding": embedding, "created_at": at, **more}
        row = self.spark.createDataFrame([tuple(new.get(f.name) for f in SCHEMAS["memory_record"])], SCHEMAS["memory_record"])
        old = self.table("memory_record")
        against: list[str] = []
        if embedding:
            against = sorted(r.id for r in self.near(embedding, kind, threshold).filter(is_conflict("content", F.lit(content))).select("id").collect())  # five at most
        if resolve and against:
            hit = F.col("id").isin(against)
            end = lambda c, v: F.when(hit, v).otherwise(F.col(c)).alias(c)
            changed = {"status": F.lit("superseded"), "superseded_by": F.lit(new["id"]), "valid_until": F.lit(at).cast("timestamp")}
            old = old.select(*[end(c, changed[c]) if c in changed else F.col(c) for c in old.columns])
        self.replace("memory_record", old.unionByName(row))
        return new["id"], against

    def near(self, embedding: list[float], kind: str, threshold: float, k: int = 5) -> DataFrame:
        """Of the k active memories of a kind that are nearest to a vector those at or above a similarity, with their score."""
        vector = F.array(*[F.lit(float(v)) for v in embedding])
        own = self.table("memory_record").filter((F.col("status") == "active") & (F.col("kind") == kind) & F.col("embedding").isNotNull())
        return own.withColumn("score", cosine("embedding", vector)).orderBy(F.desc("score"), "id").limit(k).filter(F.col("score") >= threshold)

    def recall(self, limit: int = 5, **how) -> DataFrame:
        return search.recall(self.table("memory_record"), "id", limit, **how)

    def rules(self) -> DataFrame:
        return search.active_rules(self.table("memory_record"), "id")

    def standing_model(self, embedding: list[float]) -> DataFrame:
        """Of the three models nearest to a question the nearest that isn't stale; nothing if all are."""
        scored = self.table("mental_model").filter(F.col("embedding").isNotNull()).withColumn("score", cosine("embedding", F.array(*[F.lit(float(v)) for v in embedding])))
        return scored.orderBy(F.desc("score"), "id").limit(3).filter(~F.coalesce("is_stale", F.lit(False))).orderBy(F.desc("score"), "id").limit(1)

    def crates(self, embedding: list[float], k: int) -> DataFrame:
        scored = self.table("crate_catalog").filter(F.col("embedding").isNotNull()).withColumn("score", cosine("embedding", F.array(*[F.lit(float(v)) for v in embedding])))
        return scored.orderBy(F.desc("score"), "crate_name").limit(k)

    def counts(self) -> dict[str, int]:
        return {t: self.table(t).count() for t in ("file", "symbol", "chunk")}

    # ---- bundles

    def export_bundle(self, folder: str) -> None:
        """Every table as JSON lines, with a manifest of version and tables."""
        for name in SCHEMAS:
            self.table(name).write.mode("overwrite").json(f"{folder}/{name}")
        manifest = self.spark.createDataFrame([(json.dumps({"version": VERSION, "tables": sorted(SCHEMAS)}),)], "value string")
        manifest.coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")

    def import_bundle(self, folder: str) -> None:
        """Upserts all tables of a bundle; a bundle of another version is refused. Rows that aren't valid are left out."""
        said = json.loads(self.spark.read.text(f"{folder}/manifest").first().value)
        if said.get("version") != VERSION:
            raise ValueError(f"bundle version {said.get('version')}, not {VERSION}")
        for name in said["tables"]:
            rows = self.spark.read.schema(SCHEMAS[name]).option("mode", "DROPMALFORMED").json(f"{folder}/{name}")
            self.upsert(name, rows)
