"""Queries of the operators for training data, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadstone.llm import docpairs, mixing, reading_level, secrets, tokenizer
from threadstone.functions.ids import canonical_id
from threadstone.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.extract(table(spark, d, "source_texts")).select("source_id", "start_line", "name").distinct()


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.extract(table(spark, d, "source_texts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), "start_char", "end_char")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its credentials blacked out, once per content of its row."""
    chunks = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "text").distinct()
    return secrets.redacted(chunks).select("chunk_id", "redacted", "n_found")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Credentials per project, kind and state of the project's secret scan."""
    found = secrets.scan(table(spark, d, "chunks"))
    latest = F.max_by("project_id", F.struct(F.col("last_indexed_at"), "project_id"))
    files = table(spark, d, "files").groupBy(canonical_id("id").alias("file_id")).agg(latest.alias("project_id"))
    chunks = table(spark, d, "chunks").select("id", canonical_id("file_id").alias("file_id")).distinct()
    projects = table(spark, d, "project_manifests").select("project_id", F.coalesce("secrets_scan", F.lit(False)).alias("secrets_scan"))
    owned = found.join(chunks, "id").join(files, "file_id", "left").join(projects, "project_id", "left")
    return owned.groupBy("project_id", "secrets_scan", "kind").agg(F.count(F.lit(1)).alias("n_credentials"), F.countDistinct("id").alias("n_chunks"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents").select("doc_id", "text"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents, characters and tokens by source and format."""
    docs = table(spark, d, "documents").select(mixing.source_name("source").alias("source"), "doc_format", "n_chars", "text")
    sized = tokenizer.count_tokens(docs)
    return sized.groupBy("source", "doc_format").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most_tokens")
    )


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = tokenizer.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"))
    return mixing.mix(sized, table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = reading_level.eligible(table(spark, d, "documents"))
    return reading_level.predict(docs, reading_level.fit(docs, table(spark, d, "level_labels")))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source and level."""
    docs = table(spark, d, "documents").select("doc_id", mixing.source_name("source").alias("source"))
    return p8_found(spark, d).join(docs, "doc_id").groupBy("source", "level").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p4_report": p4_report,
    "p6_ids": p6_ids,
    "p6_counts": p6_counts,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_profile": p8_profile,
}

SQL: dict[str, str] = {}
