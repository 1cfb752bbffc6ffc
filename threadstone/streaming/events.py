"""Structured Streaming: change events of files, windows over events, and the read guard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadstone.operators.hygiene import read_guard
from threadstone.session import Workspace


def read_events(spark: SparkSession, base: str, name: str = "events") -> DataFrame:
    """A table as a stream of its files; ``ts`` as a timestamp with zone, as watermarks need."""
    path = f"{base}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder, glob = (path, "*") if spark.read.parquet(path).inputFiles()[0].rstrip("/") != f"file://{path}" else (base, f"{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def read_changes(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table as a stream of its files, as it is."""
    path = f"{base}/{name}.parquet"
    seen = spark.read.parquet(path)
    folder, glob = (path, "*") if seen.inputFiles()[0].rstrip("/") != f"file://{path}" else (base, f"{name}.parquet")
    return spark.readStream.schema(seen.schema).option("pathGlobFilter", glob).parquet(folder)


def apply_changes(stream: DataFrame, path: str, at, apply: Callable[[DataFrame, int], None], label: str) -> None:
    """Runs a stream of changes over what is there now: of each path's events in a batch the last by ``at`` counts."""
    ws = Workspace(stream.sparkSession, label)

    def batch(df: DataFrame, no: int) -> None:
        apply(df.withColumn("_at", at).groupBy(path).agg(F.max_by(F.struct("*"), "_at").alias("x")).select("x.*").drop("_at"), no)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", ws.path("checkpoint")).trigger(availableNow=True).start().awaitTermination()


def run_to_table(stream: DataFrame, label: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there now into a table in the shared folder and reads it. A batch that is written again
    after a failure replaces what it had written; complete results replace each other; of updates the last of each key counts."""
    spark = stream.sparkSession
    ws = Workspace(spark, label)

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(ws.path(f"out/batch={0 if mode == 'complete' else no}"))

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", ws.path("checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(ws.path("out"))
    if mode == "update":
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("x")).select("x.*")
    return out.select(*stream.columns)


def windowed_counts(events: DataFrame, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and their summed value per key and tumbling window."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), key)  # in update mode state goes when the watermark passes
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("window_start"), key, "n", "value")


def distinct_within(events: DataFrame, keys: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The distinct values of the keys in each tumbling window: ``window_start, <keys>``. State is kept until the watermark passes the
    window's end, so it doesn't grow with the stream."""
    timed = events.withWatermark("ts", late).select(F.window("ts", width).alias("window"), *keys)
    return timed.dropDuplicates(["window", *keys]).select(F.col("window.start").alias("window_start"), *keys)


def sessions(events: DataFrame, key: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Rows per key and session: a session ends when a gap passes without rows."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    return by.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), key, "n")


def guard_to_table(events: DataFrame, session: list[str], label: str = "guard") -> DataFrame:
    """Runs a stream of reads (``event_id, ts, <session>, content``) through the read guard: ``event_id, suppressed, count``.

    Of each session and path one row crosses from batch to batch: the last content, and how often in a row it was read. Inside a
    batch rows are ordered by stretches of time (`operators.ordered`), so a hot path is no single task's. Reads that come in a
    later batch count as later than all of an earlier one, whatever their time. A batch that is run again starts from the state
    that the one before it left, and replaces what it had written.
    """
    spark = events.sparkSession
    ws = Workspace(spark, label)
    columns = ["event_id", "ts", *session, "content"]
    key = [F.col(c) for c in session]

    def batch(df: DataFrame, no: int) -> None:
        rows = df.select(*columns, F.lit(0).cast("long").alias("n"))
        old = spark.read.parquet(ws.path(f"state/{no - 1}")) if no else None
        if old is not None:  # the row before the first: it has no time, which puts it first
            known = old.join(rows.select(*session).distinct(), session, "left_semi")
            rows = rows.unionByName(known.withColumn("ts", F.lit(None).cast("timestamp")).withColumn("event_id", F.lit(None).cast("long")))
        done = read_guard(rows, session, "content", "ts", "event_id")
        if old is None:
            done = done.withColumn("total", F.col("count"))
        else:
            # reads before the first shown one go on with the run of the batches before: a row per session
            place = F.struct("ts", "event_id")
            first = done.filter("event_id IS NOT NULL AND NOT suppressed").groupBy(*session).agg(F.min(place).alias("shown"))
            done = done.join(first, session, "left").join(old.select(*session, F.col("n").alias("had")), session, "left")
            goes_on = F.col("had").isNotNull() & (F.col("shown").isNull() | (place < F.col("shown")))
            done = done.withColumn("total", F.col("count") + F.when(goes_on, F.col("had") - 1).otherwise(0)).filter("event_id IS NOT NULL")
        done = ws.cut(done.select(*columns, "suppressed", F.col("total").cast("long").alias("count")), f"decided/{no}")
        done.select("event_id", "suppressed", "count").write.mode("overwrite").parquet(ws.path(f"out/batch={no}"))
        last = done.groupBy(*key).agg(F.max_by(F.struct("content", F.col("count").alias("n")), F.struct("ts", "event_id")).alias("x")).select(*session, "x.*")
        if old is not None:
            last = last.unionByName(old.join(last.select(*session), session, "left_anti"))
        last.write.mode("overwrite").parquet(ws.path(f"state/{no}"))

    events.writeStream.foreachBatch(batch).option("checkpointLocation", ws.path("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, suppressed boolean, count long").parquet(ws.path("out")).select("event_id", "suppressed", "count")


def watch(stream: DataFrame, path: str, content: str, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "300 milliseconds"):
    """Change events of files, in batches: of each path's events in a batch the last one counts, and `apply` purges and
    replaces what it indexes. An event whose content is the path's current one has to be left out by `apply`'s own merge, as
    changes back and forth must not be lost."""

    def batch(df: DataFrame, no: int) -> None:
        last = df.groupBy(path).agg(F.max_by(F.struct("*"), "ts").alias("x")).select("x.*")
        apply(last.filter(F.col(content).isNotNull()), no)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
