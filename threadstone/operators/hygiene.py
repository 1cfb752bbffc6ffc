"""Token bookkeeping, condensed logs, repeated reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadstone.functions.text import lines
from threadstone.operators.ordered import neighbours, since_start


def token_map(files: DataFrame, path: str, tokens: str) -> DataFrame:
    """Tokens by folder: ``folder, tokens, pct, kb``; ``.`` for the root. The share is over all folders, to one decimal."""
    folder = F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1)
    sums = files.groupBy(F.when(folder == "", ".").otherwise(folder).alias("folder")).agg(F.sum(tokens).alias("tokens"))
    total = sums.agg(F.sum("tokens").alias("_total"))  # one row
    pct = F.when(F.col("_total") > 0, F.round(F.lit(100.0) * F.col("tokens") / F.col("_total"), 1)).otherwise(0.0)
    return sums.join(F.broadcast(total), F.lit(True)).select("folder", "tokens", pct.alias("pct"), (F.col("tokens") * 4 / 1024).alias("kb"))


def ledger_totals(usage: DataFrame) -> DataFrame:
    """Sums of ``input_tokens, output_tokens, cached_tokens`` and the cost at the given rates."""
    nz = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = usage.agg(nz("input_tokens"), nz("output_tokens"), nz("cached_tokens"))
    return sums.withColumn("cost", F.col("input_tokens") * F.lit(5e-7) + F.col("output_tokens") * F.lit(1.5e-6))


def ledger_by_category(savings: DataFrame) -> DataFrame:
    """``category, saved_bytes, saved_tokens``; a saving's tokens are a quarter of its bytes, rounded down."""
    tokens = F.floor(F.coalesce("saved_bytes", F.lit(0)) / 4).cast("long")
    return savings.groupBy("category").agg(F.sum(F.coalesce("saved_bytes", F.lit(0))).alias("saved_bytes"), F.sum(tokens).alias("saved_tokens"))


# What makes a log line a highlight, and how much of a log is kept.
HIGHLIGHTS = ["error:", "failed", "failure", "panic", "warning:", "exception"]
SHOWN, HEAD, TAIL = 40, 15, 15


def condense(text: str, exit_code: Column, threshold: int = 4096, highlights: list[str] | None = None) -> list[Column]:
    """Columns ``mode, n_lines, n_highlights, condensed``: short logs of successful commands pass through; of others the
    highlighted lines (40 at most) are kept, else the first and last 15 lines. Null texts count as empty."""
    t = F.coalesce(text, F.lit(""))
    all_lines = lines(t)
    hit = F.filter(all_lines, lambda x: F.exists(F.array(*[F.lit(h) for h in highlights or HIGHLIGHTS]), lambda h: F.lower(x).contains(h)))
    short = (F.octet_length(t) <= threshold) & (exit_code == 0)
    n = F.size(all_lines)
    head, tail = F.array_join(F.slice(all_lines, 1, HEAD), "\n"), F.array_join(F.slice(all_lines, F.greatest(n - TAIL + 1, F.lit(1)), TAIL), "\n")
    ends = F.concat(head, F.format_string("\n\n[... %d lines condensed ...]\n\n", F.greatest(n - HEAD - TAIL, F.lit(0))), tail)
    found = F.concat(F.format_string("Key error/warning highlights (%d total found):\n", F.size(hit)), F.array_join(F.slice(hit, 1, SHOWN), "\n"))
    mode = F.when(short, "passthrough").when(F.size(hit) > 0, "highlights").otherwise("head_tail")
    body = F.when(short, t).when(F.size(hit) > 0, found).otherwise(ends)
    return [mode.alias("mode"), n.alias("n_lines"), F.size(hit).alias("n_highlights"), body.alias("condensed")]


def frame(stdout: str, stderr: str) -> Column:
    """Both outputs of a command as one text."""
    return F.concat(F.lit("STDOUT:\n"), F.coalesce(stdout, F.lit("")), F.lit("\n\nSTDERR:\n"), F.coalesce(stderr, F.lit("")))


def cached_logs(df: DataFrame, text: str, epoch: str, exit_code: Column, threshold: int = 4096) -> DataFrame:
    """Logs that a condenser doesn't pass through, with the name under which their raw text is kept: df, ``cache_file, raw``."""
    t = F.coalesce(text, F.lit(""))
    name = F.concat(F.col(epoch).cast("string"), F.lit("-"), F.substring(F.sha2(t, 256), 1, 8), F.lit(".log"))
    return df.filter(~((F.octet_length(t) <= threshold) & (exit_code == 0))).withColumn("cache_file", name).withColumn("raw", t)


def read_guard(reads: DataFrame, session: list[str], content: str, at: str, tie: str, forced: Column | None = None) -> DataFrame:
    """Repeated reads: adds ``suppressed`` (the same content as this session's last read of the path, and not forced), ``count``
    (how often in a row that content was read since it was last shown) and ``is_first``. In the order of time, equal times by
    the tie-breaker. Null contents equal each other."""
    near = neighbours(reads.withColumn("_forced", forced if forced is not None else F.lit(False)), session, at, tie, [content])
    same = F.col("_near.there") & F.col(f"_near.{content}").eqNullSafe(F.col(content)) & ~F.col("_forced")
    df = near.withColumn("suppressed", same).withColumn("is_first", ~F.col("_near.there")).withColumn("_shown", ~F.col("suppressed"))
    return since_start(df, session, "_shown", "count").drop("_near", "_forced", "_shown", "_at", "_tie", "_stretch")
