"""Hybrid, hierarchical and memory search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadstone.functions.vectors import cosine
from threadstone.operators import textual
from threadstone.operators import vectors as VO

# The weights of the hybrid score and its cut.
VECTOR_WEIGHT, NAME_BOOST, OUTLINE_BOOST, TEXT_BOOST, SCORE_CUT = 0.7, 0.5, 0.3, 0.2, 0.05
# Confidences of a hierarchical match.
EXACT, NAME, QUALIFIED, SUMMARY, BREADCRUMB = 1.0, 0.8, 0.7, 0.5, 0.4


def has(column: str, text: str) -> Column:
    """Whether a column contains a text, whatever the case; false for null. No wildcards."""
    return F.coalesce(F.lower(column).contains(text.lower()), F.lit(False))


def hybrid(df: DataFrame, key: str, embedding: str, query: Column, text: str, limit: int, name: str, outline: str, body: str, candidates: int | None = 10) -> DataFrame:
    """Vector candidates with substring boosts: ``<key>, score, <name>``.

    The ``max(limit, candidates)`` rows nearest to the query are rescored as 0.7 cosine + 0.5 if the name contains the text,
    0.3 if the outline, 0.2 if the body; scores above 0.05, or all if the text is empty, are sorted and cut to the limit. With
    ``candidates=None`` all rows are rescored. Rows without a vector have cosine 0 and come last among candidates.
    """
    scored = df.select(key, name, outline, body, cosine(embedding, query).alias("cos"))
    if candidates is not None:
        scored = scored.orderBy(F.desc("cos"), key).limit(max(limit, candidates))
    score = F.lit(VECTOR_WEIGHT) * F.col("cos")
    if text:
        for c, boost in ((name, NAME_BOOST), (outline, OUTLINE_BOOST), (body, TEXT_BOOST)):
            score = score + F.when(has(c, text), boost).otherwise(0.0)
    ranked = scored.select(key, score.alias("score"), name)
    if text:
        ranked = ranked.filter(F.col("score") > SCORE_CUT)
    return ranked.orderBy(F.desc("score"), key).limit(limit)


def nearest(rows: DataFrame, queries: DataFrame, key: str, embedding: str, k: int, dim: int) -> DataFrame:
    """The k nearest rows of every query, as `vectors.search`, but rows without a usable vector count too, with cosine 0:
    ``query_id, rank, <key>, score``. ``queries``: ``query_id, embedding``."""
    q = queries.select(F.col("query_id").alias(key), F.col("embedding").alias(embedding))
    near = VO.search(rows.select(key, embedding), q, key, embedding, k, dim).select("query_id", key, "score")
    none = rows.filter(F.coalesce(F.size(embedding), F.lit(-1)) != dim).select(key).orderBy(key).limit(k)
    rest = queries.filter(F.size("embedding") == dim).select("query_id").join(F.broadcast(none), F.lit(True)).withColumn("score", F.lit(0.0))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return near.unionByName(rest).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")


def hybrid_many(df: DataFrame, queries: DataFrame, key: str, embedding: str, limit: int, name: str, outline: str, body: str, dim: int, candidates: int | None = 10) -> DataFrame:
    """`hybrid` for many queries at once: ``query_id, rank, <key>, score, <name>``. ``queries``: ``query_id, embedding, word``, the words
    of at least three word characters.

    The vector lists come from blocks of queries against parts of the rows, the boosts from the distinct words against the
    distinct words of the texts. Without candidates a row outside of a query's vector list can only come in by a boost; so
    the cosines that are needed besides are those of the rows that hold its word.
    """
    near = nearest(df, queries, key, embedding, max(limit, candidates or 0), dim).select("query_id", key, F.col("score").alias("cos"))
    words = queries.select("query_id", "word")
    held = None
    for c, boost in ((name, NAME_BOOST), (outline, OUTLINE_BOOST), (body, TEXT_BOOST)):
        one = textual.mentions(df, key, [c], words.select("word").distinct(), "word").withColumn("boost", F.lit(boost))
        held = one if held is None else held.unionByName(one)
    held = held.groupBy("word", key).agg(F.sum("boost").alias("boost"))
    if candidates is None:
        more = words.join(held, "word").select("query_id", key).join(near, ["query_id", key], "left_anti")
        v = queries.filter(F.size("embedding") == dim).select("query_id", F.col("embedding").alias("_q"))
        more = more.join(v, "query_id").join(df.select(key, embedding), key).select("query_id", key, cosine(embedding, "_q").alias("cos"))
        near = near.unionByName(more)
    scored = near.join(words, "query_id").join(held, ["word", key], "left").withColumn("score", F.lit(VECTOR_WEIGHT) * F.col("cos") + F.coalesce("boost", F.lit(0.0)))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    best = scored.filter(F.col("score") > SCORE_CUT).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)
    return best.join(df.select(key, name), key).select("query_id", "rank", key, "score", name)


def hierarchical(symbols: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """Symbols by how they match: exact name 1.0, in the name 0.8, the qualified name 0.7, the summary 0.5, a breadcrumb 0.4.
    With the outermost breadcrumb as parent and the summary as body. An empty text matches every name."""
    q = text.lower()
    crumb = F.coalesce(F.exists("breadcrumbs", lambda b: F.lower(b).contains(q)), F.lit(False))
    confidence = (
        F.when(F.lower("name") == q, EXACT).when(has("name", q), NAME).when(has("qualified_name", q), QUALIFIED).when(has("summary", q), SUMMARY).when(crumb, BREADCRUMB)
    )
    hits = symbols.select(
        key, "name", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), confidence.alias("confidence"),
        F.coalesce(F.try_element_at("breadcrumbs", F.lit(1)), F.lit("")).alias("macro_parent"), F.coalesce("summary", F.lit("")).alias("body"),
    ).filter(F.col("confidence").isNotNull())
    return hits.orderBy(F.desc("confidence"), key).limit(limit)


def valid_at(t, created: str = "created_at", until: str = "valid_until") -> Column:
    """Whether a row holds at a time: from its creation on, up to but not at its end; without an end for ever."""
    return (F.col(created) <= t) & (F.col(until).isNull() | (F.col(until) > t))


def recall(
    memories: DataFrame, key: str, limit: int, kind: str | None = None, tags: list[str] | None = None, as_of=None, query: Column | None = None, embedding: str = "embedding"
) -> DataFrame:
    """Memories by kind, any of the tags, and state: active ones, or instead those valid at ``as_of`` whatever their status.
    Nearest to the query first, else newest first; rows without a vector or time come last; ties by key."""
    out = memories.filter(valid_at(as_of)) if as_of is not None else memories.filter(F.col("status") == "active")
    if kind:
        out = out.filter(F.col("kind") == kind)
    if tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    order = [cosine(embedding, query).desc()] if query is not None else [F.desc_nulls_last("created_at")]
    return out.orderBy(*order, key).limit(limit)


# Kinds that govern.
GOVERNING = ["instruction", "decision", "preference", "fact"]


def active_rules(memories: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The newest active memories of governing kinds."""
    return memories.filter((F.col("status") == "active") & F.col("kind").isin(*GOVERNING)).orderBy(F.desc_nulls_last("created_at"), key).limit(limit)


# Rank fusion.
RRF_K = 60
RRF_WEIGHTS = {"vector": 0.35, "lexical": 0.35, "graph": 0.20, "temporal": 0.10}


def ranked(df: DataFrame, stream: str, key: str, order: list, limit: int, by: list[str] | None = None) -> DataFrame:
    """The leading rows of a stream with their ranks: ``stream, key, rank``. The rank window sees ``limit`` rows only. With ``by``, those
    of each group, the group first."""
    if by:
        top = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= limit)
        return top.select(*by, F.lit(stream).alias("stream"), F.col(key).alias("key"), "rank")
    top = df.orderBy(*order).limit(limit)
    return top.select(F.lit(stream).alias("stream"), F.col(key).alias("key"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(streams: list[DataFrame], k: int = RRF_K, weights: dict[str, float] | None = None, by: list[str] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion: ``key, score`` and a rank column per stream, of each ``by`` group for itself. A stream adds ``weight / (k + rank)``; of a
    key's several ranks in one stream the worst counts. Empty streams add nothing. One aggregation over all streams."""
    w = weights or RRF_WEIGHTS
    rows = streams[0]
    for s in streams[1:]:
        rows = rows.unionByName(s)
    wide = rows.groupBy(*(by or []), "key").agg(*[F.max(F.when(F.col("stream") == s, F.col("rank"))).alias(f"{s}_rank") for s in w])
    score = sum((F.coalesce(F.lit(x) / (F.lit(k) + F.col(f"{s}_rank")), F.lit(0.0)) for s, x in w.items()), F.lit(0.0))
    return wide.withColumn("score", score)
