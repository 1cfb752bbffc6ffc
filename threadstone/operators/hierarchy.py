"""Parent-child rows to full hierarchies by tree contraction.

Each round rakes the leaves and splices out nodes of unary chains, and records what it removed; a round leaves at most a fixed
share of the nodes, so the rounds are logarithmic in their number, however deep the trees. Reversing the rounds gives every
removed node its root, depth and path from nodes that outlived it. What no round can remove is the core of a cycle, shrunk to
a node that is its own parent; everything below it hangs on a cycle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Observation
from pyspark.sql import functions as F

from threadstone.session import Workspace

ROUNDS_AT_MOST = 400  # a guard against errors; 10**12 nodes need under 100


def latest_parent(df: DataFrame, node: Column, parent: Column, at: Column, tie: Column) -> DataFrame:
    """One row ``id, parent`` per node: that of its latest row; of several at one time the one with the largest tie-breaker.
    Rows without a node id are left out; a null time is earlier than any other."""
    return (
        df.select(node.alias("id"), F.struct(at.isNotNull().alias("k"), at.alias("at"), tie.alias("tie"), parent.alias("parent")).alias("v"))
        .filter(F.col("id").isNotNull())
        .groupBy("id").agg(F.max("v").alias("v"))
        .select("id", F.col("v.parent").alias("parent"))
    )


_ROUND = "id string, parent string, w long, via array<string>, top boolean, s long, m long, child string, state string"


def hierarchy(links: DataFrame, with_path: bool = True, with_sizes: bool = False) -> DataFrame:
    """Root, depth and path of every node: ``id, root, depth, path, on_cycle``, and ``n_descendants`` if asked for.

    ``links`` has one row ``id, parent`` per node. A null parent, or one that is no node, makes its node a root of depth 0
    whose path is itself. Nodes on a cycle, their own parent included, or below one: root '', depth -1, path null, on_cycle
    true, 0 descendants. An empty input gives an empty result; other columns are ignored. Rows with a null id are left out; of
    repeated ids the smallest parent counts. ``with_path=False`` saves the paths, whose total length is that of all ancestor
    chains. Sizes are summed while leaves are raked, and handed down spliced chains on the way back: no chain is exploded.
    The rounds run while this is called.
    """
    spark = links.sparkSession
    ws = Workspace(spark, "hierarchy")
    nodes = links.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"))
    # a parent that is no node is none
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("is_node"))
    nodes = ws.cut(nodes.join(known, "parent", "left").select("id", "parent", F.coalesce("is_node", F.lit(False)).alias("linked")), "nodes")
    roots, linked = nodes.filter("not linked").select("id"), nodes.filter("linked")
    # an edge is `top` if its parent is a root
    inner = linked.select(F.col("id").alias("parent"), F.lit(False).alias("top"))
    none = F.array().cast("array<string>")
    rows = linked.join(inner, "parent", "left").select(
        "id", "parent", F.lit(1).cast("long").alias("w"), none.alias("via"), F.coalesce("top", F.lit(True)).alias("top"),
        F.lit(1).cast("long").alias("s"), F.lit(0).cast("long").alias("m"), F.lit("live").alias("state"),
    )

    kept_via = F.col("via") if with_path else none
    tables: list[str] = []
    for turn in range(ROUNDS_AT_MOST):
        # s: nodes that were raked into a node, itself included; m: the same of the nodes spliced out between it and its parent
        is_live = F.col("state") != "raked"
        kids = rows.filter(~F.col("top")).groupBy(F.col("parent").alias("id")).agg(
            F.count_if(is_live).alias("n"), F.min(F.when(is_live, F.col("id"))).alias("only"), F.sum(F.when(is_live, F.col("m"))).alias("only_m"),
            F.sum(F.when(~is_live, F.col("s") + F.col("m"))).alias("gain"),
        )
        state = rows.filter(is_live).drop("state").join(kids, "id", "left").withColumn("s", F.col("s") + F.coalesce("gain", F.lit(0)))
        rank = lambda c: F.xxhash64(F.lit(turn), c)
        splice = (
            (F.col("n") == 1) & (F.col("id") != F.col("parent")) & (rank("id") > rank("only"))
            & (F.col("top") | (rank("id") > rank("parent")))
        )
        state = state.withColumn("splice", F.coalesce(splice, F.lit(False)))
        # the only child of a spliced node takes over its parent
        heir = state.filter("splice").select(
            F.col("only").alias("id"), F.col("parent").alias("up"), F.col("w").alias("up_w"), F.col("top").alias("up_top"), kept_via.alias("up_via"),
            F.col("id").alias("gone"), (F.col("s") + F.col("m")).alias("up_m"),
        )
        out_of = F.when(F.col("splice"), "spliced").when(F.coalesce("n", F.lit(0)) == 0, "raked")
        moved = state.join(heir, "id", "left").select(
            "id", F.coalesce("up", "parent").alias("parent"), (F.col("w") + F.coalesce("up_w", F.lit(0))).alias("w"),
            (F.when(F.col("gone").isNotNull(), F.concat("up_via", F.array("gone"), "via")).otherwise(F.col("via")) if with_path else F.col("via")).alias("via"),
            F.coalesce("up_top", "top").alias("top"),
            F.when(F.col("splice"), F.col("s") + F.col("only_m")).otherwise(F.col("s")).alias("s"), (F.col("m") + F.coalesce("up_m", F.lit(0))).alias("m"),
            F.when(F.col("splice"), F.col("only")).alias("child"),
            out_of.when(F.col("id") == F.coalesce("up", "parent"), "core").otherwise("live").alias("state"),
        )
        seen = Observation()
        name = f"round{turn}"
        out = ws.cut(moved.observe(seen, F.count_if(F.col("state") == "live").alias("live")), name, by=["state"])
        tables.append(name)
        rows = out.filter("state <> 'spliced'").drop("child")
        if not seen.get["live"]:
            break
    else:
        raise RuntimeError("the contraction did not end")

    null = lambda t: F.lit(None).cast(t)
    removed = [spark.read.schema(_ROUND).parquet(ws.path(n)) for n in tables]
    size = F.lit(0).cast("long")
    at_root = roots.select("id", F.col("id").alias("root"), size.alias("depth"), (F.array("id") if with_path else null("array<string>")).alias("path"))
    if with_sizes:
        hung = reduce(DataFrame.unionByName, removed).filter("top and state = 'raked'").groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("s") + F.col("m")).alias("hung"))
        at_root = at_root.join(hung, "id", "left").withColumn("size", F.coalesce("hung", F.lit(0)) + 1).drop("hung")
    else:
        at_root = at_root.withColumn("size", size)
    core = rows.filter("state in ('live', 'core')").select("id", F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), null("array<string>").alias("path"), F.lit(1).cast("long").alias("size"))
    resolved: list[DataFrame] = [ws.cut(core, "core")]
    for name, table in zip(reversed(tables), reversed(removed)):
        gone = table.filter("state in ('raked', 'spliced')")
        later = reduce(DataFrame.unionByName, resolved)
        if with_sizes:
            # below a spliced node hangs its only child, which went in the same round or later
            below = later.select(F.col("id").alias("child"), F.col("size").alias("more"))
            below = below.unionByName(table.filter("state = 'raked'").select(F.col("id").alias("child"), F.col("s").alias("more")))
            spliced = gone.filter("state = 'spliced'").join(below, "child", "left").withColumn("size", F.col("s") + F.coalesce("more", F.lit(0))).drop("more")
            gone = spliced.unionByName(gone.filter("state = 'raked'").withColumn("size", F.col("s")))
        else:
            gone = gone.withColumn("size", size)
        above = later.select(F.col("id").alias("parent"), "root", "depth", "path")
        joined = gone.filter(~F.col("top")).join(above, "parent").select(
            "id", "root", F.when(F.col("depth") < 0, F.col("depth")).otherwise(F.col("depth") + F.col("w")).alias("depth"),
            (F.concat("path", "via", F.array("id")) if with_path else null("array<string>")).alias("path"), "size",
        )
        top = gone.filter("top").select(
            "id", F.col("parent").alias("root"), F.col("w").alias("depth"),
            (F.concat(F.array("parent"), "via", F.array("id")) if with_path else null("array<string>")).alias("path"), "size",
        )
        resolved.append(ws.cut(joined.unionByName(top), f"back-{name}"))
    if not with_sizes:
        ws.drop(*tables)
    everything = reduce(DataFrame.unionByName, [at_root, *resolved]).withColumn("on_cycle", F.col("root") == "")
    if with_sizes:
        everything = everything.withColumn("n_descendants", F.when(F.col("depth") < 0, 0).otherwise(F.col("size") - 1))
    return everything.drop("size")


def descendants(tree: DataFrame) -> DataFrame:
    """All descendants of each node: ``ancestor, descendant, distance``, one row per pair, the node itself left out.
    From the paths of `hierarchy`; nodes on or below a cycle have none. As many rows as the ancestor chains have links."""
    below = tree.filter(F.col("path").isNotNull() & (F.col("depth") > 0))
    return below.select(F.col("id").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "ancestor")).select(
        "ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance")
    )
