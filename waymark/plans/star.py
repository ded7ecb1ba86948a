"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.plans.checkpoints import discard, materialise


#: Nodes broadcast at most: twice so many, those with 1/HOT_NODES of all links or more.
HOT_NODES, LEAST_HOT = 4096, 4096


def with_lowest(rows: DataFrame, low: DataFrame, hot: int | None) -> DataFrame:
    """rows (u, v) with m of low (u, m, n) on u, however many rows a u has: where nodes of
    `hot` rows or more are known to be there, those, of which `hot` allows few, are broadcast
    and the rest is joined by sort-merge, where no node has many."""
    if hot is None:
        return rows.join(low.select("u", "m"), "u")
    large, rest = F.broadcast(low.where(F.col("n") >= hot).select("u", "m")), low.where(F.col("n") < hot).select("u", "m")
    return rows.join(large, "u").unionByName(rows.join(large.select("u"), "u", "left_anti").join(rest, "u"))


def star_components(links: DataFrame) -> DataFrame:
    """node, root for all nodes of links (a, b) but the roots themselves; a root is the
    smallest node of its component. Nodes can be of any type that compares.

    Each round links every node's larger neighbours to its smallest one (large star), then
    its smaller neighbours and itself (small star), until no link changes: the number of
    rounds grows with the logarithm of a component's length. A round is written to the
    shared folder and the one before it deleted.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, mark = materialise(edges, "star"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total, most = both.groupBy("u").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        hot = max(LEAST_HOT, -(-total // HOT_NODES))
        hot = hot if most >= hot else None
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = with_lowest(both.where("v > u"), low, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_lowest(large, low, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(small.distinct(), "star")
        discard(before)
        new = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            roots.scratch = edges.scratch
            return roots
        mark = new
