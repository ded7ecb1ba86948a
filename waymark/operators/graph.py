"""Graph analytics on edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.plans.star import star_components


def undirected(edges: DataFrame) -> DataFrame:
    """Unordered, different edges without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node; a node without edges is its own."""
    roots = star_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def summary(nodes: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Nodes, edges, components, endpoints, isolated and junction nodes, largest component."""
    d = nodes.join(degrees(edges), "node", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    at = lambda c, name: F.count(F.when(c, 1)).alias(name)
    a = d.agg(F.count("*").alias("nodes"), at(F.col("degree") == 1, "endpoints"), at(F.col("degree") == 0, "isolated"), at(F.col("degree") >= 3, "junctions"))
    sizes = parts.groupBy("component").count().agg(F.count("*").alias("components"), F.max("count").alias("largest"))
    e = edges.agg(F.count("*").alias("edges"))
    return a.join(sizes, how="cross").join(e, how="cross")  # one row each
