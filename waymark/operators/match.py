"""Distance joins and matching without cross joins: points are bucketed in cells of the
search distance and meet in their own and neighbouring cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.plans.checkpoints import discard, materialise


def pairs_within(a: DataFrame, b: DataFrame, distance: float) -> DataFrame:
    """Pairs of a (a_id, ax, ay) and b (b_id, bx, by) that lie within distance."""
    cell = lambda c: F.floor(F.col(c) / distance).cast("long")
    left = a.withColumn("cx", cell("ax")).withColumn("cy", cell("ay"))
    near = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: i)
    right = b.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    right = right.withColumn("cx", cell("bx") + F.col("dx")).withColumn("cy", cell("by") + F.col("dy")).drop("dx", "dy")
    d = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    return left.join(right, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= distance).drop("cx", "cy")


def nearest(pairs: DataFrame) -> DataFrame:
    """Nearest b of each a; the first id where distances tie."""
    return pairs.groupBy("a_id").agg(F.min(F.struct("distance", "b_id")).alias("m")).select("a_id", F.col("m.b_id").alias("b_id"), F.col("m.distance").alias("distance"))


def mutual_nearest(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest."""
    back = pairs.groupBy("b_id").agg(F.min(F.struct("distance", "a_id")).alias("m")).select("b_id", F.col("m.a_id").alias("a_id"))
    return nearest(pairs).join(back, ["a_id", "b_id"])


def local_best(pairs: DataFrame, slack: float) -> DataFrame:
    """Pairs no farther than `slack` beyond the best of either side."""
    best = lambda side: F.min("distance").over(Window.partitionBy(side)) + slack
    return pairs.withColumn("_a", best("a_id")).withColumn("_b", best("b_id")).where("distance <= _a AND distance <= _b").drop("_a", "_b")


def ambiguous(pairs: DataFrame, margin: float) -> DataFrame:
    """Per a: its nearest distance, the runner-up's, and whether they are within margin."""
    w = Window.partitionBy("a_id").orderBy("distance", "b_id")
    ranked = pairs.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return ranked.groupBy("a_id").agg(F.min("distance").alias("best"), F.max(F.when(F.col("r") == 2, F.col("distance"))).alias("runner_up")).withColumn("ambiguous", F.coalesce(F.col("runner_up") - F.col("best") <= margin, F.lit(False)))


def greedy_one_to_one(pairs: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """One-to-one matching by ascending (distance, a_id, b_id), in rounds: a pair that is the
    first of both its sides is taken, as the sequential choice takes it, and the pairs of
    either side go. The first pair of all is such a one, so rounds end; no task holds a
    connected part. components, which that needed, isn't read."""
    order = F.min(F.struct("distance", "a_id", "b_id")).alias("m")
    left, taken = materialise(pairs.select(F.col("a_id").cast("long").alias("a_id"), F.col("b_id").cast("long").alias("b_id"), "distance"), "greedy"), []
    while not left.isEmpty():
        first = left.groupBy("a_id").agg(order).select("m.*")
        taken.append(materialise(first.join(left.groupBy("b_id").agg(order).select("m.a_id", "m.b_id"), ["a_id", "b_id"], "left_semi"), "greedy-taken"))
        rest = left.join(taken[-1].select("a_id"), "a_id", "left_anti").join(taken[-1].select("b_id"), "b_id", "left_anti")
        before, left = left, materialise(rest.select("a_id", "b_id", "distance"), "greedy")
        discard(before)
    out = left
    for t in taken:
        out = out.unionByName(t)
    return out.select("a_id", "b_id", "distance")
