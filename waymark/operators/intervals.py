"""Gaps and islands on linear references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(rows: DataFrame, key: str, join: float = 0.05) -> DataFrame:
    """Intervals start..end of a key, merged where one starts by the furthest end before it
    plus `join`; those of 1e-6 or less are dropped."""
    rows = rows.where(F.col("end") - F.col("start") > 1e-6)
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= before + join, 0).otherwise(1)
    island = rows.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def complement(merged: DataFrame, key: str, lengths: DataFrame) -> DataFrame:
    """Gaps that merged intervals leave in 0..length of each key of lengths (key, length)."""
    ends = lengths.select(key, F.col("length").alias("start"), F.col("length").alias("end"))
    clamped = merged.join(lengths, key).select(key, F.greatest("start", F.lit(0.0)).alias("start"), F.least("end", "length").alias("end")).where("end > start")
    w = Window.partitionBy(key).orderBy("start", "end")
    gaps = clamped.unionByName(ends).select(key, F.coalesce(F.lag("end").over(w), F.lit(0.0)).alias("gap_start"), F.col("start").alias("gap_end"))
    return gaps.where("gap_end - gap_start > 1e-6")


def even_samples(rows: DataFrame, length: str, step: float) -> DataFrame:
    """Evenly spaced places on each length: ceil(length / step) + 1 of them, 3 to 101."""
    n = F.least(F.greatest(F.ceil(F.col(length) / step) + 1, F.lit(3)), F.lit(101)).cast("int")
    return rows.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("at", F.col(length) * F.col("k") / (F.col("_n") - 1)).drop("_n")
