"""Job state: specification diffs, affected pairs, upserts and keyed look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spec_diff(prior: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """added, removed or changed keys by fingerprint."""
    j = prior.withColumnRenamed("fingerprint", "was").join(current.withColumnRenamed("fingerprint", "now"), keys, "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return j.select(*keys, kind.alias("change")).where("change IS NOT NULL")


def affected_pairs(pairs: DataFrame, changed: DataFrame) -> DataFrame:
    """Pairs (before, after) that hold a changed period."""
    c = changed.select("period").distinct()
    hit = pairs.join(c, F.col("before") == F.col("period"), "left_semi").unionByName(pairs.join(c, F.col("after") == F.col("period"), "left_semi"))
    return hit.distinct()


def upsert(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of the same key; the rest stays."""
    return held.join(new.select(*keys), keys, "left_anti").unionByName(new)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def wildcard_lookup(rows: DataFrame, table: DataFrame, key: str, fallback: str, value: str, wildcard: str = "") -> DataFrame:
    """value of table by (key, fallback), else by (wildcard, fallback)."""
    own = table.where(F.col(key) != wildcard).select(key, fallback, F.col(value).alias("_own"))
    any_ = table.where(F.col(key) == wildcard).select(fallback, F.col(value).alias("_any"))
    return rows.join(own, [key, fallback], "left").join(any_, fallback, "left").withColumn(value, F.coalesce("_own", "_any")).drop("_own", "_any")
