"""Tables and the views that bind the operators to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity x period status table from events: two or more events of a day are present,
    one is uncertain, none is absent; width is the mean value."""
    e = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("period"), F.col("value").cast("decimal(18,6)").alias("value"))
    daily = e.groupBy("user_id", "period").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    # days of the table: as many as the calendar has, whatever the rows
    days = F.broadcast(e.select("period").distinct())
    grid = e.select("user_id").distinct().join(days, how="cross")
    n = F.coalesce("n", F.lit(0).cast("long"))
    status = F.when(n >= 2, "present").when(n == 1, "uncertain").otherwise("absent")
    width = F.col("total").cast("double") / F.col("n")
    return grid.join(daily, ["user_id", "period"], "left").select(F.col("user_id").alias("road_id"), "period", status.alias("status"), width.alias("width_m"), (n / (n + 2)).alias("confidence"))


#: The same view for the SQL side.
OBSERVATIONS_SQL = """
    e AS (SELECT user_id, CAST(ts AS DATE) AS period, CAST(value AS DECIMAL(18,6)) AS value FROM events),
    daily AS (SELECT user_id, period, count(*) AS n, sum(value) AS total FROM e GROUP BY ALL),
    grid AS (SELECT u.user_id, d.period FROM (SELECT DISTINCT user_id FROM e) u, (SELECT DISTINCT period FROM e) d),
    obs AS (SELECT user_id AS road_id, period, CASE WHEN coalesce(n, 0) >= 2 THEN 'present' WHEN n = 1 THEN 'uncertain' ELSE 'absent' END AS status,
                   CAST(total AS DOUBLE) / n AS width_m, coalesce(n, 0) / CAST(coalesce(n, 0) + 2 AS DOUBLE) AS confidence
            FROM grid LEFT JOIN daily USING (user_id, period))"""


def width_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of widths along chains: parts' lines in a total order."""
    rows = load(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_partkey").orderBy("l_shipdate", *[c for c in rows.columns if c not in ("l_partkey", "l_shipdate")])
    grade = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("C")
    return rows.select(F.col("l_partkey").alias("chain_id"), F.row_number().over(order).alias("sample_index"), F.col("l_quantity").alias("width"), F.col("l_extendedprice").alias("support"), grade.alias("grade"))


SAMPLES_SQL = """
    s AS (SELECT l_partkey AS chain_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS sample_index,
                 l_quantity AS width, l_extendedprice AS support, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END AS grade FROM lineitem)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear-reference intervals of an order's lines."""
    start = F.col("l_linenumber") * 10 + F.round(F.col("l_discount") * 100)
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_id"), start.alias("start"), (start + F.col("l_quantity")).alias("end"))


INTERVALS_SQL = "i AS (SELECT l_orderkey AS line_id, l_linenumber * 10 + round(l_discount * 100) AS start, l_linenumber * 10 + round(l_discount * 100) + l_quantity AS \"end\" FROM lineitem)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.get("embedding", F.lit(0)).cast("double") * 100).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 100).alias("y"), "label")


POINTS_SQL = "p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, label FROM embeddings)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-point lines: a point and another one off it, from four places of a vector."""
    at = lambda i, k: F.get("embedding", F.lit(i)).cast("double") * k
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("line_id"), at(0, 100).alias("x1"), at(1, 100).alias("y1"), (at(0, 100) + at(2, 20)).alias("x2"), (at(1, 100) + at(3, 20)).alias("y2"))


def period_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as four periods see them: moved a little, a fifth of them missing."""
    k, p = F.col("line_id"), F.col("period")
    seen = lines(spark, sf_dir).withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(4)))).where((k * 7 + p * 3) % 10 < 8)
    dx, dy = ((k * 13 + p * 29) % 11 - 5) / F.lit(25.0), ((k * 17 + p * 31) % 13 - 6) / F.lit(30.0)
    moved = [(F.col(c) + (dx if c[0] == "x" else dy)).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return seen.select("period", "line_id", *moved, (4 + (k + p * 5) % 7).cast("double").alias("width"))


PERIOD_LINES_SQL = f"""{POINTS_SQL}, ln AS (SELECT vec_id AS line_id, x AS x1, y AS y1, x + CAST(embedding[3] AS DOUBLE) * 20 AS x2, y + CAST(embedding[4] AS DOUBLE) * 20 AS y2 FROM p JOIN embeddings USING (vec_id)),
    sn AS (SELECT *, unnest([1, 2, 3, 4]) AS period FROM ln), jt AS (SELECT *, ((line_id * 13 + period * 29) % 11 - 5) / 25.0e0 AS dx, ((line_id * 17 + period * 31) % 13 - 6) / 30.0e0 AS dy FROM sn WHERE (line_id * 7 + period * 3) % 10 < 8),
    pl AS (SELECT period, line_id, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2, CAST(4 + (line_id + period * 5) % 7 AS DOUBLE) AS width FROM jt)"""
