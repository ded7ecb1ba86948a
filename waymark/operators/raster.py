"""Tile and pixel operators: mosaics, feathered means, zonal statistics, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels(tiles: DataFrame, width: int) -> DataFrame:
    """(tile_id, row, col, value) of tiles (tile_id, values), row by row."""
    p = tiles.select("tile_id", F.posexplode("values").alias("i", "value"))
    return p.select("tile_id", F.floor(F.col("i") / width).cast("int").alias("row"), (F.col("i") % width).cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def last_wins_mosaic(p: DataFrame, order: str) -> DataFrame:
    """Value of the source with the highest order at each pixel."""
    return p.groupBy("row", "col").agg(F.max_by("value", order).alias("value"))


def feather_weight(row: Column, col: Column, height: int, width: int, reach: float = 256.0) -> Column:
    """clip(distance to the tile's edge / reach, .05, 1)."""
    d = F.least(row + 1, height - row, col + 1, width - col)
    return F.least(F.greatest(d / reach, F.lit(0.05)), F.lit(1.0))


def feathered_mean(p: DataFrame, keys: list[str], height: int, width: int, reach: float) -> DataFrame:
    w = feather_weight(F.col("row"), F.col("col"), height, width, reach)
    return p.withColumn("w", w).groupBy(*keys).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def zonal(p: DataFrame, zone: str) -> DataFrame:
    """Mean, first quartile and pixel count of each zone."""
    return p.groupBy(zone).agg(F.avg("value").alias("mean"), F.percentile("value", 0.25).alias("q25"), F.count("*").alias("n"))


def hysteresis_seeds(p: DataFrame, weak: float, strong: float) -> DataFrame:
    """Pixels above the tile's weak percentile, flagged where above the strong one."""
    q = p.groupBy("tile_id").agg(F.percentile("value", weak).alias("low"), F.percentile("value", strong).alias("high"))
    return p.join(q, "tile_id").where("value >= low").select("tile_id", "row", "col", "value", (F.col("value") >= F.col("high")).alias("strong"))


def local_maxima(p: DataFrame) -> DataFrame:
    """Pixels of their tile's 3x3 neighbourhood that no neighbour exceeds."""
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = p.select("tile_id", F.col("value").alias("near"), "row", "col").withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    near = near.select("tile_id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "near")
    best = near.groupBy("tile_id", "row", "col").agg(F.max("near").alias("best"))
    return p.join(best, ["tile_id", "row", "col"]).where("value >= best").drop("best")


def windows(height: int, width: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Top-left corners of windows that cover a raster; the last ones end at its edge."""
    def starts(n: int) -> list[int]:
        step = max(1, size - 2 * overlap)
        out = list(range(0, max(1, n - size + 1), step))
        return out if out[-1] + size >= n else [*out, max(0, n - size)]

    return [(y, x) for x in starts(width) for y in starts(height)]


def window_starts(extent: Column, size: int, overlap: int) -> Column:
    """The same starts as windows() for one side, as an array."""
    step = max(1, size - 2 * max(0, overlap))
    last = extent - size
    each = F.sequence(F.lit(0), last, F.lit(step))
    return F.when(extent <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(each, F.array(last))))
