"""Masks and pixel regions: pixels are rows (tile_id, row, col, ...) of tiles of one size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.star import star_components

KEY = ("tile_id", "row", "col")


def probability(p: DataFrame) -> DataFrame:
    """Valid values in 0 to 1: null, NaN and inf go; where a tile has any above 1, its values
    count as bytes."""
    good = p.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    top = good.groupBy("tile_id").agg(F.max("value").alias("_top"))
    scaled = F.when(F.col("_top") > 1, F.col("value") / 255.0).otherwise(F.col("value"))
    return good.join(top, "tile_id").withColumn("value", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_top")


def above(p: DataFrame, threshold: float, inclusive: bool = True) -> DataFrame:
    return p.where(F.col("value") >= threshold if inclusive else F.col("value") > threshold)


def _window(p: DataFrame, kernel: int, height: int, width: int) -> DataFrame:
    """Pixels whose kernel window holds a pixel of p, with how many it holds."""
    steps = F.array(*[F.lit(i - kernel // 2) for i in range(kernel)])
    # a pixel is seen from the places whose window reaches it
    spread = p.select(*KEY).withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    seen = spread.select("tile_id", (F.col("row") - F.col("dr")).cast("int").alias("row"), (F.col("col") - F.col("dc")).cast("int").alias("col"))
    inside = (F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)
    return seen.where(inside).groupBy(*KEY).agg(F.count("*").alias("n"))


def dilated(p: DataFrame, kernel: int, height: int, width: int) -> DataFrame:
    return _window(p, kernel, height, width).select(*KEY)


def eroded(p: DataFrame, kernel: int, height: int, width: int) -> DataFrame:
    """Pixels whose whole window, as far as it lies in the tile, is set."""
    reach = lambda c, n: F.least(F.col(c) - kernel // 2 + kernel - 1, F.lit(n - 1)) - F.greatest(F.col(c) - kernel // 2, F.lit(0)) + 1
    return _window(p, kernel, height, width).where(F.col("n") == reach("row", height) * reach("col", width)).select(*KEY)


def regions(p: DataFrame, reach: int = 8) -> DataFrame:
    """p with `region`, the smallest (row, col) of each connected region of pixels; reach: 8
    or 4 neighbours. Regions are components of neighbouring pixels, so none needs one task."""
    at = F.struct(*KEY)
    cells = p.select(*KEY, at.alias("a"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if reach == 8 else [])
    ahead = F.inline(F.array(*[F.struct((F.col("row") + r).cast("int").alias("row"), (F.col("col") + c).cast("int").alias("col")) for r, c in steps]))
    links = cells.select("tile_id", "a", ahead).join(cells.select(*KEY, F.col("a").alias("b")), list(KEY)).select("a", "b")
    roots = star_components(links)
    root = F.coalesce("root", "a")
    return p.withColumn("a", at).join(roots, F.col("a") == F.col("node"), "left").withColumn("region", F.struct(root["row"].alias("row"), root["col"].alias("col"))).drop("a", "node", "root")


def cleaned(p: DataFrame, threshold: float, close: int, open_: int, least: int, height: int, width: int) -> DataFrame:
    """Pixels of a threshold, closed, opened, in regions of `least` pixels or more."""
    m = above(p, threshold).select(*KEY)
    if close > 1:
        m = eroded(dilated(m, close, height, width), close, height, width)
    if open_ > 1:
        m = dilated(eroded(m, open_, height, width), open_, height, width)
    if least <= 0:
        return m
    r = regions(m)
    big = r.groupBy("tile_id", "region").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return r.join(big, ["tile_id", "region"], "left_semi").select(*KEY)


def region_table(p: DataFrame, least: int = 1) -> DataFrame:
    """Per region of pixels: area, box, centre, share of the box, and elongation: the root of
    the ratio of the principal variances (1 for fewer than three pixels)."""
    r = regions(p)
    row, col = F.col("row").cast("double"), F.col("col").cast("double")
    t = r.groupBy("tile_id", "region").agg(
        F.count("*").alias("area"), F.min("row").alias("top"), F.min("col").alias("left"), (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"),
        F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col"), F.var_samp(row).alias("vr"), F.var_samp(col).alias("vc"), F.covar_samp(row, col).alias("cv"),
    ).where(F.col("area") >= least)
    middle, off = (F.col("vr") + F.col("vc")) / 2, F.sqrt(F.pow((F.col("vr") - F.col("vc")) / 2, F.lit(2.0)) + F.col("cv") * F.col("cv"))
    long = F.when(F.col("area") < 3, 1.0).otherwise(F.sqrt(F.greatest(middle + off, F.lit(1e-6)) / F.greatest(middle - off, F.lit(1e-6))))
    return t.withColumn("extent", F.col("area") / (F.col("height") * F.col("width"))).withColumn("elongation", long).drop("vr", "vc", "cv")


def hysteresis(p: DataFrame, weak: float, strong: float, least: int = 12, long: float = 3.0, close: int = 3, height: int = 0, width: int = 0) -> DataFrame:
    """Pixels of the tile's weak percentile of values above 0 and more, closed, in regions of
    `least` pixels or more that hold one of the strong percentile or are `long` enough."""
    q = p.where("value > 0").groupBy("tile_id").agg(F.percentile("value", weak).alias("low"), F.percentile("value", strong).alias("high"))
    graded = p.join(q, "tile_id")
    m = graded.where("value >= low").select(*KEY)
    if close > 1:
        m = eroded(dilated(m, close, height, width), close, height, width)
    seeds = graded.where("value >= high").select(*KEY, F.lit(True).alias("seed"))
    held = regions(m).join(seeds, list(KEY), "left")
    seeded = held.where("seed").select("tile_id", "region").distinct().withColumn("s", F.lit(True))
    table = region_table(m, least).join(seeded, ["tile_id", "region"], "left").where(F.col("s").isNotNull() | (F.col("elongation") >= long))
    return held.join(table, ["tile_id", "region"], "left_semi").select(*KEY)


def holes(p: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels that aren't set and that no way over unset pixels (4 neighbours) joins to the
    tile's border. Tiles without any set pixel have none."""
    tiles = p.select("tile_id").distinct()
    grid = tiles.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    empty = regions(grid.join(p.select(*KEY), list(KEY), "left_anti"), 4)
    edge = (F.col("row") == 0) | (F.col("row") == height - 1) | (F.col("col") == 0) | (F.col("col") == width - 1)
    return empty.join(empty.where(edge).select("tile_id", "region").distinct(), ["tile_id", "region"], "left_anti").select(*KEY)


def half_widths(p: DataFrame) -> DataFrame:
    """Per region of pixels (value: distance to the region's edge) the median of its 3x3 local
    maxima, of all pixels where it has fewer than three, and 1 at least."""
    from waymark.operators.raster import local_maxima

    top = local_maxima(p).select(*KEY, F.lit(True).alias("top"))
    t = regions(p).join(top, list(KEY), "left").groupBy("tile_id", "region").agg(F.count("top").alias("n"), F.median(F.when(F.col("top"), F.col("value"))).alias("m"), F.median("value").alias("every"))
    return t.select("tile_id", "region", F.greatest(F.lit(1.0), F.when(F.col("n") >= 3, F.col("m")).otherwise(F.col("every"))).alias("half_width"))


def bilinear(points: DataFrame, p: DataFrame, height: int, width: int) -> DataFrame:
    """(id, value) of points (id, tile_id, y, x) between pixels, clamped to the tile: four
    pixels by their weights, one join."""
    y, x = (F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(n - 1))) for c, n in (("y", height), ("x", width)))
    at = points.select("id", "tile_id", y.alias("y"), x.alias("x")).withColumn("r", F.floor("y").cast("int")).withColumn("c", F.floor("x").cast("int"))
    fy, fx = F.col("y") - F.col("r"), F.col("x") - F.col("c")
    corner = lambda i, j: F.struct(F.least(F.col("r") + i, F.lit(height - 1)).alias("row"), F.least(F.col("c") + j, F.lit(width - 1)).alias("col"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w"))
    four = at.select("id", "tile_id", F.inline(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])))
    return four.join(p, list(KEY)).groupBy("id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def line_samples(lines: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels along lines (id, tile_id, x1, y1, x2, y2): ceil(length) + 1 even steps, rounded
    half to even, clamped to the tile."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).cast("int")
    steps = lines.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda c, most: F.least(F.greatest(F.rint(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col("k") / F.col("n")).cast("int"), F.lit(0)), F.lit(most - 1))
    return steps.select("id", "tile_id", "k", at("y", height).alias("row"), at("x", width).alias("col"))


def line_means(lines: DataFrame, p: DataFrame, height: int, width: int) -> DataFrame:
    """(id, mean) of the pixels along each line."""
    return line_samples(lines, height, width).join(p, list(KEY)).groupBy("id").agg(F.avg("value").alias("mean"))


def path_evidence(lines: DataFrame, p: DataFrame, background: DataFrame, height: int, width: int, low: float, least: dict[str, float]) -> DataFrame:
    """Per line mean, first quartile and share of its pixels at or above `low`, the contrast
    with its background (id, mean), and whether all four reach their least."""
    own = line_samples(lines, height, width).join(p, list(KEY)).groupBy("id").agg(F.avg("value").alias("mean"), F.percentile("value", 0.25).alias("q25"), F.avg((F.col("value") >= low).cast("int")).alias("weak"))
    rows = own.join(background.select("id", F.col("mean").alias("_b")), "id", "left").withColumn("contrast", F.col("mean") - F.coalesce("_b", F.lit(0.0))).drop("_b")
    good = (F.col("mean") >= least["mean"]) & (F.col("q25") >= least["q25"]) & (F.col("weak") >= least["weak"]) & (F.col("contrast") >= least["contrast"])
    return rows.withColumn("supported", good)


def snapped(points: DataFrame, m: DataFrame, radius: int) -> DataFrame:
    """(id, row, col, moved, distance) of points (id, tile_id, y, x): a point on a set pixel
    stays; else the nearest set pixel in the window around its pixel, the first of equals."""
    at = points.withColumn("r", F.rint("y").cast("int")).withColumn("c", F.rint("x").cast("int"))
    on = at.join(m.select("tile_id", F.col("row").alias("r"), F.col("col").alias("c")), ["tile_id", "r", "c"], "left_semi").select("id").withColumn("on", F.lit(True))
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    near = at.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).select("id", "tile_id", "y", "x", (F.col("r") + F.col("dr")).cast("int").alias("row"), (F.col("c") + F.col("dc")).cast("int").alias("col")).join(m.select(*KEY), list(KEY))
    d = F.pow(F.col("row") - F.col("y"), F.lit(2.0)) + F.pow(F.col("col") - F.col("x"), F.lit(2.0))
    best = near.groupBy("id").agg(F.min(F.struct(d.alias("d"), "row", "col")).alias("m"))
    out = points.join(on, "id", "left").join(best, "id", "left")
    moved = F.col("on").isNull() & F.col("m").isNotNull()
    return out.select("id", F.when(moved, F.col("m.row").cast("double")).otherwise(F.col("y")).alias("row"), F.when(moved, F.col("m.col").cast("double")).otherwise(F.col("x")).alias("col"), moved.alias("moved"), F.when(moved, F.sqrt("m.d")).otherwise(0.0).alias("distance"))


def ray_scan(rays: DataFrame, m: DataFrame, height: int, width: int, step: float, most: float) -> DataFrame:
    """(id, distance, stop) of rays (id, tile_id, y, x, dy, dx): how far steps along a ray stay
    on set pixels; stop: boundary, border (the tile ends) or limit."""
    n = int(most / step)
    walk = rays.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    at = lambda c: F.rint(F.col(c) + F.col(f"d{c}") * F.col("k") * step).cast("int")
    walk = walk.select("id", "tile_id", "k", at("y").alias("row"), at("x").alias("col")).join(m.select(*KEY).withColumn("set", F.lit(True)), list(KEY), "left")
    outside = (F.col("row") < 0) | (F.col("row") >= height) | (F.col("col") < 0) | (F.col("col") >= width)
    ends = walk.where(F.col("set").isNull()).groupBy("id").agg(F.min(F.struct("k", outside.alias("out"))).alias("e"))
    k = F.coalesce(F.col("e.k") - 1, F.lit(n))
    stop = F.when(F.col("e").isNull(), "limit").when(F.col("e.out"), "border").otherwise("boundary")
    return rays.select("id").join(ends, "id", "left").select("id", (k * step).alias("distance"), stop.alias("stop"))


def ring_contrast(p: DataFrame, centre: Column, ring: Column, zone: str) -> DataFrame:
    """Per zone of pixels: mean and first quartile of those in the centre, mean of those in the
    ring around it, and their contrast; null where either has none."""
    value = F.col("value")
    a = p.groupBy(zone).agg(F.avg(F.when(centre, value)).alias("centre_mean"), F.percentile(F.when(centre, value), 0.25).alias("centre_q25"), F.avg(F.when(ring, value)).alias("ring_mean"))
    return a.withColumn("contrast", F.col("centre_mean") - F.col("ring_mean"))


def aligned_window(a: Column, b: Column, d: Column, e: Column, c: Column, f: Column, height: Column, width: Column, target: tuple[float, ...], rows: int, cols: int) -> Column:
    """(row, col) at which a grid (affine a, b, c, d, e, f) lies in a target grid of `rows` by
    `cols`, null unless both have the same pixels, the offset is whole and the grid fits."""
    ta, tb, tc, td, te, tf = target
    near = max(max(abs(x) for x in (ta, tb, td, te)), 1.0) * 1e-9
    same = (F.abs(a - ta) <= near) & (F.abs(b - tb) <= near) & (F.abs(d - td) <= near) & (F.abs(e - te) <= near)
    det = ta * te - tb * td
    if det == 0:
        return F.lit(None).cast("struct<row int, col int>")
    col, row = ((c - tc) * te - (f - tf) * tb) / det, ((f - tf) * ta - (c - tc) * td) / det
    whole = (F.abs(col - F.rint(col)) <= 1e-7) & (F.abs(row - F.rint(row)) <= 1e-7)
    r, q = F.rint(row).cast("int"), F.rint(col).cast("int")
    fits = (r >= 0) & (q >= 0) & (r + height <= rows) & (q + width <= cols)
    return F.when(same & whole & fits, F.struct(r.alias("row"), q.alias("col")))
