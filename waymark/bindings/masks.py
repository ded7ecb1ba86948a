"""Queries of mask and region operators, on tiles of 8 by 8 pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import masks, raster
from waymark.registry import register, rounded
from waymark.sources import tables

N = 8
PX = "px AS (SELECT vec_id AS tile_id, label, CAST(k // 8 AS INT) AS r, CAST(k % 8 AS INT) AS c, least(greatest((CAST(v AS DOUBLE) + 0.6e0) / 1.2e0, 0.0), 1.0) AS v FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS k FROM embeddings))"


def tiles(spark, d):
    e = tables.load(spark, d, "embeddings")
    scaled = F.transform("embedding", lambda v: F.least(F.greatest((v.cast("double") + 0.6) / 1.2, F.lit(0.0)), F.lit(1.0)))
    return raster.pixels(e.select(F.col("vec_id").alias("tile_id"), scaled.alias("values")), N)


def _morph(source: str, name: str, k: int, erode: bool) -> str:
    """SQL: pixels of a k by k window, any set or, to erode, all that lie in the tile."""
    lo, hi = k // 2, k - 1 - k // 2
    window = f"s.tile_id = t.tile_id AND s.r BETWEEN t.r - {lo} AND t.r + {hi} AND s.c BETWEEN t.c - {lo} AND t.c + {hi}"
    every = f"(least(t.r + {hi}, 7) - greatest(t.r - {lo}, 0) + 1) * (least(t.c + {hi}, 7) - greatest(t.c - {lo}, 0) + 1)"
    return f"{name} AS (SELECT t.tile_id, t.r, t.c FROM grid t JOIN {source} s ON {window} GROUP BY ALL{f' HAVING count(*) = {every}' if erode else ''})"


def _regions(source: str, name: str, four: bool = False) -> str:
    near = "abs(a.r - b.r) + abs(a.c - b.c) = 1" if four else "greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1"
    return f"""{name}l AS (SELECT a.tile_id, a.r, a.c, b.r * 8 + b.c AS o FROM {source} a JOIN {source} b ON a.tile_id = b.tile_id AND {near}),
    {name}r AS (SELECT tile_id, r, c, r * 8 + c AS seen FROM {source} UNION SELECT x.tile_id, x.r, x.c, l.o FROM {name}r x JOIN {name}l l ON l.tile_id = x.tile_id AND l.r * 8 + l.c = x.seen),
    {name} AS (SELECT tile_id, r, c, min(seen) AS region FROM {name}r GROUP BY 1, 2, 3)"""


_GRID = f"{PX}, grid AS (SELECT tile_id, r, c FROM px)"
_REC = lambda q: "RECURSIVE " + q
_CLEAN = f"{_GRID}, m0 AS (SELECT tile_id, r, c FROM px WHERE v >= 0.52), {_morph('m0', 'm1', 3, False)}, {_morph('m1', 'm2', 3, True)}, {_morph('m2', 'm3', 2, True)}, {_morph('m3', 'm4', 2, False)}, {_regions('m4', 'rg')}"


@register(f"WITH {_REC(_CLEAN)} SELECT tile_id, r AS row, c AS col FROM rg WHERE (tile_id, region) IN (SELECT (tile_id, region) FROM rg GROUP BY tile_id, region HAVING count(*) >= 6)")
def cleaned_masks(spark, d):
    return masks.cleaned(tiles(spark, d), 0.52, 3, 2, 6, N, N)


_HALF = f"{_GRID}, m0 AS (SELECT tile_id, r, c FROM px WHERE v >= 0.56), {_regions('m0', 'rg')}"


@register(f"""WITH {_REC(_HALF)}, t AS (SELECT tile_id, region, count(*) AS area, min(r) AS top, min(c) AS lft, max(r) - min(r) + 1 AS height, max(c) - min(c) + 1 AS width, avg(r) AS centre_row, avg(c) AS centre_col, var_samp(r) AS vr, var_samp(c) AS vc, covar_samp(r, c) AS cv FROM rg GROUP BY 1, 2)
    SELECT tile_id, CAST(region // 8 AS INT) AS row, CAST(region % 8 AS INT) AS col, area, top, lft AS "left", height, width, round(centre_row, 6) AS centre_row, round(centre_col, 6) AS centre_col, round(area / CAST(height * width AS DOUBLE), 6) AS extent,
        round(CASE WHEN area < 3 THEN 1 ELSE sqrt(greatest((vr + vc) / 2 + sqrt(pow((vr - vc) / 2, 2) + cv * cv), 1e-6) / greatest((vr + vc) / 2 - sqrt(pow((vr - vc) / 2, 2) + cv * cv), 1e-6)) END, 3) AS elongation FROM t WHERE area >= 3""")
def mask_regions(spark, d):
    t = masks.region_table(masks.above(tiles(spark, d), 0.56), 3)
    t = t.select("tile_id", "region.row", "region.col", "area", "top", "left", "height", "width", "centre_row", "centre_col", "extent", "elongation")
    return rounded(rounded(t, "centre_row", "centre_col", "extent", digits=6), "elongation", digits=3)


_HYST = f"""{_GRID}, q AS (SELECT tile_id, quantile_cont(v, 0.45) AS lo, quantile_cont(v, 0.95) AS hi FROM px WHERE v > 0 GROUP BY 1), m0 AS (SELECT tile_id, r, c FROM px JOIN q USING (tile_id) WHERE v >= lo), {_morph('m0', 'm1', 2, False)}, {_morph('m1', 'm2', 2, True)}, {_regions('m2', 'rg')},
    t AS (SELECT tile_id, region, count(*) AS area, var_samp(r) AS vr, var_samp(c) AS vc, covar_samp(r, c) AS cv FROM rg GROUP BY 1, 2), sd AS (SELECT DISTINCT tile_id, region FROM rg JOIN px USING (tile_id, r, c) JOIN q USING (tile_id) WHERE v >= hi),
    kp AS (SELECT tile_id, region FROM t WHERE area >= 4 AND ((tile_id, region) IN (SELECT (tile_id, region) FROM sd) OR (CASE WHEN area < 3 THEN 1 ELSE sqrt(greatest((vr + vc) / 2 + sqrt(pow((vr - vc) / 2, 2) + cv * cv), 1e-6) / greatest((vr + vc) / 2 - sqrt(pow((vr - vc) / 2, 2) + cv * cv), 1e-6)) END) >= 2.9))"""


@register(f"WITH {_REC(_HYST)} SELECT tile_id, r AS row, c AS col FROM rg JOIN kp USING (tile_id, region)")
def hysteresis_pixels(spark, d):
    return masks.hysteresis(tiles(spark, d), 0.45, 0.95, 4, 2.9, 2, N, N)


_HOLES = f"{_GRID}, m0 AS (SELECT tile_id, r, c FROM px WHERE v < 0.5 AND tile_id IN (SELECT tile_id FROM px WHERE v >= 0.5)), {_regions('m0', 'rg', True)}"


@register(f"WITH {_REC(_HOLES)} SELECT tile_id, r AS row, c AS col FROM rg WHERE (tile_id, region) NOT IN (SELECT (tile_id, region) FROM rg WHERE r IN (0, 7) OR c IN (0, 7))")
def enclosed_holes(spark, d):
    return masks.holes(masks.above(tiles(spark, d), 0.5), N, N)


_WIDE = f"{_GRID}, m0 AS (SELECT tile_id, r, c, v * 6 AS v FROM px WHERE v >= 0.55), {_regions('m0', 'rg')}"


@register(f"""WITH {_REC(_WIDE)}, x AS (SELECT p.tile_id, p.r, p.c, p.v, NOT EXISTS (SELECT 1 FROM m0 q WHERE q.tile_id = p.tile_id AND abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1 AND q.v > p.v) AS top FROM m0 p)
    SELECT tile_id, CAST(region // 8 AS INT) AS row, CAST(region % 8 AS INT) AS col, round(greatest(1, CASE WHEN count(*) FILTER (top) >= 3 THEN median(v) FILTER (top) ELSE median(v) END), 6) AS half_width FROM rg JOIN x USING (tile_id, r, c) GROUP BY tile_id, region""")
def region_half_widths(spark, d):
    p = masks.above(tiles(spark, d), 0.55).withColumn("value", F.col("value") * 6)
    return rounded(masks.half_widths(p).select("tile_id", "region.row", "region.col", "half_width"), "half_width", digits=6)


_PT = "pt AS (SELECT vec_id AS id, vec_id AS tile_id, vec_id % 11 * 0.8e0 - 0.5e0 AS y, vec_id % 13 * 0.65e0 - 0.3e0 AS x FROM embeddings)"


def _points(spark, d):
    k = F.col("vec_id")
    return tables.load(spark, d, "embeddings").select(k.alias("id"), k.alias("tile_id"), (k % 11 * 0.8 - 0.5).alias("y"), (k % 13 * 0.65 - 0.3).alias("x"))


@register(f"""WITH {PX}, {_PT}, cl AS (SELECT id, tile_id, least(greatest(y, 0), 7) AS y, least(greatest(x, 0), 7) AS x FROM pt), fl AS (SELECT *, CAST(floor(y) AS INT) AS r, CAST(floor(x) AS INT) AS c FROM cl)
    SELECT id, round(sum(px.v * (CASE WHEN i = 1 THEN y - fl.r ELSE 1 - (y - fl.r) END) * (CASE WHEN j = 1 THEN x - fl.c ELSE 1 - (x - fl.c) END)), 6) AS value FROM fl, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(i, j) JOIN px ON px.tile_id = fl.tile_id AND px.r = least(fl.r + i, 7) AND px.c = least(fl.c + j, 7) GROUP BY id""")
def bilinear_samples(spark, d):
    return rounded(masks.bilinear(_points(spark, d), tiles(spark, d), N, N), "value", digits=6)


_LN = "ln AS (SELECT id, tile_id, x AS x1, y AS y1, 7 - x * 0.8e0 AS x2, 6.3e0 - y * 0.7e0 AS y2 FROM pt)"
_WALK = "wk AS (SELECT *, CAST(greatest(1, ceil(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS INT) AS n FROM ln), st AS (SELECT *, unnest(range(0, n + 1)) AS k FROM wk), sm AS (SELECT id, tile_id, CAST(least(greatest(round_even(y1 + (y2 - y1) * k / n, 0), 0), 7) AS INT) AS r, CAST(least(greatest(round_even(x1 + (x2 - x1) * k / n, 0), 0), 7) AS INT) AS c FROM st)"


def _lines(spark, d):
    return _points(spark, d).select("id", "tile_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (7 - F.col("x") * 0.8).alias("x2"), (6.3 - F.col("y") * 0.7).alias("y2"))


@register(f"WITH {PX}, {_PT}, {_LN}, {_WALK} SELECT id, round(avg(v), 6) AS mean FROM sm JOIN px USING (tile_id, r, c) GROUP BY 1")
def line_pixel_means(spark, d):
    return rounded(masks.line_means(_lines(spark, d), tiles(spark, d), N, N), "mean", digits=6)


@register(f"""WITH {PX}, {_PT}, {_LN}, {_WALK}, a AS (SELECT id, avg(v) AS mean, quantile_cont(v, 0.25) AS q25, avg(CASE WHEN v >= 0.5 THEN 1.0e0 ELSE 0.0e0 END) AS weak FROM sm JOIN px USING (tile_id, r, c) GROUP BY 1), b AS (SELECT tile_id AS id, avg(v) AS b FROM px GROUP BY 1)
    SELECT id, round(mean, 6) AS mean, round(q25, 6) AS q25, round(weak, 6) AS weak, round(mean - b, 6) AS contrast, mean >= 0.48 AND q25 >= 0.42 AND weak >= 0.4 AND mean - b >= -0.02 AS supported FROM a JOIN b USING (id)""")
def line_evidence(spark, d):
    p = tiles(spark, d)
    back = p.groupBy(F.col("tile_id").alias("id")).agg(F.avg("value").alias("mean"))
    out = masks.path_evidence(_lines(spark, d), p, back, N, N, 0.5, {"mean": 0.48, "q25": 0.42, "weak": 0.4, "contrast": -0.02})
    return rounded(out, "mean", "q25", "weak", "contrast", digits=6)


@register(f"""WITH {PX}, {_PT}, m AS (SELECT tile_id, r, c FROM px WHERE v >= 0.6), nr AS (SELECT id, y, x, arg_min(struct_pack(r := m.r, c := m.c), struct_pack(d := pow(m.r - y, 2) + pow(m.c - x, 2), r := m.r, c := m.c)) AS b FROM pt JOIN m ON m.tile_id = pt.tile_id AND abs(m.r - round_even(y, 0)) <= 2 AND abs(m.c - round_even(x, 0)) <= 2 GROUP BY ALL),
    on_ AS (SELECT id FROM pt JOIN m ON m.tile_id = pt.tile_id AND m.r = round_even(y, 0) AND m.c = round_even(x, 0))
    SELECT pt.id, round(CASE WHEN mv THEN b.r ELSE pt.y END, 6) AS row, round(CASE WHEN mv THEN b.c ELSE pt.x END, 6) AS col, mv AS moved, round(CASE WHEN mv THEN sqrt(pow(b.r - pt.y, 2) + pow(b.c - pt.x, 2)) ELSE 0 END, 6) AS distance FROM (SELECT pt.*, nr.b, nr.b IS NOT NULL AND pt.id NOT IN (SELECT id FROM on_) AS mv FROM pt LEFT JOIN nr ON nr.id = pt.id) pt""")
def mask_snaps(spark, d):
    return rounded(masks.snapped(_points(spark, d), masks.above(tiles(spark, d), 0.6), 2), "row", "col", "distance", digits=6)


@register(f"""WITH {PX}, ry AS (SELECT vec_id AS id, vec_id AS tile_id, vec_id % 7 + 0.25e0 AS y, vec_id % 5 + 1.25e0 AS x, CASE WHEN vec_id % 2 = 0 THEN 0.6e0 ELSE -0.8e0 END AS dy, CASE WHEN vec_id % 3 = 0 THEN 0.8e0 ELSE -0.6e0 END AS dx FROM embeddings), w AS (SELECT *, unnest(range(1, 13)) AS k FROM ry),
    a AS (SELECT w.id, k, round_even(y + dy * k * 0.5, 0) AS r, round_even(x + dx * k * 0.5, 0) AS c, tile_id FROM w), e AS (SELECT a.id, a.k, a.r < 0 OR a.r > 7 OR a.c < 0 OR a.c > 7 AS out FROM a LEFT JOIN px ON px.tile_id = a.tile_id AND px.r = a.r AND px.c = a.c AND px.v >= 0.45 WHERE px.tile_id IS NULL), f AS (SELECT id, min(k) AS k, arg_min(out, k) AS out FROM e GROUP BY 1)
    SELECT ry.id, coalesce(f.k - 1, 12) * 0.5e0 AS distance, CASE WHEN f.k IS NULL THEN 'limit' WHEN f.out THEN 'border' ELSE 'boundary' END AS stop FROM ry LEFT JOIN f ON f.id = ry.id""")
def ray_scans(spark, d):
    k = F.col("vec_id")
    rays = tables.load(spark, d, "embeddings").select(k.alias("id"), k.alias("tile_id"), (k % 7 + 0.25).alias("y"), (k % 5 + 1.25).alias("x"), F.when(k % 2 == 0, 0.6).otherwise(-0.8).alias("dy"), F.when(k % 3 == 0, 0.8).otherwise(-0.6).alias("dx"))
    return masks.ray_scan(rays, masks.above(tiles(spark, d), 0.45), N, N, 0.5, 6.0)


@register(f"WITH {PX}, z AS (SELECT tile_id, avg(v) FILTER (abs(r - 3.5) <= 1 AND abs(c - 3.5) <= 1) AS m, quantile_cont(v, 0.25) FILTER (abs(r - 3.5) <= 1 AND abs(c - 3.5) <= 1) AS q, avg(v) FILTER (greatest(abs(r - 3.5), abs(c - 3.5)) > 2.5) AS g FROM px GROUP BY 1) SELECT tile_id, round(m, 6) AS centre_mean, round(q, 6) AS centre_q25, round(g, 6) AS ring_mean, round(m - g, 6) AS contrast FROM z")
def ring_contrasts(spark, d):
    off = F.greatest(F.abs(F.col("row") - 3.5), F.abs(F.col("col") - 3.5))
    return rounded(masks.ring_contrast(tiles(spark, d), off <= 1, off > 2.5, "tile_id"), "centre_mean", "centre_q25", "ring_mean", "contrast", digits=6)


@register(f"WITH {PX}, s AS (SELECT tile_id, r, c, CASE WHEN tile_id % 3 = 0 THEN v * 255 WHEN tile_id % 7 = 0 AND r = 2 THEN CAST('NaN' AS DOUBLE) ELSE v END AS v FROM px), t AS (SELECT tile_id, max(v) AS top FROM s WHERE NOT isnan(v) GROUP BY 1) SELECT tile_id, r AS row, c AS col, round(least(greatest(CASE WHEN top > 1 THEN v / 255 ELSE v END, 0), 1), 6) AS value FROM s JOIN t USING (tile_id) WHERE NOT isnan(v)")
def scaled_probabilities(spark, d):
    t = F.col("tile_id")
    p = tiles(spark, d).withColumn("value", F.when(t % 3 == 0, F.col("value") * 255).when((t % 7 == 0) & (F.col("row") == 2), float("nan")).otherwise(F.col("value")))
    return rounded(masks.probability(p), "value", digits=6)


@register("""WITH g AS (SELECT p_partkey AS id, 2.0e0 * (p_partkey % 40) + CASE WHEN p_partkey % 9 = 0 THEN 0.7e0 ELSE 0 END + 100 AS c, 900 - 2.0e0 * (p_partkey % 23) AS f, CASE WHEN p_partkey % 13 = 0 THEN 2.5e0 ELSE 2.0e0 END AS a FROM part), o AS (SELECT *, (c - 100) / 2 AS q, (900 - f) / 2 AS r FROM g)
    SELECT id, CASE WHEN ok THEN CAST(round_even(r, 0) AS INT) END AS row, CASE WHEN ok THEN CAST(round_even(q, 0) AS INT) END AS col FROM (SELECT *, a = 2 AND abs(q - round_even(q, 0)) <= 1e-7 AND r + 8 <= 25 AND q + 8 <= 40 AS ok FROM o)""")
def aligned_windows(spark, d):
    k = F.col("p_partkey")
    c, f = 2.0 * (k % 40) + F.when(k % 9 == 0, 0.7).otherwise(0.0) + 100, 900 - 2.0 * (k % 23)
    a = F.when(k % 13 == 0, 2.5).otherwise(2.0)
    at = masks.aligned_window(a, F.lit(0.0), F.lit(0.0), F.lit(-2.0), c, f, F.lit(8), F.lit(8), (2.0, 0.0, 100.0, 0.0, -2.0, 900.0), 25, 40)
    return tables.load(spark, d, "part").select(k.alias("id"), at.alias("w")).select("id", "w.row", "w.col")


@register("WITH e AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 900 AS extent FROM orders), s AS (SELECT id, CASE WHEN extent <= 64 THEN [0] ELSE list_distinct(list_concat(range(0, extent - 64 + 1, 40), [extent - 64])) END AS p FROM e) SELECT id, CAST(unnest(p) AS INT) AS start FROM s")
def covering_windows(spark, d):
    extent = (F.floor("o_totalprice").cast("long") % 900).cast("int")
    e = tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), extent.alias("extent"))
    return e.select("id", F.explode(raster.window_starts(F.col("extent"), 64, 12)).alias("start"))
