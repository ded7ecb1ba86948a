"""Planar geometry as column expressions; points are pairs of double columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value written and computed once, however often body uses it: a long
    expression of expressions stays short enough to compile."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def abs_cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """|cos| of two directions; 0.5 where either is missing or has no length."""
    n = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.coalesce(F.when(n > 0, F.least(F.abs(ax * bx + ay * by) / n, F.lit(1.0))), F.lit(0.5))


def project(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Ratio 0..1 along a segment of the place nearest to a point; 0 if it has no length."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    return F.when(n > 0, F.least(F.greatest(((px - x1) * dx + (py - y1) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return let(project(px, py, x1, y1, x2, y2), lambda t: length(px, py, x1 + t * (x2 - x1), y1 + t * (y2 - y1)))


def polyline_length(line: Column) -> Column:
    """Length of an array of points (x, y)."""
    steps = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: length(F.get(line, i - 1)["x"], F.get(line, i - 1)["y"], F.get(line, i)["x"], F.get(line, i)["y"]))
    return F.when(F.size(line) > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def ring_area(ring: Column) -> Column:
    """Area of a ring of points (x, y), open or closed."""
    n = F.size(ring)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def segment_distance(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Distance of two segments: 0 where they cross, else the least from an end of one to the
    other."""
    turn = lambda x1, y1, x2, y2, x3, y3: (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)
    a, b = (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2)
    across = lambda s, t: turn(*s, t[0], t[1]) * turn(*s, t[2], t[3]) < 0
    ends = [point_segment(ax1, ay1, *b), point_segment(ax2, ay2, *b), point_segment(bx1, by1, *a), point_segment(bx2, by2, *a)]
    return F.when(across(a, b) & across(b, a), 0.0).otherwise(F.least(*ends))


def segment_cover(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column, reach: float) -> Column:
    """Share of segment a that lies within `reach` of segment b: 0 to 1, 0 where a has no
    length."""
    part = segment_stretch(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2, reach)
    return let(part, lambda p: F.coalesce(F.greatest(F.lit(0.0), p["high"] - p["low"]), F.lit(0.0)))


def segment_stretch(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column, reach: float) -> Column:
    """(low, high), from 0 to 1 along segment a, of what lies within `reach` of segment b; null
    where nothing does or a has no length. What is near b is a convex shape, a rectangle and
    two discs, so it is one stretch, from the least to the greatest of where a meets these."""
    along = lambda end, start, long, other: F.coalesce(F.try_divide(end - start, long), F.lit(other))
    sizes = F.struct(length(ax1, ay1, ax2, ay2).alias("size"), length(bx1, by1, bx2, by2).alias("long"))

    def turned(z: Column) -> Column:
        """a in b's frame: u along b, v beside it, and their steps over a."""
        made = F.struct(z["size"].alias("size"), z["long"].alias("long"), along(bx2, bx1, z["long"], 1.0).alias("ex"), along(by2, by1, z["long"], 0.0).alias("ey"))
        frame = lambda e: F.struct(
            e["size"].alias("size"), e["long"].alias("long"),
            ((ax1 - bx1) * e["ex"] + (ay1 - by1) * e["ey"]).alias("u"), ((ay1 - by1) * e["ex"] - (ax1 - bx1) * e["ey"]).alias("v"),
            ((ax2 - ax1) * e["ex"] + (ay2 - ay1) * e["ey"]).alias("du"), ((ay2 - ay1) * e["ex"] - (ax2 - ax1) * e["ey"]).alias("dv"),
        )
        return let(made, frame)

    def stretch(low: Column, high: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"))

    def disc(f: Column, at: Column) -> Column:
        half, far, square = (f["u"] - at) * f["du"] + f["v"] * f["dv"], (f["u"] - at) * (f["u"] - at) + f["v"] * f["v"] - reach * reach, f["size"] * f["size"]
        parts = F.struct(half.alias("half"), (half * half - square * far).alias("root"))
        return let(parts, lambda p: F.when(p["root"] >= 0, stretch(F.try_divide(-p["half"] - F.sqrt(F.abs(p["root"])), square), F.try_divide(-p["half"] + F.sqrt(F.abs(p["root"])), square))))

    def band(start: Column, step: Column, low: Column, high: Column) -> Column:
        p, q = F.try_divide(low - start, step), F.try_divide(high - start, step)
        inside = (start >= low) & (start <= high)
        return F.when(step != 0, stretch(F.least(p, q), F.greatest(p, q))).when(inside, stretch(F.lit(float("-inf")), F.lit(float("inf"))))

    def box(f: Column) -> Column:
        bands = F.array(band(f["v"], f["dv"], F.lit(-reach), F.lit(reach)), band(f["u"], f["du"], F.lit(0.0), f["long"]))
        met = lambda b: F.when(b[0].isNotNull() & b[1].isNotNull(), stretch(F.greatest(b[0]["low"], b[1]["low"]), F.least(b[0]["high"], b[1]["high"])))
        return let(let(bands, met), lambda m: F.when(m["low"] <= m["high"], m))

    def share(f: Column) -> Column:
        three = F.array(disc(f, F.lit(0.0)), disc(f, f["long"]), box(f))
        first = lambda t: F.array_min(F.transform(t, lambda x: x["low"]))
        last = lambda t: F.array_max(F.transform(t, lambda x: x["high"]))
        span = let(three, lambda t: stretch(F.greatest(first(t), F.lit(0.0)), F.when(first(t).isNotNull(), F.least(last(t), F.lit(1.0)))))
        return let(span, lambda m: F.when((f["size"] > 0) & (m["low"] <= m["high"]), m))

    return let(let(sizes, turned), share)


def crossing(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Point (x, y) where two segments cross, null where they don't, where they lie on one
    line, or where the point is an end of either."""
    den = (ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1)
    t = F.try_divide((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1), den)
    s = F.try_divide((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1), den)
    point = F.struct((ax1 + t * (ax2 - ax1)).alias("x"), (ay1 + t * (ay2 - ay1)).alias("y"))
    return F.when((t > 0) & (t < 1) & (s > 0) & (s < 1), point)


def median_of(values: Column) -> Column:
    """Median of an array of numbers; null if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2)
