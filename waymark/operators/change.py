"""Change of a network between two periods: claims of matched segments, what stays unmatched,
mean axes, corridors, and the changes with their decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.functions import segments as sg
from waymark.operators import intervals, lines
from waymark.plans.checkpoints import materialise


def claims(matches: DataFrame, before: DataFrame, after: DataFrame, tolerance: float) -> DataFrame:
    """Matches (a_id, b_id, score) that stay when segments of the first period are claimed once:
    by falling score, a match goes if the middle of its stretch is claimed already. With the
    stretch on either segment: a_start, a_end, b_start, b_end."""
    rows = matches.join(lines.side(before, "a"), "a_id").join(lines.side(after, "b"), "b_id")
    rows = rows.withColumn("i", lines.interval_on("a", "b", tolerance)).withColumn("j", lines.interval_on("b", "a", tolerance)).where("i IS NOT NULL AND j IS NOT NULL")
    flat = rows.select("a_id", "b_id", "score", F.col("i.start").alias("a_start"), F.col("i.end").alias("a_end"), F.col("j.start").alias("b_start"), F.col("j.end").alias("b_end"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        held, keep = [], []
        for r in part.sort_values(["score", "b_id"], ascending=[False, True]).itertuples():
            middle = (r.a_start + r.a_end) / 2
            if not any(s - 0.05 <= middle <= e + 0.05 for s, e in held):
                held.append((r.a_start, r.a_end))
                keep.append(r.Index)
        return part.loc[keep]

    return flat.groupBy("a_id").applyInPandas(one, flat.schema)


def remainders(segments: DataFrame, covered: DataFrame, least: float) -> DataFrame:
    """(line_id, start, end) of the stretches of segments (line_id, x1, ...) that intervals of
    covered (line_id, start, end) leave, of `least` length or more."""
    sizes = segments.select("line_id", g.length(*[F.col(c) for c in lines.XY]).alias("length"))
    own = intervals.merge(covered, "line_id")
    gaps = intervals.complement(own, "line_id", sizes)
    return gaps.where(F.col("gap_end") - F.col("gap_start") >= least).select("line_id", F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))


def stretch(line: str, start: Column, end: Column) -> list[Column]:
    """x1, y1, x2, y2 of a part of a line by distances along it."""
    x1, y1, x2, y2 = (F.col(f"{line}{c}") for c in lines.XY)
    size = g.length(x1, y1, x2, y2)
    at = lambda a, b, d: a + (b - a) * F.coalesce(F.try_divide(d, size), F.lit(0.0))
    return [at(x1, x2, start).alias("x1"), at(y1, y2, start).alias("y1"), at(x1, x2, end).alias("x2"), at(y1, y2, end).alias("y2")]


def axis(pairs: DataFrame, tolerance: float, gap: float = 0.75) -> DataFrame:
    """Common axis of matched stretches: pairs (ax1 to ay2, bx1 to by2, a_quality, b_quality)
    with x1, y1, x2, y2. The second is turned if that brings the ends closer; pairs farther
    apart than the tolerance at an end go. A side better by `gap` counts alone, else both by
    their quality. Of two straight lines the mean of all places is the line of mean ends."""
    near = lambda i, j: g.length(F.col(f"ax{i}"), F.col(f"ay{i}"), F.col(f"bx{j}"), F.col(f"by{j}"))
    turn = near(1, 2) + near(2, 1) < near(1, 1) + near(2, 2)
    b = {c: F.when(turn, F.col(f"b{c[0]}{3 - int(c[1])}")).otherwise(F.col(f"b{c}")) for c in lines.XY}
    rows = pairs.withColumns({f"_{c}": v for c, v in b.items()})
    off = lambda i: F.hypot(F.col(f"ax{i}") - F.col(f"_x{i}"), F.col(f"ay{i}") - F.col(f"_y{i}"))
    rows = rows.where(F.greatest(off(1), off(2)) <= tolerance)
    p, q = F.col("a_quality"), F.col("b_quality")
    share = F.when(p >= q + gap, 1.0).when(q >= p + gap, 0.0).otherwise(p / F.greatest(p + q, F.lit(1e-9)))
    return rows.withColumns({c: share * F.col(f"a{c}") + (1 - share) * F.col(f"_{c}") for c in lines.XY}).drop(*[f"_{c}" for c in lines.XY])


def corridors(segments: DataFrame) -> DataFrame:
    """segments (line_id, x1, ..., width) with width above 0: their area and the four corners of
    the flat-ended band around them; exact for straight lines."""
    x1, y1, x2, y2 = (F.col(c) for c in lines.XY)
    rows = segments.withColumn("length", g.length(x1, y1, x2, y2)).where("width > 0 AND length > 0")
    ox, oy = -(y2 - y1) / F.col("length") * F.col("width") / 2, (x2 - x1) / F.col("length") * F.col("width") / 2
    corner = lambda x, y, s: F.struct((x + s * ox).alias("x"), (y + s * oy).alias("y"))
    ring = F.array(corner(x1, y1, 1), corner(x2, y2, 1), corner(x2, y2, -1), corner(x1, y1, -1))
    return rows.withColumn("area", F.col("length") * F.col("width")).withColumn("ring", ring)


def network_coverage(segments: DataFrame, network: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """(line_id, coverage) of segments: the share within the tolerance of any line of a
    network; stretches are merged, so lines that cover the same part count once."""

    def measure(x, y, distance, at):
        low, high = (part * sg.length(*x) for part in sg.stretch(x, y, tolerance))
        kept = np.flatnonzero(high - low > 1e-6)  # as merge() has it
        first, start, end = sg.united(at("a_id")[kept], low[kept], high[kept])
        return kept[first], {"start": start, "end": end}

    # overlapping stretches of a block's lines are one already
    spans = lines.near_lines(lines.side(segments, "a"), lines.side(network, "b"), tolerance, cell, measure, ("a_id", "start", "end")).withColumnRenamed("a_id", "line_id")
    merged = intervals.merge(spans, "line_id", 0.0).groupBy("line_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    sizes = segments.select("line_id", g.length(*[F.col(c) for c in lines.XY]).alias("length"))
    return sizes.join(merged, "line_id", "left").select("line_id", F.least(F.coalesce(F.try_divide("covered", "length"), F.lit(0.0)), F.lit(1.0)).alias("coverage"))


def detected(before: DataFrame, after: DataFrame, tolerance: float = 3.0, cell: float = 20.0, least: float = 5.0, **match) -> DataFrame:
    """Changes between two periods' segments (line_id, x1, ..., width, grade, valid, aligned):
    change_typ, side, line_id, start, end, before_w, after_w, qa_state and reason.

    Stretches that no claimed match covers are added or removed, for review: there is no
    evidence here but geometry. Claimed pairs whose widths differ enough, with good grades,
    are widened or narrowed; those rejected are not."""
    m = materialise(lines.match_segments(before, after, tolerance, cell, related=False, **match).select("a_id", "b_id", "score"), "matches")
    kept = materialise(claims(m, before, after, tolerance), "claims")
    span = lambda s: kept.select(F.col(f"{s}_id").alias("line_id"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end"))
    none = F.lit(None).cast("double")
    lost = remainders(before, span("a"), least).join(before.select("line_id", "width"), "line_id").select(F.lit("removed").alias("change_typ"), F.lit("before").alias("side"), "line_id", "start", "end", F.col("width").alias("before_w"), none.alias("after_w"))
    new = remainders(after, span("b"), least).join(after.select("line_id", "width"), "line_id").select(F.lit("added").alias("change_typ"), F.lit("after").alias("side"), "line_id", "start", "end", none.alias("before_w"), F.col("width").alias("after_w"))
    gone = lost.unionByName(new).withColumn("qa_state", F.lit("review")).withColumn("reason", F.lit("valid_observation_unknown"))
    of = lambda rows, s: rows.select(F.col("line_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("width", "grade", "valid", "aligned")])
    pairs = kept.join(of(before, "a"), "a_id").join(of(after, "b"), "b_id")
    good = (F.col("a_grade") != "C") & (F.col("b_grade") != "C")
    outcome = lines.width_rejection(F.col("a_width"), F.col("b_width"), good, F.least("a_valid", "b_valid"), F.least("a_aligned", "b_aligned"))
    wide = pairs.withColumn("outcome", outcome).where("outcome = 'candidate'")
    kind = F.when(F.col("b_width") > F.col("a_width"), "widened").otherwise("narrowed")
    moved = wide.select(kind.alias("change_typ"), F.lit("after").alias("side"), F.col("b_id").alias("line_id"), F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("a_width").alias("before_w"), F.col("b_width").alias("after_w"), F.lit("auto").alias("qa_state"), F.lit("width_change").alias("reason"))
    return gone.unionByName(moved)
