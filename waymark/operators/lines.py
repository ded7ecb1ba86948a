"""Two-point lines: (line_id, x1, y1, x2, y2) tables, matched over periods and in pairs.

Pairs of lines that lie near each other are found by an equi-join on grid cells that their
boxes touch, and taken in one cell only: no cross join, no repeated pair. The lines of a cell
meet in blocks, so that a cell's pairs are never rows of a join and a full cell's are dealt
over tasks; what is asked of a pair is computed for whole blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import geometry as g
from waymark.functions import segments as sg
from waymark.operators.network import dense_ids, snap_degrees
from waymark.plans.checkpoints import discard, materialise
from waymark.plans.star import star_components

XY = ("x1", "y1", "x2", "y2")
SCORES = ("a_cover", "b_cover", "overlap", "dir_sim", "score")


def side(lines: DataFrame, name: str, *more: str) -> DataFrame:
    """lines with the columns of one side of a pair: <name>_id, <name>x1, ..."""
    return lines.select(F.col("line_id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}{c}") for c in (*XY, *more)])


def columns(first: str = "a", second: str = "b") -> list[Column]:
    return [F.col(f"{s}{c}") for s in (first, second) for c in XY]


#: Lines of a cell that are one block; lines of one that meet the other at once; pairs held.
BLOCK, STRIP, PAIRS = 512, 64, 32768

#: From the pairs' lines, distances and columns by name: the places of the pairs that stay,
#: and more columns of these.
Measure = Callable[[sg.Segments, sg.Segments, np.ndarray, Callable[[str], np.ndarray]], tuple[np.ndarray, dict[str, np.ndarray]]]


def near_lines(a: DataFrame, b: DataFrame, distance: float, cell: float, measure: Measure | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs of a (a_id, ax1, ...) and b (b_id, bx1, ...) no farther than `distance` apart,
    with their distance. `cell` is the grid's step: about a line's length serves best. `measure`
    keeps some pairs of a block and adds numbers to them; `only` are the columns that are given."""

    def blocks(rows: DataFrame, s: str, grow: float) -> DataFrame:
        at = lambda f, c, d: F.floor((f(F.col(f"{s}{c}1"), F.col(f"{s}{c}2")) + d) / cell).cast("long")
        low = rows.withColumns({f"{s}cx": at(F.least, "x", -grow), f"{s}cy": at(F.least, "y", -grow)})
        wide = low.withColumn("cx", F.explode(F.sequence(f"{s}cx", at(F.greatest, "x", grow))))
        wide = wide.withColumn("cy", F.explode(F.sequence(f"{s}cy", at(F.greatest, "y", grow))))
        place = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(f"{s}_id", *[f"{s}{c}" for c in XY]))
        own = F.struct(*low.columns).alias(s)
        return wide.withColumn(f"{s}n", F.floor((place - 1) / BLOCK)).groupBy("cx", "cy", f"{s}n").agg(F.collect_list(own).alias(s))

    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = blocks(a, "a", distance).join(blocks(b, "b", 0.0), ["cx", "cy"]).repartition(parts, "cx", "cy", "an", "bn").select("cx", "cy", "a", "b")
    types = {f.name: f.dataType for f in (*a.schema.fields, *b.schema.fields)}
    only = only or (*types, "distance")
    schema = T.StructType([T.StructField(c, types.get(c, T.DoubleType())) for c in only])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _met(batch, distance, measure, only)

    return met.mapInArrow(run, schema)


def _met(batch: pa.RecordBatch, distance: float, measure: Measure | None, only: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The near pairs of rows of two blocks (cx, cy, a, b)."""
    starts, flat, line, of = {}, {}, {}, {}
    for s in "ab":
        lists = batch.column(s)
        starts[s], rows = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        flat |= {f.name: v for f, v in zip(rows.type, rows.flatten(), strict=True)}
        of |= {f.name: s for f in rows.type}
        line[s] = tuple(flat[f"{s}{c}"].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in XY)
    (ax, ay), (bx, by) = ([flat[f"{s}c{c}"].to_numpy() for c in "xy"] for s in "ab")
    low, high = ({s: [f(line[s][i], line[s][i + 2]) for i in (0, 1)] for s in "ab"} for f in (np.fmin, np.fmax))
    far = distance + 1e-6 * (1 + distance)  # boxes only rule out: the distance decides

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, n = [], 0
        for i, (cx, cy) in enumerate(zip(batch.column("cx").to_numpy(), batch.column("cy").to_numpy(), strict=True)):
            own = slice(starts["b"][i], starts["b"][i + 1])
            for k in range(starts["a"][i], starts["a"][i + 1], STRIP):
                strip = slice(k, min(k + STRIP, starts["a"][i + 1]))
                near = (np.maximum(ax[strip, None], bx[own]) == cx) & (np.maximum(ay[strip, None], by[own]) == cy)
                for c in (0, 1):
                    near &= (low["a"][c][strip, None] - high["b"][c][own] <= far) & (low["b"][c][own] - high["a"][c][strip, None] <= far)
                p, q = np.nonzero(near)
                held.append((p + k, q + own.start))
                n += len(p)
                if n >= PAIRS:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    for p, q in pairs():
        off = sg.distance(tuple(c[p] for c in line["a"]), tuple(c[q] for c in line["b"]))
        near = np.flatnonzero(off <= distance)
        p, q, off, more = p[near], q[near], off[near], {}
        if measure:
            at = lambda c, p=p, q=q: flat[c].to_numpy(zero_copy_only=False)[p if of[c] == "a" else q]
            kept, more = measure(tuple(c[p] for c in line["a"]), tuple(c[q] for c in line["b"]), off, at)
            p, q, off = p[kept], q[kept], off[kept]
        if len(p):
            own = {c: pa.array(v) for c, v in (more | {"distance": off}).items()}
            taken = {"a": pa.array(p), "b": pa.array(q)}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else flat[c].take(taken[of[c]]) for c in only], names=list(only))


def direction(first: str = "a", second: str = "b") -> Column:
    """|cos| of the directions of two lines, 0.5 where one has none."""
    of = lambda s: (F.col(f"{s}x2") - F.col(f"{s}x1"), F.col(f"{s}y2") - F.col(f"{s}y1"))
    return g.abs_cosine(*of(first), *of(second))


def scored(pairs: DataFrame, tolerance: float) -> DataFrame:
    """pairs with overlap (the lesser share of one line within reach of the other), dir_sim
    and score: 0.65 overlap, 0.20 direction, 0.15 nearness. Lines without length have 0."""
    reach = max(tolerance, 0.1)
    out = pairs.withColumn("a_cover", g.segment_cover(*columns(), reach)).withColumn("b_cover", g.segment_cover(*columns("b", "a"), reach))
    flat = (g.length(*columns()[:4]) <= 0) | (g.length(*columns()[4:]) <= 0)
    out = out.withColumn("overlap", F.least("a_cover", "b_cover")).withColumn("dir_sim", direction())
    score = 0.65 * F.col("overlap") + 0.20 * F.col("dir_sim") + 0.15 * F.greatest(F.lit(0.0), 1 - F.col("distance") / reach)
    return out.withColumn("score", F.when(flat, 0.0).otherwise(score)).withColumn("overlap", F.when(flat, 0.0).otherwise(F.col("overlap")))


def scores(tolerance: float) -> Measure:
    """The columns that scored() adds."""
    reach = max(tolerance, 0.1)

    def measure(a, b, distance, at):
        p, q = sg.cover(a, b, reach), sg.cover(b, a, reach)
        flat, same, overlap = (sg.length(*a) <= 0) | (sg.length(*b) <= 0), sg.abs_cosine(a, b), np.minimum(p, q)
        score = 0.65 * overlap + 0.20 * same + 0.15 * np.maximum(0.0, 1 - distance / reach)
        more = {"a_cover": p, "b_cover": q, "overlap": np.where(flat, 0.0, overlap), "dir_sim": same, "score": np.where(flat, 0.0, score)}
        return np.arange(len(p)), more

    return measure


def best_match(a: DataFrame, b: DataFrame, tolerance: float, cell: float, *keys: str) -> DataFrame:
    """For each a (and each value of keys, columns of b) its best b: the greatest (score,
    overlap, nearness, id). ambiguous: the second best scores 0.35 or more and no more than
    0.05 less. a without any candidate are missing."""
    score = scores(tolerance)

    def two_best(x, y, distance, at):
        _, found = score(x, y, distance, at)
        kept = sg.leading([at(c) for c in ("a_id", *keys)], [-found["score"], -found["overlap"], distance, -at("b_id")], 2)
        return kept, {c: v[kept] for c, v in found.items()}

    # the two best of a block: of all pairs no others matter
    pairs = near_lines(a, b, max(tolerance, 0.1), cell, two_best, (*a.columns, *b.columns, "distance", *SCORES))
    order = [F.desc("score"), F.desc("overlap"), F.asc("distance"), F.desc("b_id")]
    by = Window.partitionBy("a_id", *keys).orderBy(*order)
    ranked = pairs.withColumn("place", F.row_number().over(by)).withColumn("second", F.lead("score").over(by)).where("place = 1")
    unsure = F.coalesce((F.col("second") >= F.col("score") - 0.05) & (F.col("second") >= 0.35), F.lit(False))
    return ranked.withColumn("ambiguous", unsure).drop("place", "second")


def observations(references: DataFrame, lines: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """A row for each reference and period of lines (period, line_id, x1, ..., width): its
    status by the best match of the period, that line and the match's figures.

    Present: score 0.48 and overlap 0.35 or more and not ambiguous; uncertain: overlap 0.10 or
    more or within the tolerance; else absent. Of present references that claim one line and
    overlap each other by 0.35, all but the best scored (the first of equals) are uncertain;
    an absence between two presences is, too."""
    b = side(lines.withColumnRenamed("period", "_period").withColumnRenamed("width", "_width"), "b", "_period", "_width")
    b = b.withColumnsRenamed({"b_period": "period", "b_width": "width"})
    best = best_match(side(references, "a"), b, tolerance, cell, "period")
    periods = lines.select("period").distinct()  # as many as the calendar has
    every = references.select(F.col("line_id").alias("a_id")).join(F.broadcast(periods), how="cross")
    rows = every.join(best, ["a_id", "period"], "left")
    good = (F.col("overlap") >= 0.35) & (F.col("score") >= 0.48) & ~F.col("ambiguous")
    weak = (F.col("overlap") >= 0.10) | (F.col("distance") <= tolerance)
    rows = materialise(rows.withColumn("status", F.when(good, "present").when(weak, "uncertain").otherwise("absent")), "observed")

    claims = rows.where("status = 'present'").select("period", "b_id", "a_id", "score", *[f"a{c}" for c in XY])
    shared = claims.join(claims.groupBy("period", "b_id").agg(F.count("*").alias("n")).where("n > 1"), ["period", "b_id"]).drop("n")
    doubled = shared.groupBy("period", "b_id").applyInPandas(lambda one: _doubled(one, max(tolerance, 0.1)), "period int, a_id long, owned boolean")
    rows = rows.join(doubled, ["period", "a_id"], "left").withColumn("status", F.when(F.col("owned"), "uncertain").otherwise(F.col("status")))
    reason = F.when(F.col("owned"), "duplicate_source_ownership").when(F.col("status") == "uncertain", "ambiguous_or_weak_match")
    by = Window.partitionBy("a_id").orderBy("period")
    alone = (F.lag("status").over(by) == "present") & (F.col("status") == "absent") & (F.lead("status").over(by) == "present")
    rows = rows.withColumn("reason", reason).withColumn("dropout", F.coalesce(alone, F.lit(False)))
    status = F.when(F.col("dropout"), "uncertain").otherwise(F.col("status"))
    width = F.when(F.col("status") == "present", F.col("width"))
    figures = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("overlap", "score", "dir_sim")]
    why = F.when(F.col("dropout"), "single_period_dropout").otherwise(F.coalesce("reason", F.lit("")))
    return rows.select(F.col("a_id").alias("road_id"), "period", status.alias("status"), width.alias("width_m"), *figures, F.col("distance").alias("geom_dev_m"), F.col("b_id").alias("source_id"), why.alias("qa_reason"))


def _cover(p: list[float], q: list[float], reach: float) -> float:
    """Share of line p within reach of line q, as geometry.segment_cover, of plain numbers."""
    ax, ay, dx, dy = p[0], p[1], p[2] - p[0], p[3] - p[1]
    size, long = (dx * dx + dy * dy) ** 0.5, ((q[2] - q[0]) ** 2 + (q[3] - q[1]) ** 2) ** 0.5
    if size <= 0:
        return 0.0
    ex, ey = ((q[2] - q[0]) / long, (q[3] - q[1]) / long) if long > 0 else (1.0, 0.0)
    u, v, du, dv = (ax - q[0]) * ex + (ay - q[1]) * ey, (ay - q[1]) * ex - (ax - q[0]) * ey, dx * ex + dy * ey, dy * ex - dx * ey
    found = []
    for at in (0.0, long):
        half, far = (u - at) * du + v * dv, (u - at) ** 2 + v * v - reach * reach
        if (d := half * half - size * size * far) >= 0:
            found.append(((-half - d**0.5) / size**2, (-half + d**0.5) / size**2))
    low, high = float("-inf"), float("inf")
    for start, step, lo, hi in ((v, dv, -reach, reach), (u, du, 0.0, long)):
        if step == 0:
            low, high = (low, high) if lo <= start <= hi else (1.0, 0.0)
        else:
            low, high = max(low, min((lo - start) / step, (hi - start) / step)), min(high, max((lo - start) / step, (hi - start) / step))
    if low <= high:
        found.append((low, high))
    return max(0.0, min(1.0, max(x[1] for x in found)) - max(0.0, min(x[0] for x in found))) if found else 0.0


def _doubled(rows: pd.DataFrame, reach: float) -> pd.DataFrame:
    """Of references that claim one line of one period, those that a better one covers. The
    group is the references a line can match: those within reach of it."""
    rows = rows.sort_values(["score", "a_id"], ascending=[False, True])
    kept, gone = [], []
    for r in rows.itertuples():
        line = [r.ax1, r.ay1, r.ax2, r.ay2]
        if any(min(_cover(line, k, reach), _cover(k, line, reach)) >= 0.35 for k in kept):
            gone.append((r.period, r.a_id, True))
        else:
            kept.append(line)
    return pd.DataFrame(gone, columns=["period", "a_id", "owned"])


def references(lines: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """One line for each road of lines (period, line_id, x1, ...): line_id from 0 and
    born_period. Period after period, lines whose best match among the references (score, then
    overlap) has a score of 0.48 and an overlap of 0.35 are known; the others are taken in the
    order of line_id, unless the best scored of those taken before matches as well. That
    order only matters inside a connected group of near lines, which a task gets whole."""
    score = scores(tolerance)

    def earlier(x, y, distance, at):
        # a line that scores less than 0.48 is never a match, nor better than one
        _, found = score(x, y, distance, at)
        kept = np.flatnonzero((at("b_id") < at("a_id")) & (found["score"] >= 0.48))
        return kept, {c: found[c][kept] for c in ("score", "overlap")}

    periods = [r.period for r in lines.select("period").distinct().orderBy("period").collect()]
    held = None
    for period in periods:
        new = lines.where(F.col("period") == period).select("line_id", *XY)
        if held is not None:
            known = best_match(side(new, "a"), side(held, "b"), tolerance, cell).where("score >= 0.48 AND overlap >= 0.35")
            new = materialise(new.join(known.select(F.col("a_id").alias("line_id")), "line_id", "left_anti"), "unmatched")
        pairs = near_lines(side(new, "a"), side(new, "b"), max(tolerance, 0.1), cell, earlier, ("a_id", "b_id", "score", "overlap"))
        pairs = materialise(pairs, "near")
        parts = star_components(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
        grouped = pairs.join(parts, F.col("a_id") == F.col("node"), "left").select(F.coalesce("root", "a_id").alias("root"), "a_id", "b_id", "score", "overlap")
        dropped = grouped.groupBy("root").applyInPandas(_repeated, "line_id long")
        fresh = new.join(dropped, "line_id", "left_anti")
        fresh = dense_ids(fresh.withColumnRenamed("line_id", "_line"), "_line", "_place").withColumn("born_period", F.lit(period))
        offset = held.count() if held is not None else 0
        fresh = fresh.select((F.col("_place") + offset).alias("line_id"), *XY, "born_period")
        held = materialise(fresh if held is None else held.unionByName(fresh), "references")
    return held


def _repeated(pairs: pd.DataFrame) -> pd.DataFrame:
    """Lines of a connected group that one taken before stands for: of the pairs (a_id, b_id)
    of a line with lines before it, best first, the first taken one decides."""
    order = np.lexsort((pairs.b_id, -pairs.score, pairs.a_id))
    a, b, good = pairs.a_id.to_numpy()[order], pairs.b_id.to_numpy()[order], pairs.overlap.to_numpy()[order] >= 0.35
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    line, before = place[: len(a)], place[len(a) :]
    starts, taken = np.searchsorted(line, np.arange(len(ids) + 1)), np.ones(len(ids), bool)
    for i in np.unique(line):
        own = slice(starts[i], starts[i + 1])
        held = taken[before[own]]
        if held.any():
            taken[i] = not good[own][held.argmax()]
    return pd.DataFrame({"line_id": ids[~taken]}, dtype="int64")


def road_ids(refs: DataFrame, prior: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """(line_id, road_id) of references: the ids of prior roads (line_id, road_id, x1, ...)
    that they match with a score of 0.65 and an overlap of 0.55, one to one by falling
    (score, overlap, reference, prior); the others get RD and eight digits, from the largest
    number there is, in their order. A blank prior id is no one's."""
    roads = prior.where("road_id <> ''")
    pairs = best_match(side(refs, "a"), side(prior, "b"), tolerance, cell).where("score >= 0.65 AND overlap >= 0.55")
    pairs = materialise(pairs.join(roads.select(F.col("line_id").alias("b_id"), "road_id"), "b_id").select("a_id", "b_id", "road_id", "score", "overlap"), "prior")
    # each reference has one candidate, so a greedy choice is the best claim on each prior
    best = F.max(F.struct("score", "overlap", "a_id")).getField("a_id").alias("line_id")
    held = pairs.groupBy("b_id").agg(best, F.first("road_id").alias("road_id")).select("line_id", "road_id")
    number = F.regexp_extract("road_id", r"^RD(\d+)$", 1)
    top = prior.select(F.max(F.when(number != "", number.cast("long")))).first()[0] or 0
    new = dense_ids(refs.select("line_id").join(held, "line_id", "left_anti"), "line_id", "_place")
    made = F.concat(F.lit("RD"), F.lpad((F.col("_place") + top + 1).cast("string"), 8, "0"))
    return held.unionByName(new.select("line_id", made.alias("road_id")))


def sampled_distances(first: str, second: str, spacing: float) -> Column:
    """Distances from evenly spaced places of one line to the other one, as an array."""
    size = g.length(*[F.col(f"{first}{c}") for c in XY])
    n = F.least(F.greatest(F.ceil(size / max(spacing, 0.25)) + 1, F.lit(3)), F.lit(101)).cast("int")
    x1, y1, x2, y2 = (F.col(f"{first}{c}") for c in XY)
    other = [F.col(f"{second}{c}") for c in XY]
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: g.point_segment(x1 + (x2 - x1) * k / (n - 1), y1 + (y2 - y1) * k / (n - 1), *other))


def median_distance(spacing: float) -> Column:
    """Median of the distances from places of either line to the other."""
    return g.median_of(F.concat(sampled_distances("a", "b", spacing), sampled_distances("b", "a", spacing)))


def endpoint_score(tolerance: float) -> Column:
    """Mean nearness of the four ends to the nearest end of the other line."""
    ends = lambda s: [(F.col(f"{s}x1"), F.col(f"{s}y1")), (F.col(f"{s}x2"), F.col(f"{s}y2"))]
    best = lambda p, others: F.least(*[g.length(*p, *q) for q in others])
    four = [best(p, ends("b")) for p in ends("a")] + [best(p, ends("a")) for p in ends("b")]
    near = [F.greatest(F.lit(0.0), 1 - d / max(3 * tolerance, 1e-6)) for d in four]
    return (near[0] + near[1] + near[2] + near[3]) / 4


def match_segments(
    before: DataFrame, after: DataFrame, tolerance: float = 3.0, cell: float = 20.0, cosine: float = 0.85, cover: float = 0.35, overlap: float = 3.0, spacing: float = 2.0, slack: float = 0.75, related: bool = True
) -> DataFrame:
    """Pairs of segments of two periods that are one road, with their scores and relation.

    Near pairs must point the same way, cover one another, and lie close on the median; of
    those only the pairs stay that are no more than `slack` beyond the closest of either side.
    relation: by how many segments of each period the connected group has; left out with its
    rounds where not `related`."""
    a, b = (rows.join(snap_degrees(rows, tolerance), "line_id") for rows in (before, after))
    degree = lambda s: F.col(f"{s}start_degree") + F.col(f"{s}end_degree")

    def alike(x, y, distance, at):
        kept = np.flatnonzero(sg.abs_cosine(x, y) >= cosine)
        narrow = lambda kept, ok: (kept[ok], tuple(c[kept[ok]] for c in x), tuple(c[kept[ok]] for c in y))
        kept, p, q = narrow(kept, slice(None))
        covers, sizes = (sg.cover(p, q, tolerance), sg.cover(q, p, tolerance)), (sg.length(*p), sg.length(*q))
        ok = (np.maximum(*covers) >= cover) & (np.minimum(covers[0] * sizes[0], covers[1] * sizes[1]) >= overlap)
        kept, p, q = narrow(kept, ok)
        middle = sg.median_distance(p, q, spacing)
        near = middle <= tolerance
        kept, p, q = narrow(kept, near)
        found = {"a_cover": covers[0], "b_cover": covers[1], "a_length": sizes[0], "b_length": sizes[1]}
        found = {c: v[ok][near] for c, v in found.items()} | {"median_distance": middle[near]}
        return kept, found | {"direction": sg.abs_cosine(p, q), "ends": sg.endpoint_score(p, q, tolerance)}

    given = ("a_id", "b_id", "astart_degree", "aend_degree", "bstart_degree", "bend_degree", "a_cover", "b_cover", "a_length", "b_length", "median_distance", "direction", "ends")
    pairs = near_lines(side(a, "a", "start_degree", "end_degree"), side(b, "b", "start_degree", "end_degree"), max(tolerance, 0.1), cell, alike, given)
    ratio = F.least("a_length", "b_length") / F.greatest("a_length", "b_length", F.lit(1e-9))
    topology = 1 - F.least(F.lit(1.0), F.abs(degree("a") - degree("b")) / 4.0)
    score = (
        0.30 * F.greatest("a_cover", "b_cover") + 0.10 * F.least("a_cover", "b_cover") + 0.25 * F.greatest(F.lit(0.0), 1 - F.col("median_distance") / max(tolerance, 1e-6))
        + 0.20 * F.col("direction") + 0.05 * F.col("ends") + 0.05 * ratio + 0.05 * topology
    )
    raw = materialise(pairs.withColumn("score", score).select("a_id", "b_id", "a_cover", "b_cover", "median_distance", "direction", "score"), "pairs")
    best = lambda c: F.min("median_distance").over(Window.partitionBy(c)) + slack
    valid = raw.withColumn("_a", best("a_id")).withColumn("_b", best("b_id")).where("median_distance <= _a AND median_distance <= _b").drop("_a", "_b")
    valid = materialise(valid, "matches")
    discard(raw)
    return valid.join(relations(valid), ["a_id", "b_id"]) if related else valid


#: Pairs that one task joins to groups at most: such as hold the groups together, so fewer than ids.
GROUP_PAIRS = 2_000_000


def relations(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, part, relation) of pairs: the connected group, named by its smallest a, and
    one_to_one, one_to_many, many_to_one or partial by its numbers of a and b.

    Each partition keeps only as many pairs as hold its groups together. Where few enough are
    left one task joins them to groups, else that goes on in star rounds."""
    few = materialise(pairs.select(*[F.col(c).cast("long").alias(c) for c in ("a_id", "b_id")]).mapInArrow(_held_together, "a_id long, b_id long"), "groups")
    if few.count() <= GROUP_PAIRS:
        sized = few.repartition(1).mapInArrow(_sized, "a_id long, part long, na long, nb long")
    else:
        node = lambda i, c: F.struct(F.lit(i).alias("s"), F.col(c).alias("id"))
        parts = star_components(few.select(node(0, "a_id").alias("a"), node(1, "b_id").alias("b")))
        own = few.join(parts, node(0, "a_id") == F.col("node"), "left").select("a_id", "b_id", F.coalesce("root.id", "a_id").alias("part"))
        # a part's ids are counted in sets of its own pairs
        sizes = own.groupBy("part").agg(F.count_distinct("a_id").alias("na"), F.count_distinct("b_id").alias("nb"))
        sized = own.select("a_id", "part").distinct().join(sizes, "part")
    label = F.when((F.col("na") == 1) & (F.col("nb") == 1), "one_to_one").when(F.col("na") == 1, "one_to_many").when(F.col("nb") == 1, "many_to_one").otherwise("partial")
    return pairs.join(sized, "a_id").select("a_id", "b_id", "part", label.alias("relation"))


def _groups(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of all pairs (a_id, b_id): the ids of a, then of b, how many are of a, and each one's
    group, the place of its first. None if there are no pairs."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    (a, u), (b, v) = (np.unique(np.concatenate([x.column(c).to_numpy() for x in held]), return_inverse=True) for c in ("a_id", "b_id"))
    v = v + len(a)
    group = np.arange(len(a) + len(b))
    while len(u):
        # a group goes to the least of those it meets: at least half of those that meet one go
        p, q = group[u], group[v]
        apart = p != q
        u, v, p, q = u[apart], v[apart], p[apart], q[apart]
        np.minimum.at(group, np.maximum(p, q), np.minimum(p, q))
        while ((up := group[group]) != group).any():
            group = up
    return np.concatenate([a, b]), len(a), group


def _held_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that hold the groups together: each b with the group's first a, each other a with
    its first b."""
    if (found := _groups(batches)) is None:
        return
    ids, n, group = found
    first = np.full(len(ids), -1)
    last = np.arange(len(ids) - 1, n - 1, -1)
    first[group[last]] = last  # the least is written last
    other = np.flatnonzero(group[:n] != np.arange(n))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[group[n:]], ids[other]])), pa.array(np.concatenate([ids[n:], ids[first[group[other]]]]))], names=["a_id", "b_id"])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a_id, part, na, nb): the group of each a, named by its first a, and its numbers."""
    if (found := _groups(batches)) is None:
        return
    ids, n, group = found
    na, nb = (np.bincount(g, minlength=len(ids)) for g in (group[:n], group[n:]))
    own = group[:n]
    yield pa.RecordBatch.from_arrays([pa.array(ids[:n]), pa.array(ids[own]), pa.array(na[own]), pa.array(nb[own])], names=["a_id", "part", "na", "nb"])


def width_rejection(before: Column, after: Column, graded: Column, valid: Column, aligned: Column, absolute: float = 2.0, ratio: float = 0.2, most: float = 0.75, least_valid: float = 0.6, least_aligned: float = 0.7) -> Column:
    """What comes of a pair's change of width: none, or a candidate, or by what it is rejected,
    in this order: excessive, missing, quality; unsupported if too little of it is valid."""
    moved = after - before
    relative = F.abs(moved) / F.greatest(before, after, F.lit(0.1))
    met = (F.abs(moved) >= absolute) & (relative >= ratio)
    return (
        F.when(~met, "none")
        .when(relative > most, "excessive")
        .when((before <= 0) | (after <= 0), "missing")
        .when(~graded, "quality")
        .when((valid >= least_valid) & (aligned >= least_aligned), "candidate")
        .otherwise("unsupported")
    )


def interval_on(first: str, second: str, tolerance: float) -> Column:
    """(start, end) along line `first` between the projections of the ends of `second`; null
    where it has no length or its middle is farther than the tolerance from `second`."""
    own, other = [F.col(f"{first}{c}") for c in XY], [F.col(f"{second}{c}") for c in XY]
    size = g.length(*own)
    p, q = (g.project(other[i], other[i + 1], *own) * size for i in (0, 2))
    start, end = F.least(p, q), F.greatest(p, q)
    at = F.try_divide((start + end) / 2, size)
    middle = g.point_segment(own[0] + at * (own[2] - own[0]), own[1] + at * (own[3] - own[1]), *other)
    return F.when((end - start > 1e-6) & (middle <= tolerance), F.struct(start.alias("start"), end.alias("end")))


def intervals_on(a: DataFrame, b: DataFrame, tolerance: float, cell: float, united: bool = False) -> DataFrame:
    """(a_id, b_id, start, end) of near lines a and b: interval_on() where there is one. united:
    (a_id, start, end), overlapping ones of a block's lines made one."""

    def measure(x, y, distance, at):
        start, end, counts = sg.interval(x, y, tolerance)
        kept = np.flatnonzero(counts)
        if not united:
            return kept, {"start": start[kept], "end": end[kept]}
        first, start, end = sg.united(at("a_id")[kept], start[kept], end[kept])
        return kept[first], {"start": start, "end": end}

    return near_lines(a, b, tolerance, cell, measure, ("a_id", "start", "end") if united else ("a_id", "b_id", "start", "end"))


def line_components(lines: DataFrame, tolerance: float = 0.5, cosine: float = 0.75, cell: float = 20.0) -> DataFrame:
    """(line_id, part) of lines (line_id, x1, ..., sign): connected groups of lines of one
    sign that lie within the tolerance and point the same way; named by the smallest id."""
    pairs = near_lines(side(lines, "a", "sign"), side(lines, "b", "sign"), tolerance, cell)
    pairs = pairs.where((F.col("a_id") < F.col("b_id")) & (F.col("asign") == F.col("bsign"))).where(direction() >= cosine)
    parts = star_components(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    return lines.select("line_id").join(parts, F.col("line_id") == F.col("node"), "left").select("line_id", F.coalesce("root", "line_id").alias("part"))


def crossings(lines: DataFrame, cell: float) -> DataFrame:
    """(a_id, b_id, x, y): where lines cross, each pair once; not at ends, not on one line."""

    def measure(p, q, distance, at):
        x, y, met = sg.crossing(p, q)
        kept = np.flatnonzero(met & (at("a_id") < at("b_id")))
        return kept, {"x": x[kept], "y": y[kept]}

    return near_lines(side(lines, "a"), side(lines, "b"), 0.0, cell, measure, ("a_id", "b_id", "x", "y"))


def nearest_line(points: DataFrame, lines: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """(id, line_id, distance, x, y): the nearest line of each point (id, x, y) within the
    tolerance, the smallest id of equals, and the place on it."""
    dots = points.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"a{c}{i}") for i in (1, 2) for c in ("x", "y")])
    pairs = near_lines(dots, side(lines, "b"), tolerance, cell)
    best = pairs.groupBy("a_id").agg(F.min(F.struct("distance", "b_id", "ax1", "ay1", *[f"b{c}" for c in XY])).alias("m")).select("a_id", "m.*")
    t = g.project(F.col("ax1"), F.col("ay1"), *[F.col(f"b{c}") for c in XY])
    place = lambda c: (F.col(f"b{c}1") + t * (F.col(f"b{c}2") - F.col(f"b{c}1"))).alias(c)
    return best.select(F.col("a_id").alias("id"), F.col("b_id").alias("line_id"), "distance", place("x"), place("y"))


def snapped(points: DataFrame, nodes: DataFrame, lines: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """(id, target, kind): where each point (id, x, y) snaps to: the nearest node within the
    tolerance, else the nearest line, else nothing. A point's own node and the lines at it
    (src or dst is its id) don't count."""
    from waymark.operators.match import nearest, pairs_within

    a = points.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    node = materialise(nearest(pairs_within(a, b, tolerance).where("a_id <> b_id").select("a_id", "b_id", "distance")), "snapped")
    # a point with a node near needs no line
    dots = points.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"a{c}{i}") for i in (1, 2) for c in ("x", "y")]).join(node, "a_id", "left_anti")

    def closest(x, y, distance, at):
        other = np.flatnonzero((at("a_id") != at("bsrc")) & (at("a_id") != at("bdst")))
        return other[sg.leading([at("a_id")[other]], [distance[other], at("b_id")[other]])], {}

    met = near_lines(dots, side(lines, "b", "src", "dst"), tolerance, cell, closest, ("a_id", "b_id", "distance"))
    edge = met.groupBy("a_id").agg(F.min(F.struct("distance", "b_id")).getField("b_id").alias("line"))
    out = points.select(F.col("id").alias("a_id")).join(node, "a_id", "left").join(edge, "a_id", "left")
    kind = F.when(F.col("b_id").isNotNull(), "node").when(F.col("line").isNotNull(), "edge").otherwise("none")
    return out.select(F.col("a_id").alias("id"), F.coalesce("b_id", "line").alias("target"), kind.alias("kind"))


def without_near(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Points (id, x, y) farther than the radius from all others (x, y); all if there are none."""
    from waymark.operators.match import pairs_within

    a = points.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = others.select(F.lit(0).alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return points.join(pairs_within(a, b, radius).select(F.col("a_id").alias("id")).distinct(), "id", "left_anti")


def neighbours_in_patch(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(patch, id, place, near): the k nearest other points of each point (patch, id, x, y) in
    its patch, closer than the radius, by (distance, id)."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = points.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    b = points.select("patch", F.col("id").alias("near"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    b = b.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumn("cx", cell("nx") + F.col("dx")).withColumn("cy", cell("ny") + F.col("dy")).drop("dx", "dy")
    d = g.length(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    met = a.join(b, ["patch", "cx", "cy"]).withColumn("distance", d).where((F.col("distance") < radius) & (F.col("id") != F.col("near")))
    place = F.row_number().over(Window.partitionBy("patch", "id").orderBy("distance", "near"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("patch", "id", "place", "near")


def edge_values(edges: DataFrame, records: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """(line_id, value): mean of the records (line_id, x1, ..., value) with the same rounded
    ends in either order, else that of the nearest one within the tolerance (by the farther
    of its two ends, in the better order; the first key of equals), else null."""
    end = lambda p, i: F.struct(F.rint(f"{p}y{i}").cast("long").alias("r"), F.rint(f"{p}x{i}").cast("long").alias("c"))
    key = lambda p="": F.struct(F.least(end(p, 1), end(p, 2)).alias("s"), F.greatest(end(p, 1), end(p, 2)).alias("t"))
    known = materialise(records.groupBy(key().alias("key")).agg(F.avg("value").alias("value")), "records")
    exact = edges.withColumn("key", key()).join(known, "key", "left")
    places = {f"b{c}{i}": F.col(f"key.{s}.{f}").cast("double") for i, s in ((1, "s"), (2, "t")) for c, f in (("x", "c"), ("y", "r"))}
    b = known.withColumns(places).select(F.col("key").alias("b_id"), "value", *places)
    a = side(exact.where("value IS NULL"), "a")
    met = near_lines(a, b, tolerance, cell)
    ends = lambda i, j: g.length(F.col(f"ax{i}"), F.col(f"ay{i}"), F.col(f"bx{j}"), F.col(f"by{j}"))
    off = F.least(F.greatest(ends(1, 1), ends(2, 2)), F.greatest(ends(1, 2), ends(2, 1)))
    near = met.withColumn("off", off).where(F.col("off") <= tolerance).groupBy("a_id").agg(F.min(F.struct("off", "b_id", "value")).getField("value").alias("near"))
    return exact.join(near, F.col("line_id") == F.col("a_id"), "left").select("line_id", F.coalesce("value", "near").alias("value"))
