"""Polylines, greedy groupings, splits and change on hand-made cases and against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import change, lifecycle, lines, masks, paths

POINTS = "id long, x double, y double, score double"


def cloud(seed, n=70, size=9.0):
    rng = random.Random(seed)
    return [(i, rng.uniform(0, size), rng.uniform(0, size), rng.randint(0, 25) / 20) for i in range(n)]


def test_suppression_equals_the_sequential_rule(spark):
    rows = cloud(1)
    got = {r.id for r in paths.suppressed(spark.createDataFrame(rows, POINTS), 1.5).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if r[3] > 1 or all(math.hypot(r[1] - k[1], r[2] - k[2]) > 1.5 for k in kept):
            kept.append(r)
    assert got == {r[0] for r in kept}


def test_branch_suppression_equals_the_sequential_rule(spark):
    rows = [(i, 0.5 * i, 0.0, 0.5) for i in range(20)] + [(30 + i, 0.5 * i, 1.0, 0.4) for i in range(20)] + [(60 + r[0], r[1] + 20, r[2], r[3]) for r in cloud(2, 40)]
    got = {r.id for r in paths.branch_suppressed(spark.createDataFrame(rows, POINTS), 2.0, 0.6, 0.8).collect()}
    p = np.array([r[1:3] for r in rows])
    t = []
    for a in p:
        near = p[np.hypot(*(p - a).T) <= 0.8]
        c = near - near.mean(axis=0)
        t.append(np.linalg.eigh(c.T @ c)[1][:, -1] if len(near) > 1 else np.array([1.0, 0.0]))
    active = np.ones(len(p), bool)
    for i in sorted(range(len(p)), key=lambda i: (-rows[i][3], rows[i][0])):
        if active[i]:
            for j in range(len(p)):
                d = p[j] - p[i]
                n = float(np.hypot(*d))
                if j == i or not active[j] or n > 2.0:
                    continue
                along = max(abs(d @ t[i]), abs(d @ t[j])) / max(n, 1e-6)
                active[j] = n > 0.6 and abs(t[i] @ t[j]) >= 0.9 and along <= 0.55
    assert got == {r[0] for r, a in zip(rows, active, strict=True) if a}
    assert {i for i in got if i < 20} and {i for i in got if 30 <= i < 50}  # both of two parallel rows stay


def test_leaders_equal_the_sequential_rule(spark):
    rows = cloud(3)
    got = {r.id: r.leader for r in paths.first_leaders(spark.createDataFrame(rows, POINTS), 1.2).collect()}
    heads, want = [], {}
    for i, x, y, _ in rows:
        want[i] = next((h[0] for h in heads if math.hypot(h[1] - x, h[2] - y) <= 1.2), i)
        if want[i] == i:
            heads.append((i, x, y))
    assert got == want
    two = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0), (1, 10.5, 0.0, 0.5, 0.0), (2, 0.0, 5.0, 10.0, 5.0)], "line_id long, x1 double, y1 double, x2 double, y2 double")
    assert {r.line_id: r.leader for r in paths.line_groups(two, 1.0, 5.0).collect()} == {0: 0, 1: 0, 2: 2}


def test_polylines(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)]), (2, [(5.0, 5.0), (5.0, 5.0)]), (3, [(1.0, 0.0), (0.0, 0.0)])], "line_id long, points array<struct<x: double, y: double>>")
    of = lambda df: {(r.line_id, r.j): (round(r.x, 6), round(r.y, 6)) for r in df.collect()}
    got = of(paths.resampled(rows, 2.5))
    assert got == {(1, 0): (0, 0), (1, 1): (2.5, 0), (1, 2): (3, 2), (1, 3): (3, 4), (2, 0): (5, 5), (3, 0): (1, 0)}
    assert of(paths.walked(rows.where("line_id = 1"), 2.5)) == {(1, 0): (0, 0), (1, 1): (2.5, 0), (1, 2): (3, 2), (1, 3): (3, 4)}
    assert of(paths.even_points(rows.where("line_id = 1"), 3)) == {(1, 0): (0, 0), (1, 1): (3, 0.5), (1, 2): (3, 4)}
    assert rows.where("line_id = 3").select(paths.oriented(F.col("points")).alias("p")).first().p[0].x == 0


def test_graph_of_lines_noding_and_splits(spark):
    xy = "line_id long, x1 double, y1 double, x2 double, y2 double"
    rows = spark.createDataFrame([(0, 0.0, 0.0, 4.0, 0.0), (1, 4.02, 0.0, 8.0, 0.0), (2, 2.0, -2.0, 2.0, 2.0), (3, 5.0, 5.0, 5.01, 5.0)], xy)
    nodes, edges = paths.graph_of_lines(rows)
    assert nodes.count() == 6 and sorted(tuple(r) for r in edges.collect()) == [(0, 1), (1, 3), (4, 5)]
    n, e = paths.noded(nodes, edges, 4.0)
    assert n.count() == 6 and e.count() == 5  # the crossing at (2, 0) splits two edges
    net = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 4.0, 0.2), (3, 7.0, -0.2), (4, 5.0, 5.0), (5, 10.3, 0.0)], "node long, x double, y double")
    one = spark.createDataFrame([(0, 1)], "src long, dst long")
    assert sorted(tuple(r) for r in paths.split_at_nodes(net, one, 0.5, 4.0).collect()) == [(0, 2), (1, 3), (2, 3)]
    inside = paths.in_polygon(rows, [(1.0, -1.0), (3.0, -1.0), (3.0, 1.0), (1.0, 1.0)])
    assert sorted(r.line_id for r in inside.collect()) == [0, 2] and paths.in_polygon(rows, [(0.0, 0.0)]).count() == 0


SEG = "line_id long, x1 double, y1 double, x2 double, y2 double, width double, grade string, valid double, aligned double"


def test_changes_of_two_periods(spark):
    seg = lambda rows: spark.createDataFrame([(*r, "A", 1.0, 1.0) for r in rows], SEG)
    before = seg([(0, 0.0, 0.0, 100.0, 0.0, 6.0), (1, 0.0, 60.0, 100.0, 60.0, 6.0), (2, 0.0, 200.0, 50.0, 200.0, 4.0)])
    after = seg([(0, 0.0, 1.8, 100.0, 1.8, 6.0), (1, 0.0, 60.0, 60.0, 60.0, 9.0), (3, 0.0, 300.0, 40.0, 300.0, 5.0)])
    got = sorted((r.change_typ, r.line_id, r.start, r.end, r.qa_state) for r in change.detected(before, after, 3.0, 50.0).collect())
    assert got == [("added", 3, 0.0, 40.0, "review"), ("removed", 1, pytest.approx(60.0), 100.0, "review"), ("removed", 2, 0.0, 50.0, "review"), ("widened", 1, 0.0, 60.0, "auto")]
    cross = change.detected(seg([(0, -50.0, 0.0, 50.0, 0.0, 6.0)]), seg([(0, 0.0, -50.0, 0.0, 50.0, 6.0)]), 3.0, 50.0)
    assert sorted(r.change_typ for r in cross.collect()) == ["added", "removed"]
    none = change.detected(before.limit(0), after.limit(0), 3.0, 50.0)
    assert none.count() == 0


def test_axis_and_coverage(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0, 10.0, 2.0, 0.0, 2.0, 1.0, 1.0), (0.0, 0.0, 10.0, 0.0, 0.0, 1.0, 10.0, 1.0, 3.0, 1.0), (0.0, 0.0, 10.0, 0.0, 0.0, 9.0, 10.0, 9.0, 1.0, 1.0)], ", ".join(f"{s}{c} double" for s in "ab" for c in lines.XY) + ", a_quality double, b_quality double")
    got = sorted((r.x1, r.y1, r.x2, r.y2) for r in change.axis(rows, 3.0).collect())
    assert got == [(0.0, 0.0, 10.0, 0.0), (0.0, 1.0, 10.0, 1.0)]
    line = "line_id long, x1 double, y1 double, x2 double, y2 double"
    own = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0), (1, 0.0, 50.0, 10.0, 50.0)], line)
    over = spark.createDataFrame([(5, 0.0, 0.5, 4.0, 0.5), (6, 2.0, -0.5, 6.0, -0.5)], line)
    got = {r.line_id: r.coverage for r in change.network_coverage(own, over, 1.0, 5.0).collect()}
    assert got[1] == 0.0 and got[0] == pytest.approx((6 + math.sqrt(0.75)) / 10)


def test_tables_of_a_life_cycle(spark):
    a, b = (0.0, 0.0, 100.0, 0.0), (0.0, 30.0, 100.0, 30.0)
    rows = [(2021, 0, *a, 4.0), (2022, 1, *a, 4.0), (2022, 2, *b, 5.0), (2023, 3, *a, 6.0), (2023, 4, *b, 5.0)]
    every = spark.createDataFrame(rows, "period int, line_id long, x1 double, y1 double, x2 double, y2 double, width double")
    got = lifecycle.built(every, 3.0, 50.0)
    assert sorted(r.road_id for r in got["roads"].collect()) == ["RD00000001", "RD00000002"]
    assert sorted((r.event_id, r.road_id, r.event_typ) for r in got["events"].collect()) == [("EV00000001", "RD00000001", "widened"), ("EV00000002", "RD00000002", "added")]
    life = {r.road_id: (r.first_obs, r.last_obs, r.life_state, r.present_n, r.event_n, r.review_st) for r in got["life"].collect()}
    assert life == {"RD00000001": (2021, 2023, "active", 3, 1, "auto"), "RD00000002": (2022, 2023, "active", 2, 1, "auto")}
    again = lifecycle.built(every, 3.0, 50.0, prior=got["roads"])
    assert sorted(r.road_id for r in again["roads"].collect()) == ["RD00000001", "RD00000002"]
    wide = {r.road_id: r for r in lifecycle.wide(got["observations"], got["events"], [2021, 2022, 2023]).collect()}
    one, two = wide["RD00000001"], wide["RD00000002"]
    assert (one.S2021, one.W2023, one.E20222023) == ("P", 6.0, "W") and (two.S2021, two.E20212022, two.W2021) == ("A", "A", None)
    grids = every.withColumn("grid", F.lit("g")).unionByName(every.where("period = 2021").withColumn("grid", F.lit("h")))
    assert list(lifecycle.built_grids(grids, 3.0, 50.0)) == ["g"]


def test_masks(spark):
    cells = [(1, r, c, 1.0) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4)] + [(1, 6, 6, 1.0), (2, 3, 3, 1.0)]
    p = spark.createDataFrame(cells, "tile_id long, row int, col int, value double")
    assert masks.holes(p, 8, 8).count() == 9
    assert sorted(r.area for r in masks.region_table(p).collect()) == [1, 1, 16]
    assert masks.cleaned(p, 0.5, 1, 1, 2, 8, 8).count() == 16
    assert masks.dilated(p.where("tile_id = 2"), 3, 8, 8).count() == 9 and masks.eroded(p.where("tile_id = 1"), 3, 8, 8).count() == 0
    full = spark.createDataFrame([(1, r, c, 1.0) for r in range(8) for c in range(8)], p.schema)
    assert masks.eroded(full, 3, 8, 8).count() == 64
