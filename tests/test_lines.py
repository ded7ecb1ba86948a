"""Line matching, networks and widths on hand-made cases and against brute force."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import graph, lifecycle, lines, network, widths

LINE = "line_id long, x1 double, y1 double, x2 double, y2 double"


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, LINE + more)


def seen(spark, rows, tolerance=3.0):
    every = spark.createDataFrame(rows, "period int, " + LINE + ", width double")
    refs = lines.references(every, tolerance, 50.0)
    return refs, lines.observations(refs, every, tolerance, 50.0)


def test_appear_and_widen(spark):
    a, b = (0.0, 0.0, 100.0, 0.0), (0.0, 30.0, 100.0, 30.0)
    refs, obs = seen(spark, [(2021, 0, *a, 4.0), (2022, 1, *a, 4.0), (2022, 2, *b, 5.0), (2023, 3, *a, 6.0), (2023, 4, *b, 5.0)])
    assert refs.count() == 2 and obs.count() == 6
    status = {(r.road_id, r.period): r.status for r in obs.collect()}
    assert [status[1, p] for p in (2021, 2022, 2023)] == ["absent", "present", "present"]
    events = {(r.road_id, r.to_per, r.event_typ) for r in lifecycle.transitions(obs, 1.0, 0.1).collect()}
    assert events == {(1, 2022, "added"), (0, 2023, "widened")}


def test_single_dropout_is_uncertain(spark):
    a, b = (0.0, 0.0, 100.0, 0.0), (0.0, 50.0, 100.0, 50.0)
    rows = [(2021, 0, *a, 4.0), (2023, 1, *a, 4.0)] + [(p, i + 2, *b, 4.0) for i, p in enumerate((2021, 2022, 2023))]
    _, obs = seen(spark, rows)
    unsure = obs.where("status = 'uncertain'").collect()
    assert [(r.period, r.qa_reason) for r in unsure] == [(2022, "single_period_dropout")]


def test_perpendicular_lines_are_two_roads(spark):
    refs, obs = seen(spark, [(2021, 0, -50.0, 0.0, 50.0, 0.0, 4.0), (2022, 1, 0.0, -50.0, 0.0, 50.0, 4.0)])
    assert refs.count() == 2 and obs.agg(F.min("dir_sim")).first()[0] < 0.1


def test_references_that_claim_one_line_together(spark):
    refs = table(spark, [(0, 0.0, 0.0, 100.0, 0.0), (1, 0.0, 0.5, 100.0, 0.5), (2, 0.0, 0.2, 40.0, 0.2)])
    one = spark.createDataFrame([(1, 9, 0.0, 0.0, 100.0, 0.0, 5.0)], "period int, " + LINE + ", width double")
    got = {r.road_id: (r.status, r.qa_reason) for r in lines.observations(refs, one, 3.0, 50.0).collect()}
    assert got[0] == ("present", "") and got[1] == ("uncertain", "duplicate_source_ownership")


def test_cover_equals_sampling(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(float(x) for x in rng.uniform(0, 6, 8)) for _ in range(60)] + [(0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 2.0, 2.0), (0.0, 0.0, 4.0, 0.0, 1.0, 0.5, 1.0, 0.5), (0.0, 0.0, 4.0, 0.0, 1.0, 1.0, 3.0, 1.0)]
    from waymark.functions import geometry as g

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} double" for k in range(8)))
    cols = [F.col(f"c{k}") for k in range(8)]
    got = {r.i: (r.c, r.d) for r in df.select("i", g.segment_cover(*cols, 1.0).alias("c"), g.segment_distance(*cols).alias("d")).collect()}

    def off(px, py, b):
        dx, dy = b[2] - b[0], b[3] - b[1]
        n = dx * dx + dy * dy
        t = min(max(((px - b[0]) * dx + (py - b[1]) * dy) / n, 0), 1) if n else 0
        return math.hypot(px - b[0] - t * dx, py - b[1] - t * dy)

    for i, r in enumerate(rows):
        a, b = r[:4], r[4:]
        places = [off(a[0] + (a[2] - a[0]) * t, a[1] + (a[3] - a[1]) * t, b) for t in np.linspace(0, 1, 4001)]
        want = np.mean(np.array(places) <= 1.0) if a[:2] != a[2:] else 0.0
        assert abs(got[i][0] - want) < 2e-3 and abs(got[i][1] - min(places)) < 5e-3, (i, r)
        assert abs(lines._cover(list(a), list(b), 1.0) - got[i][0]) < 1e-9


def test_references_equal_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        x, y, p = rng.uniform(0, 12), rng.uniform(0, 12), rng.randint(1, 3)
        rows.append((p, i, x, y, x + rng.uniform(2, 5), y + rng.uniform(-0.5, 0.5)))
    every = spark.createDataFrame(rows, "period int, " + LINE)
    got = sorted(tuple(round(v, 6) for v in r[1:5]) + (r.born_period,) for r in lines.references(every, 1.0, 4.0).collect())

    def score(a, b):
        overlap = min(lines._cover(a, b, 1.0), lines._cover(b, a, 1.0))
        d = [math.hypot(v[2] - v[0], v[3] - v[1]) for v in (a, b)]
        cos = abs((a[2] - a[0]) * (b[2] - b[0]) + (a[3] - a[1]) * (b[3] - b[1])) / (d[0] * d[1])
        steps = np.linspace(0, 1, 400)
        p = np.array([[a[0] + (a[2] - a[0]) * t, a[1] + (a[3] - a[1]) * t] for t in steps])
        q = np.array([[b[0] + (b[2] - b[0]) * t, b[1] + (b[3] - b[1]) * t] for t in steps])
        dist = np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)).min()
        return 0.65 * overlap + 0.2 * cos + 0.15 * max(0, 1 - dist), overlap

    refs = []
    for period in (1, 2, 3):
        held, new = list(refs), []
        for _, _, *line in sorted(r for r in rows if r[0] == period):
            known = max((score(line, r[0]) for r in held), default=(0, 0))
            if known[0] >= 0.48 and known[1] >= 0.35:
                continue
            near = max((score(line, r[0]) for r in new), default=(0, 0))
            if near[0] >= 0.48 and near[1] >= 0.35:
                continue
            new.append((line, period))
        refs += new
    want = sorted(tuple(round(v, 6) for v in line) + (p,) for line, p in refs)
    assert got == want


def test_road_ids_are_kept(spark):
    refs = table(spark, [(0, 0.0, 0.0, 50.0, 0.0), (1, 0.0, 1.0, 50.0, 1.0), (2, 0.0, 90.0, 50.0, 90.0), (3, 0.0, 200.0, 9.0, 200.0)])
    prior = table(spark, [(0, 0.0, 0.9, 50.0, 0.9, "RD00000007"), (1, 0.0, 90.0, 50.0, 90.0, ""), (2, 500.0, 0.0, 600.0, 0.0, "RD00000041")], ", road_id string")
    got = {r.line_id: r.road_id for r in lines.road_ids(refs, prior, 3.0, 50.0).collect()}
    assert got == {1: "RD00000007", 0: "RD00000042", 2: "RD00000043", 3: "RD00000044"}


def net(spark, edges):
    ids = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(i, float(i), float(i % 3)) for i in ids], "node long, x double, y double")
    return nodes, spark.createDataFrame(edges, "src long, dst long")


def test_chains_and_bridges_of_rings_loops_and_tails(spark):
    #  0-1-2, ring 2-3-4-2, 2-5-6, lone ring 10-11-12-10
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 2), (2, 5), (5, 6), (10, 11), (11, 12), (12, 10), (1, 0), (7, 7)]
    nodes, e = net(spark, edges)
    of, t = network.chains(nodes, e)
    assert sorted((r.edges, r.start, r.end, r.start_degree, r.end_degree) for r in t.collect()) == [(2, 0, 2, 1, 4), (2, 2, 6, 4, 1), (3, 2, 2, 4, 4), (3, 10, 10, 2, 2)]
    assert of.count() == 10
    assert sorted((r.src, r.dst) for r in network.bridges(e).collect()) == [(0, 1), (1, 2), (2, 5), (5, 6)]


def test_bridges_equal_brute_force(spark):
    rng = random.Random(8)
    edges = list({tuple(sorted(rng.sample(range(26), 2))) for _ in range(30)})

    def parts(es):
        root = list(range(26))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in es:
            root[find(a)] = find(b)
        return sum(find(i) == i for i in range(26))

    want = sorted(e for e in edges if parts([x for x in edges if x != e]) > parts(edges))
    assert sorted(tuple(r) for r in network.bridges(net(spark, edges)[1]).collect()) == want


def test_merge_split_and_reach(spark):
    nodes, e = net(spark, [(0, 1), (1, 2), (2, 3)])
    moved = network.merge_nodes(e, spark.createDataFrame([(2, 0)], "source long, target long"))
    assert sorted(tuple(r) for r in moved.collect()) == [(0, 1), (0, 3)]
    _, split = network.split_edges(nodes, e, spark.createDataFrame([(1, 2, 9, 1.5, 0.0)], "src long, dst long, node long, x double, y double"))
    assert sorted((r.src, r.dst) for r in split.collect()) == [(0, 1), (1, 9), (2, 3), (9, 2)]
    one = lambda i: spark.createDataFrame([(i,)], "node long")
    assert {(r.node, r.depth) for r in network.reach(e, one(0), one(2), 9).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_greedy_matches_equal_a_sort(spark):
    from waymark.operators import match

    rng = random.Random(3)
    pairs = [(a, b, round(rng.uniform(0, 9), 1)) for a, b in itertools.product(range(9), range(7)) if rng.random() < 0.4]
    df = spark.createDataFrame(pairs, "a_id long, b_id long, distance double")
    parts = graph.components(df.select(F.explode(F.array("a_id", -1 - F.col("b_id"))).alias("node")).distinct(), df.select(F.col("a_id").alias("src"), (-1 - F.col("b_id")).alias("dst")))
    got = match.greedy_one_to_one(df, parts.where("node >= 0").select(F.col("node").alias("a_id"), F.col("component").alias("part")))
    want, used = set(), set()
    for a, b, d in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            want.add((a, b, d))
    assert {tuple(r) for r in got.collect()} == want


def test_pchip_keeps_anchors_and_shape():
    x, y = np.array([0.0, 1, 3, 4, 7, 8]), np.array([1.0, 2, 2, 5, 6, 1])
    at = np.linspace(-1, 9, 2001)
    out = widths.pchip(x, y, at)
    assert np.allclose(widths.pchip(x, y, x), y) and out[0] == 1 and out[-1] == 1
    for i in range(len(x) - 1):
        part = out[(at >= x[i]) & (at <= x[i + 1])]
        assert part.min() >= min(y[i], y[i + 1]) - 1e-9 and part.max() <= max(y[i], y[i + 1]) + 1e-9
    assert np.allclose(widths.pchip(np.array([0.0, 2]), np.array([1.0, 5]), np.array([0.5])), 2)
    assert widths.pchip(x[:0], y[:0], at).sum() == 0 and set(widths.pchip(x[:1], y[:1], at)) == {1.0}


def test_graded_fit():
    p = np.arange(8) * 2.0
    v = np.array([4.0, 5, 0, 6, 60, 6, 7, 8])
    g = np.array(["A", "B", "C", "A", "A", "B", "A", "C"])
    fit, kept, dropped = widths.side_profile(p, v, g)
    assert dropped.tolist() == [False] * 4 + [True] + [False] * 3 and fit[0] == 4 and fit[3] == 6 and fit[6] == 7
    exact = widths.pchip(p[[0, 3, 6]], v[[0, 3, 6]], p)
    assert fit[1] == pytest.approx(0.65 * exact[1] + 0.35 * 5)
    every = widths.pchip(p[[0, 1, 3, 5, 6]], v[[0, 1, 3, 5, 6]], p)
    assert fit[2] == pytest.approx(0.75 * exact[2] + 0.25 * every[2]) and fit[7] == 7


def test_fill_equals_brute_force(spark):
    rng = random.Random(4)
    edges = []
    for i, (a, b) in enumerate({tuple(sorted(rng.sample(range(18), 2))) for _ in range(26)}):
        t = rng.uniform(0, math.pi)
        edges.append((i, a, b, math.cos(t), math.sin(t), float(rng.randint(0, 9)), rng.random() < 0.4))
    df = spark.createDataFrame(edges, "edge_id long, src long, dst long, ux double, uy double, width double, reliable boolean")
    got = {r.edge_id: (r.how, round(r.width, 9)) for r in widths.filled(df, 5, 0.8).collect()}
    width = {i: w for i, _, _, _, _, w, r in edges if r and w >= 1}
    how = dict.fromkeys(width, "reliable")
    for _ in range(5):
        new = {}
        for i, a, b, ux, uy, _, _ in edges:
            if i in width:
                continue
            near = [(abs(ux * e[3] + uy * e[4]), width[e[0]]) for n in (a, b) for e in edges if e[0] != i and e[0] in width and n in e[1:3]]
            near = [x for x in near if x[0] >= 0.8]
            if near:
                top = max(x[0] for x in near)
                new[i] = float(np.median([w for c, w in near if c >= top - 0.05]))
        if not new:
            break
        width |= new
        how |= dict.fromkeys(new, "inherited")
    root = {x: x for e in edges for x in e[1:3]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for _, a, b, *_ in edges:
        root[find(a)] = find(b)
    known = dict(width)
    for i, a, *_ in edges:
        if i not in width:
            own = [w for j, w in known.items() if find(next(e[1] for e in edges if e[0] == j)) == find(a)]
            width[i], how[i] = (float(np.median(own)), "component") if own else (float(np.median(list(known.values()))), "global")
    assert got == {i: (how[i], round(width[i], 9)) for i in width}


def test_later_measurements_win(spark):
    edges = spark.createDataFrame([(i, 1, i * 10.0, i * 10.0 + 10, 5.0, "C") for i in range(6)] + [(9, 2, 0.0, 10.0, 5.0, "C")], "edge_id long, chain long, start double, end double, width double, grade string")
    rows = [(2, 1, 0, 8.0, 0.0, 30.0, None, None), (1, 1, 1, 20.0, None, None, 15.0, 20.0), (3, 1, 5, float("inf"), 0.0, 99.0, None, None), (4, 1, 5, -1.0, 0.0, 99.0, None, None)]
    m = spark.createDataFrame(rows, "order int, chain long, edge_id long, width double, low double, high double, anchor double, radius double")
    got = {r.edge_id: (round(r.width, 3), r.source) for r in widths.manual(edges, m).collect()}
    assert [got[i] for i in range(3)] == [(8.0, "manual_interval_width")] * 3
    assert got[3] == (5.0, "measured") and got[9] == (5.0, "measured")
    first = {r.edge_id: (round(r.width, 3), r.source) for r in widths.manual(edges, m.where("order = 1")).collect()}
    assert first[1] == (20.0, "manual_boundary_measurement") and first[2] == (8.75, "manual_anchor_adjusted") and first[4] == (5.0, "measured")


def test_calculators():
    assert widths.calculator() is widths.edge_summary and widths.calculator("math:hypot") is math.hypot
    with pytest.raises(ValueError):
        widths.calculator("math")
    with pytest.raises(TypeError):
        widths.calculator("math:pi")


def test_quantiles_of_any_size(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=501), 2).tolist()
    got = widths.exact_quantile(spark.createDataFrame([(x,) for x in v] + [(None,)], "v double"), "v", 0.0, 0.1, 0.5, 1.0).first()
    assert [got.q0, got.q1, got.q2, got.q3] == pytest.approx(np.quantile(v, [0, 0.1, 0.5, 1.0]).tolist()) and got.n == 501
    empty = widths.exact_quantile(spark.createDataFrame([], "v double"), "v", 0.5).first()
    assert empty.q0 is None and empty.n == 0


def test_rows_of_one_edge_id_take_the_median_at_all_their_ends(spark):
    edges = spark.createDataFrame([(7, 1, 2, 10.0), (7, 3, 4, 90.0), (8, 1, 5, 10.0), (9, 3, 6, 10.0), (10, 4, 6, 10.0)], "edge_id long, src long, dst long, length double")
    samples = spark.createDataFrame([(e, 0, w, 1.0, False, "") for e, w in ((8, 2.0), (9, 6.0), (10, 9.0))], "edge_id long, k long, width double, raw_width double, near_junction boolean, flags string")
    rows = widths.classified(samples, edges)
    assert [(r.final, r.status) for r in rows.where("edge_id = 7").collect()] == [(6.0, "interpolated_short_gap")] * 2


def test_a_variation_that_is_the_bound_is_not_above_it(spark):
    # orders of widths for which a running deviation divided by the median comes out above 0.3
    orders = [(4, 4, 6, 3, 6), (5, 9, 9, 8, 3), (4, 8, 4, 10, 8), (8, 10, 8, 11, 4), (8, 10, 8, 11, 3)]
    samples = spark.createDataFrame([(i, float(w), 1.0, False, None) for i, o in enumerate(orders) for w in o], "edge_id long, width double, raw_width double, near_junction boolean, flags string").coalesce(1)
    edges = spark.createDataFrame([(i, 2 * i, 2 * i + 1, 50.0) for i in range(len(orders))], "edge_id long, src long, dst long, length double")
    got = {r.edge_id: r for r in widths.profiles(samples, edges, 0.5, 30.0, 0.3).collect()}
    assert [got[i].confidence for i in range(5)] == ["high"] * 4 + ["medium"]
    assert [got[i].cv for i in range(4)] == [0.3] * 4 and got[2].std == 2.4
    assert math.isclose(got[4].std, float(np.std(orders[4])))
