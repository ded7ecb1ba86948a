"""Blocks of lines: the arrays' geometry, full cells, and what a block leaves of its pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.functions import segments as sg
from waymark.operators import change, intervals, lines, network, paths
from waymark.plans import tiles

ODD = [(0, 0, 0, 0), (0, 0, 4, 0), (1, 0, 3, 0), (2, -1, 2, 1), (4, 0, 6, 0), (0, 1, 4, 1), (0, 0.5, 4, 0.5), (1, 1, 1, 1), (5, 5, 9, 9)]


def frame(spark, rows, *more):
    return spark.createDataFrame([(i, *map(float, r[:4]), *r[4:]) for i, r in enumerate(rows)], ["line_id", "x1", "y1", "x2", "y2", *more])


def arrays(rows):
    return tuple(np.array(rows, float).T)


@pytest.fixture(scope="module")
def crowd():
    """More lines in one cell than two blocks hold, some of them twice."""
    r = np.random.default_rng(7)
    start, step = r.uniform(0, 3, (lines.BLOCK + 90, 2)), r.normal(0, 1, (lines.BLOCK + 90, 2))
    rows = np.hstack([start, start + step])
    return np.vstack([rows, rows[:10]])


def test_arrays_equal_columns(spark):
    r = np.random.default_rng(3)
    pairs = [(p, q) for p in ODD for q in ODD] + [(tuple(r.uniform(0, 3, 4)), tuple(r.uniform(0, 3, 4))) for _ in range(100)]
    p, q = arrays([x for x, _ in pairs]), arrays([y for _, y in pairs])
    df = spark.createDataFrame([(i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(pairs)], ["i", *[f"{s}{c}" for s in "ab" for c in lines.XY]])
    part = g.segment_stretch(*lines.columns(), 0.7)
    both = df.select("i", g.segment_distance(*lines.columns()).alias("d"), lines.direction().alias("c"), part["low"].alias("low"), part["high"].alias("high"), lines.interval_on("a", "b", 0.7).alias("v"), lines.median_distance(0.5).alias("m"), lines.endpoint_score(0.7).alias("e"), g.crossing(*lines.columns()).alias("x"))
    rows = both.orderBy("i").collect()
    near = lambda got, want: np.testing.assert_allclose(np.array(got, float), np.array(want, float), atol=1e-9)
    near(sg.distance(p, q), [x.d for x in rows])
    near(sg.abs_cosine(p, q), [x.c for x in rows])
    for got, c in zip(sg.stretch(p, q, 0.7), ("low", "high"), strict=True):
        near(got, [np.nan if x[c] is None else x[c] for x in rows])
    start, end, counts = sg.interval(p, q, 0.7)
    assert counts.tolist() == [x.v is not None for x in rows]
    near(np.stack([start, end], 1)[counts], [tuple(x.v) for x in rows if x.v])
    near(sg.median_distance(p, q, 0.5), [x.m for x in rows])
    near(sg.endpoint_score(p, q, 0.7), [x.e for x in rows])
    x, y, met = sg.crossing(p, q)
    assert met.tolist() == [x.x is not None for x in rows]
    near(np.stack([x, y], 1)[met], [tuple(x.x) for x in rows if x.x])


def test_intervals_of_a_full_cell(spark, crowd):
    df = frame(spark, crowd.tolist())
    got = {(r.a_id, r.b_id): (r.start, r.end) for r in lines.intervals_on(lines.side(df, "a"), lines.side(df, "b"), 0.4, 50.0).collect()}
    i, j = (x.ravel() for x in np.indices((len(crowd), len(crowd))))
    p, q = arrays(crowd[i]), arrays(crowd[j])
    start, end, counts = sg.interval(p, q, 0.4)
    counts &= sg.distance(p, q) <= 0.4
    assert got == {(a, b): (s, e) for a, b, s, e in zip(i[counts].tolist(), j[counts].tolist(), start[counts].tolist(), end[counts].tolist(), strict=True)}


def test_pairs_of_a_full_cell_are_no_rows(spark, crowd):
    df = frame(spark, crowd.tolist())
    near = lines.near_lines(lines.side(df, "a"), lines.side(df, "b"), 0.4, 50.0)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :]
    assert "collect_list" in join and "MapInArrow" not in join
    assert near.columns == ["a_id", "ax1", "ay1", "ax2", "ay2", "b_id", "bx1", "by1", "bx2", "by2", "distance"]


def test_united_intervals_cover_the_same(spark, crowd):
    df = frame(spark, crowd.tolist())
    met = lambda u: lines.intervals_on(lines.side(df, "a"), lines.side(df, "b"), 0.4, 50.0, united=u)
    every = intervals.merge(met(False).select(F.col("a_id").alias("k"), "start", "end"), "k")
    few = met(True).withColumnRenamed("a_id", "k")
    assert sorted(map(tuple, intervals.merge(few, "k").collect())) == sorted(map(tuple, every.collect()))
    assert few.count() < met(False).count() / 20


def test_coverage_of_a_full_cell(spark, crowd):
    df = frame(spark, crowd.tolist())
    got = {r.line_id: r.coverage for r in change.network_coverage(df.where("line_id < 40"), df.where("line_id % 9 = 0"), 0.05, 50.0).collect()}
    near = change.lines.near_lines(lines.side(df.where("line_id < 40"), "a"), lines.side(df.where("line_id % 9 = 0"), "b"), 0.05, 50.0)
    part = near.withColumn("s", g.segment_stretch(*lines.columns(), 0.05)).where("s IS NOT NULL").select("a_id", "s.low", "s.high").collect()
    for i in range(40):
        at = np.arange(0.5, 4000) / 4000
        inside = np.any([(r.low <= at) & (at <= r.high) for r in part if r.a_id == i], axis=0)
        assert abs(got[i] - np.mean(inside)) < 0.01


def test_matches_without_relations(spark, crowd):
    df = frame(spark, crowd[:60].tolist())
    moved = df.withColumn("y1", F.col("y1") + 0.01)
    every = lines.match_segments(df, moved, 0.3, 50.0, overlap=0.2, spacing=0.5)
    plain = lines.match_segments(df, moved, 0.3, 50.0, overlap=0.2, spacing=0.5, related=False)
    assert "relation" in every.columns and "relation" not in plain.columns
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, every.select(*plain.columns).collect()))


def test_relations_take_no_rounds(spark, monkeypatch):
    r = np.random.default_rng(5)
    chain = [(i + k, i) for i in range(-150, 0) for k in (0, 1)]
    rows = chain + [(int(a) + 10, int(b) + 10) for a, b in r.integers(0, 120, (110, 2))] + [(7, 900), (7, 901), (8, 902), (9, 902)] + chain[:5]
    links = {}
    for a, b in rows:
        links.setdefault(("a", a), set()).add(("b", b))
        links.setdefault(("b", b), set()).add(("a", a))
    want, seen = {}, set()
    for first in sorted(links):
        if first not in seen:
            part, todo = set(), [first]
            while todo:
                if (one := todo.pop()) not in part:
                    part.add(one)
                    todo += links[one]
            seen |= part
            ids = {s: sorted(i for t, i in part if t == s) for s in "ab"}
            kind = {(True, True): "one_to_one", (True, False): "one_to_many", (False, True): "many_to_one"}.get((len(ids["a"]) == 1, len(ids["b"]) == 1), "partial")
            want |= {(a, b): (ids["a"][0], kind) for t, a in part if t == "a" for _, b in links["a", a]}
    assert {kind for _, kind in want.values()} == {"one_to_one", "one_to_many", "many_to_one", "partial"}
    pairs = spark.createDataFrame(rows, "a_id long, b_id long").repartition(5)
    given = lambda: sorted((x.a_id, x.b_id, x.part, x.relation) for x in lines.relations(pairs).collect())
    expected = sorted((a, b, *want[a, b]) for a, b in rows)
    rounds = []
    monkeypatch.setattr(lines, "star_components", lambda links, star=lines.star_components: rounds.append(1) or star(links))
    assert given() == expected and not rounds
    monkeypatch.setattr(lines, "GROUP_PAIRS", 10)
    assert given() == expected and rounds
    assert lines.relations(pairs.limit(0)).collect() == []


def test_points_snap_to_nodes_then_lines(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.2, 0.0), (3, 5.0, 0.1), (4, 9.0, 9.0)], ["id", "x", "y"])
    df = frame(spark, [(4, 0, 6, 0, 1, 2), (5, 0.1, 6, 1, 3, 4), (4, 0, 6, 0, 8, 9), (0, 0, 1, 0, 8, 9)], "src", "dst")
    got = {r.id: (r.target, r.kind) for r in lines.snapped(points, points.withColumnRenamed("id", "node"), df, 0.5, 4.0).collect()}
    assert got == {1: (2, "node"), 2: (1, "node"), 3: (0, "edge"), 4: (None, "none")}


def test_best_of_a_full_cell(spark, crowd):
    df = frame(spark, crowd.tolist())
    a, b = lines.side(df.where("line_id < 50"), "a"), lines.side(df.withColumn("p", F.col("line_id") % 2), "b", "p")
    got = {(r.a_id, r.bp): (r.b_id, r.ambiguous) for r in lines.best_match(a, b, 0.4, 50.0, "bp").collect()}
    every, want = {}, {}
    for r in lines.scored(lines.near_lines(a, b, 0.4, 50.0), 0.4).collect():
        every.setdefault((r.a_id, r.bp), []).append((round(r.score, 9), round(r.overlap, 9), -r.distance, r.b_id))
    for k, found in every.items():
        first, *rest = sorted(found, reverse=True)
        want[k] = (first[3], bool(rest) and rest[0][0] >= first[0] - 0.05 and rest[0][0] >= 0.35)
    assert got == want


def test_repeated_lines_equal_the_sequential_rule():
    r = np.random.default_rng(5)
    pairs = pd.DataFrame({"a_id": r.integers(0, 60, 400), "b_id": r.integers(0, 60, 400), "score": r.integers(48, 60, 400) / 100, "overlap": r.uniform(0.2, 0.6, 400)})
    pairs = pairs[pairs.b_id < pairs.a_id].drop_duplicates(["a_id", "b_id"])
    taken, gone = set(), []
    for line in range(60):
        best = max(((x.score, -x.b_id, x.overlap) for x in pairs[pairs.a_id == line].itertuples() if x.b_id in taken), default=None)
        gone, taken = (gone + [line], taken) if best and best[2] >= 0.35 else (gone, taken | {line})
    assert gone and lines._repeated(pairs).line_id.tolist() == gone


def test_leaders_of_lines_equal_the_sequential_rule(spark, crowd):
    rows, heads, want = crowd[:250], [], {}
    ends = lambda p, q: min(max(np.hypot(*(p[:2] - q[:2])), np.hypot(*(p[2:] - q[2:]))), max(np.hypot(*(p[:2] - q[2:])), np.hypot(*(p[2:] - q[:2]))))
    for i, p in enumerate(rows):
        want[i] = next((h for h in heads if ends(p, rows[h]) <= 0.6), i)
        if want[i] == i:
            heads.append(i)
    assert {r.line_id: r.leader for r in paths.line_groups(frame(spark, rows.tolist()), 0.6, 50.0).collect()} == want


def test_detours_by_tiles_equal_those_in_rounds(spark, monkeypatch):
    r = np.random.default_rng(11)
    places = np.vstack([r.uniform(-4, 4, (60, 2)), r.normal(0, 0.5, (25, 2))])
    nodes = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], ["node", "x", "y"])
    pairs = [(i, j) for i in range(85) for j in range(i) if np.hypot(*(places[i] - places[j])) <= 1.5 and (i * j) % 3]
    edges = spark.createDataFrame(pairs, ["src", "dst"])
    rows = lambda: {(x.src, x.dst): round(x.detour, 9) for x in network.detours(nodes, edges, 2.0).collect()}
    tiled = rows()
    assert 0 < len(tiled) < len(pairs)
    monkeypatch.setattr(network, "TILE_EDGES", 0)
    assert rows() == tiled


def test_reach_by_tiles_writes_no_ways(spark, monkeypatch):
    r = np.random.default_rng(9)
    places = np.vstack([r.uniform(-4, 4, (250, 2)), np.full((70, 2), 0.25)])
    nodes = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "node long, x double, y double")
    off = np.hypot(*(places[:, None] - places).transpose(2, 0, 1))
    near = [np.flatnonzero((off[i] <= 1) & (np.arange(len(places)) != i)).tolist() for i in range(len(places))]
    edges = spark.createDataFrame([(i, k) for i in range(len(places)) for k in near[i] if i < k], "src long, dst long").repartition(7)
    want = {}
    for start in range(len(places)):
        want[start, start], front = 0, [start]
        for step in (1, 2, 3):
            front = sorted({k for i in front if i % 13 for k in near[i]} - {k for k in range(len(places)) if (start, k) in want})
            want |= {(start, k): step for k in front}
    wrote, write = [], network.materialise
    monkeypatch.setattr(network, "materialise", lambda df, label: wrote.append(write(df, label)) or wrote[-1])
    monkeypatch.setattr(network, "WORDS", 2)
    stops, given = nodes.where("node % 13 = 0"), lambda rows: [((x.start, x.node), x.depth) for x in rows.collect()]
    found = given(network.reach(edges, nodes, stops, 3, nodes, 1.0))
    assert len(found) == len(want) and dict(found) == want
    assert sum(t.count() for t in wrote) <= len(places)
    monkeypatch.setattr(network, "TILE_LINKS", 10)  # too few for any tile: in rounds
    assert dict(given(network.reach(edges, nodes, stops, 3, nodes, 1.0))) == want


def test_reach_by_tiles_knows_longer_edges(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 90.0, 0.0), (3, 91.0, 0.0)], "node long, x double, y double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    with pytest.raises(Exception, match="longer than the longest"):
        network.reach(edges, nodes, nodes.limit(0), 3, nodes, 1.0).collect()
    with pytest.raises(Exception, match="has no place"):
        network.reach(edges, nodes, nodes.limit(0), 3, nodes.where("node <> 2"), 1.0).collect()
    assert network.reach(edges, nodes, nodes.limit(0), 1, nodes, 90.0).count() == 4 + 6


def network_of(spark, seed, n, size, least=0.0, most=2.0):
    """A random network, nodes alike among it: all pairs from `least` to `most` apart."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(-size / 2, size / 2, (n, 2)).round(3)
    p[n - 3 :] = p[:3]
    off = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    pairs = [(int(i), int(j)) for i, j in np.argwhere((off >= least) & (off <= most)) if i < j]
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "node long, x double, y double")
    return nodes, spark.createDataFrame(pairs, "src long, dst long")


def test_noding_by_tiles_gives_the_nodes_of_the_edges(spark, monkeypatch):
    nodes, edges = network_of(spark, 5, 60, 7.0)
    rows = lambda df: sorted((r.x, r.y) for r in df.collect())
    want = rows(paths.noded(nodes, edges, 4.0)[0])
    tiled = paths.noded(nodes, edges, 4.0, 2.0)
    assert rows(tiled[0]) == want and {r.node for r in tiled[0].collect()} == {n for r in tiled[1].collect() for n in r}
    # only the tile's nodes leave a task, each once, however far a tile is quartered
    held = {}
    place = {r.node: (r.x, r.y) for r in nodes.collect()}
    ids = np.array(sorted(place))
    x, y = (np.array([place[i][k] for i in ids]) for k in (0, 1))
    src, dst = (np.array([r[k] for r in sorted(map(tuple, edges.collect()))]) for k in (0, 1))
    for meet in (2, 50, 10**6):
        monkeypatch.setattr(paths, "MEET", meet)
        found = []
        for tx in (-1, 0):
            for ty in (-1, 0):
                tile = tiles.Tile(tx, ty, 40_001, ids, x, y, np.zeros(len(ids), bool), src, dst)
                found += [p for b in paths._noded(tile) for p in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        held[meet] = sorted(found)
    assert held[2] == held[50] == held[10**6] == want
    assert paths._places(np.array([0.00005, -0.00005, 1.00005, 2.00015, -3.2, 0.0])).tolist() == [1, -1, 10001, 20002, -32000, 0]


def test_splits_by_tiles_equal_those_in_rounds(spark):
    rows = lambda df: sorted(map(tuple, df.collect()))
    # all pairs: parts are edges themselves; long ones only: they aren't, and rounds go on
    for seed, least, distance in ((1, 0.0, 0.3), (2, 1.5, 0.3), (3, 1.0, 1.2)):
        nodes, edges = network_of(spark, seed, 90, 8.0, least)
        assert rows(paths.split_at_nodes(nodes, edges, distance, 4.0, 2.0)) == rows(paths.split_at_nodes(nodes, edges, distance, 4.0))
    with pytest.raises(Exception, match="an edge is longer than"):
        paths.split_at_nodes(nodes, edges, 0.3, 4.0, 1.1).collect()
