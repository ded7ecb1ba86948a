"""Operators on hand-made cases."""

from __future__ import annotations

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import decision, evaluate, graph, intervals, jobs, lifecycle, match, raster, robust, sequence
from waymark.sources import text_lists


def test_dropout_and_transitions(spark):
    rows = [(1, p, s, w) for p, s, w in ((1, "present", 4.0), (2, "absent", None), (3, "present", 8.0))] + [(2, 1, "absent", None), (2, 2, "present", 5.0), (2, 3, "present", 9.0)]
    obs = lifecycle.correct_dropouts(spark.createDataFrame(rows, "road_id long, period int, status string, width_m double"))
    assert {(r.road_id, r.period) for r in obs.where("dropout").collect()} == {(1, 2)}
    events = {(r.road_id, r.to_per, r.event_typ) for r in lifecycle.transitions(obs).collect()}
    assert events == {(1, 2, "uncertain"), (1, 3, "uncertain"), (2, 2, "added"), (2, 3, "widened")}


NONE = (False, None, None, None, None, None, None)


@pytest.mark.parametrize(
    "case, state, reason",
    [
        ((0.50, 0.0, None, *NONE), "present", "geometry_match_strong"),
        ((0.49, 0.55, None, *NONE), "present", "reference_centerline_missing_but_surface_present"),
        ((0.0, 0.0, None, *NONE), "uncertain", "valid_observation_unknown"),
        ((0.0, 0.0, 0.79, *NONE), "uncertain", "invalid_or_nodata_reference"),
        ((0.0, 0.0, 0.85, *NONE), "uncertain", "insufficient_negative_evidence"),
        ((0.0, 0.0, 0.90, *NONE), "absent", "true_absence_confirmed"),
        ((0.11, 0.0, 1.0, *NONE), "uncertain", "insufficient_negative_evidence"),
        ((0.0, None, 1.0, *NONE), "uncertain", "insufficient_negative_evidence"),
        ((None, 0.0, 1.0, *NONE), "absent", "true_absence_confirmed"),
        ((0.0, 0.0, 1.0, True, 0.5, 0.90, 0.50, 0.3, 0.1, 0.6), "present", "reference_centerline_missing_but_probability_present"),
        ((0.0, 0.0, 1.0, True, 0.5, 0.85, 0.74, 0.1, 0.1, 0.12), "present", "reference_centerline_missing_but_probability_present"),
        ((0.0, 0.0, 1.0, True, 0.5, 0.84, 0.50, 0.3, 0.1, 0.6), "uncertain", "insufficient_negative_evidence"),
        ((0.0, 0.0, 1.0, True, 0.5, 0.70, 0.65, 0.3, 0.1, 0.6), "absent", "true_absence_confirmed"),
        ((0.0, 0.0, 1.0, True, 0.5, 0.70, 0.50, 0.3, 0.1, 0.6), "uncertain", "insufficient_negative_evidence"),
        ((0.0, 0.0, 1.0, True, 0.1, 0.99, 0.50, 0.3, 0.1, 0.105), "absent", "true_absence_confirmed"),
        ((0.0, 0.0, 1.0, True, 0.2, 0.99, 0.50, 0.3, 0.1, 0.105), "uncertain", "insufficient_negative_evidence"),
        ((0.0, 0.0, 1.0, True, None, None, None, None, 0.1, 0.6), "uncertain", "insufficient_negative_evidence"),
    ],
)
def test_existence(spark, case, state, reason):
    row = spark.createDataFrame([case], "g double, s double, v double, probed boolean, mean double, pct double, bg double, contrast double, p50 double, p99 double")
    got = row.select(decision.existence(*[F.col(x) for x in row.columns]).alias("x")).first().x
    assert (got.state, got.reason) == (state, reason)


def test_change_names(spark):
    names = [("Added",), (" 新增 ",), ("+1",), ("2",), ("-1",), ("new road",), ("width",), ("expansion",), (None,)]
    rows = spark.createDataFrame(names, "n string").select(decision.change_class(F.col("n")).alias("four"), decision.change_class(F.col("n"), 3).alias("three")).collect()
    assert [r.four for r in rows] == ["added", "added", "added", None, "removed", "added", None, "widened", None]
    assert [r.three for r in rows] == ["added", "added", "added", None, "removed", "added", "width_changed", "width_changed", None]
    with pytest.raises(ValueError):
        decision.change_class(F.col("n"), 5)


def test_first_valid_and_scores(spark):
    row = spark.createDataFrame([("x", "NaN", "inf", "2.5"), (None, "", "abc", None)], "a string, b string, c string, d string")
    assert [r[0] for r in row.select(decision.first_valid(*[F.col(c) for c in "abcd"], default=-1.0)).collect()] == [2.5, -1.0]
    rows = spark.createDataFrame([("a", 0.4, None, None), ("B", 3.0, 0.2, "manual"), (None, None, None, "other")], "g string, c double, s double, src string")
    assert [r[0] for r in rows.select(decision.grade_score(*[F.col(c) for c in rows.columns])).collect()] == pytest.approx([3.35, 2.75, 1.0])


def test_pooled_evaluation_of_tasks(spark):
    """Two tasks of one class: sums first, ratios of the sums then."""
    rows = spark.createDataFrame([(8.0, 0.0, 2.0, 0.0, 10.0, 20.0, 5.0, 30.0), (12.0, 0.0, 8.0, 0.0, 30.0, 10.0, 15.0, 40.0)], evaluate.SUPPORTS)
    got = evaluate.pooled(rows).first()
    assert (got.tasks, got.recall, got.precision) == (2, 20 / 30, 1.0)
    assert (got.truth_to_predicted, got.predicted_to_truth, got.mean_offset) == (20 / 40, 70 / 30, 90 / 70)


def test_clipped_stats_keeps_all_where_mad_is_zero(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 5.0), (1, 90.0), (2, -1.0)], "k int, v double")
    assert sorted((r.k, r.median, r.std > 0, r.n) for r in robust.clipped_stats(rows, "k", "v").collect()) == [(1, 5.0, True, 4), (2, 0.0, False, 0)]


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.04, 3.0), (1, 5.0, 6.0), (1, 5.5, 5.5)], "k int, start double, end double")
    merged = intervals.merge(rows, "k")
    assert sorted((r.start, r.end) for r in merged.collect()) == [(0.0, 3.0), (5.0, 6.0)]
    gaps = intervals.complement(merged, "k", spark.createDataFrame([(1, 10.0)], "k int, length double"))
    assert sorted((r.gap_start, r.gap_end) for r in gaps.collect()) == [(3.0, 5.0), (6.0, 10.0)]


def test_greedy_is_not_mutual_best(spark):
    pairs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.5), (2, 2, 9.0)], "a_id long, b_id long, distance double")
    parts = spark.createDataFrame([(1, 0), (2, 0)], "a_id long, part long")
    assert sorted((r.a_id, r.b_id) for r in match.greedy_one_to_one(pairs, parts).collect()) == [(1, 1), (2, 2)]


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {i: 0 if i < 10 else i for i in range(12)}


def test_affected_pairs(spark):
    pairs = spark.createDataFrame([("2021", "2022"), ("2022", "2024")], "before string, after string")
    got = jobs.affected_pairs(pairs, spark.createDataFrame([("2022",)], "period string"))
    assert got.count() == 2


def test_runs_and_change_points():
    assert sequence.split_runs([10.0] * 5 + [20.0] * 5) == [0] * 5 + [1] * 5
    assert sequence.change_points([10.0] * 6 + [30.0] * 6) == [6, 12]
    x = [3.0, 3, 3, 9, 9, 9, 3, 3, 3, 3]
    penalty = max(0.15 * float(np.median(x)), 1.5) ** 2 * np.log(len(x) + 1)

    def cost(cuts):
        parts = np.split(np.array(x), cuts)
        return sum(((p - p.mean()) ** 2).sum() for p in parts) + penalty * (len(parts) - 1) if min(map(len, parts)) >= 3 else np.inf

    best = min((c for k in range(3) for c in itertools.combinations(range(1, len(x)), k)), key=lambda c: cost(list(c)))
    assert sequence.change_points(x) == [*best, len(x)]


def test_windows_cover():
    got = raster.windows(10, 7, 4, 1)
    assert {(r, c) for y, x in got for r in range(y, y + 4) for c in range(x, x + 4)} >= {(r, c) for r in range(10) for c in range(7)}


def test_periods_and_names(spark):
    raw = ["2021", " 202102", "2021-02-03", "20210230", "spring", "a10", "a9", "a" + "9" * 30, "a1" + "0" * 30, "a007", "", "0000"]
    rows = spark.createDataFrame([(x,) for x in raw], "raw string")
    got = {r.raw: r.k for r in rows.select("raw", text_lists.period_key(F.col("raw")).alias("k")).collect()}
    days = [got[x].ordinal for x in ("2021", " 202102", "2021-02-03")]
    assert days == [datetime.date(2021, 1, 1).toordinal(), datetime.date(2021, 2, 1).toordinal(), datetime.date(2021, 2, 3).toordinal()]
    assert got["2021-02-03"].granularity == 2 and got["20210230"] is None and got["spring"]["class"] == 1 and got[""] is None and got["0000"] is None
    order = [r.raw for r in rows.where("raw LIKE 'a%'").orderBy(text_lists.period_key(F.col("raw"))).collect()]
    assert order == ["a007", "a9", "a10", "a" + "9" * 30, "a1" + "0" * 30]
    with pytest.raises(Exception, match="no period"):
        rows.select(text_lists.period_key(F.col("raw"), strict=True).alias("k")).collect()
    names = spark.createDataFrame([("..",), ("a b.c",), ("道路-1_",), ("__",)], "n string").select(text_lists.clean_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["grid", "a_b_c", "道路-1", "grid"]


def test_list_lines(spark):
    text = "\ufeff\"a b.tif\"\r\n\t'\"x\"'  \r# no\x0b\x85  \n''\n\"\n'y\u2028 z"
    got = [tuple(r)[1:] for r in text_lists.list_lines(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()]
    assert sorted(got) == [(1, "a b.tif"), (2, '"x"'), (8, "'y"), (9, "z")]


def test_suppress_and_runs():
    x, y, score = np.array([0.0, 1, 3, 3.5]), np.zeros(4), np.array([0.9, 0.8, 0.7, 1.5])
    assert sequence.suppress(x, y, score, 1.0).tolist() == [True, False, False, True]
    assert sequence.suppress(x, y, np.array([0.9, 1.1, 0.7, 1.5]), 1.0).tolist() == [False, True, False, True]
    assert sequence.split_runs([0.2, 0.2, 0.2, 0.5], ratio=0.35) == [0, 0, 0, 0]


def test_greedy_needs_no_connected_parts(spark):
    rng = np.random.default_rng(3)
    rows = sorted({(int(a), int(b), float(d)) for a, b, d in zip(rng.integers(0, 40, 400), rng.integers(0, 40, 400), rng.integers(1, 6, 400), strict=True)}, key=lambda r: (r[2], r[0], r[1]))
    used_a, used_b, want = set(), set(), []
    for a, b, d in rows:
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.append((a, b, d))
    pairs = spark.createDataFrame(rows, "a_id long, b_id long, distance double")
    assert sorted(map(tuple, match.greedy_one_to_one(pairs).collect())) == sorted(want)
