"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark import registry
from waymark.functions import geometry
from waymark.operators import decision, evaluate, graph, intervals, jobs, lifecycle, match, raster, robust
from waymark.sources import tables, text_lists

FLAGSHIP = "lifecycle_event_counts"
_register, _rounded = registry.register, registry.rounded


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


_FIXED = f"""{tables.OBSERVATIONS_SQL},
    near AS (SELECT *, lag(status) OVER w AS p, lead(status) OVER w AS q FROM obs WINDOW w AS (PARTITION BY road_id ORDER BY period)),
    fixed AS (SELECT * REPLACE (CASE WHEN p = 'present' AND status = 'absent' AND q = 'present' THEN 'uncertain' ELSE status END AS status),
                     coalesce(p = 'present' AND status = 'absent' AND q = 'present', false) AS dropout FROM near)"""
_EVENTS = f"""{_FIXED},
    pairs AS (SELECT road_id, lag(period) OVER w AS from_per, period AS to_per, lag(status) OVER w AS before_st, status AS after_st, lag(width_m) OVER w AS before_w, width_m AS after_w
              FROM fixed WINDOW w AS (PARTITION BY road_id ORDER BY period)),
    typed AS (SELECT *, after_w - before_w AS width_diff, abs(after_w - before_w) >= 2 AND abs(after_w - before_w) / greatest(before_w, after_w, CAST(0.1 AS DOUBLE)) >= CAST(0.2 AS DOUBLE) AS ch FROM pairs WHERE from_per IS NOT NULL),
    events_ AS (SELECT *, CASE WHEN before_st <> after_st AND 'uncertain' IN (before_st, after_st) THEN 'uncertain' WHEN before_st = 'absent' AND after_st = 'present' THEN 'added' WHEN before_st = 'present' AND after_st = 'absent' THEN 'removed'
                       WHEN before_st = 'present' AND after_st = 'present' AND ch AND width_diff > 0 THEN 'widened' WHEN before_st = 'present' AND after_st = 'present' AND ch THEN 'narrowed' END AS event_typ FROM typed)"""


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.correct_dropouts(tables.observations(spark, d))


@_register(f"WITH {_EVENTS} SELECT event_typ, count(*) AS n FROM events_ WHERE event_typ IS NOT NULL GROUP BY 1")
def lifecycle_event_counts(spark, d):
    return lifecycle.transitions(_fixed(spark, d)).groupBy("event_typ").agg(F.count("*").alias("n"))


@_register(f"WITH {_EVENTS} SELECT road_id, from_per, to_per, before_st, after_st, event_typ, round(width_diff, 4) AS width_diff FROM events_ WHERE event_typ IS NOT NULL")
def lifecycle_events(spark, d):
    e = lifecycle.transitions(_fixed(spark, d))
    return _rounded(e.select("road_id", "from_per", "to_per", "before_st", "after_st", "event_typ", "width_diff"), "width_diff", digits=4)


@_register(f"WITH {_FIXED} SELECT road_id, min(period) FILTER (status = 'present') AS first_obs, max(period) FILTER (status = 'present') AS last_obs, count(*) FILTER (status = 'present') AS present_n, round(max(confidence), 6) AS max_conf, round(min(confidence), 6) AS min_conf, CAST(max(CAST(status = 'uncertain' AS INT)) AS INT) AS review FROM fixed GROUP BY 1")
def lifecycle_table(spark, d):
    return _rounded(lifecycle.life_table(_fixed(spark, d)), "max_conf", "min_conf", digits=6)


@_register(f"WITH {_FIXED} SELECT road_id, period FROM fixed WHERE dropout")
def single_dropouts(spark, d):
    return _fixed(spark, d).where("dropout").select("road_id", "period")


@_register("WITH p AS (SELECT DISTINCT CAST(ts AS DATE) AS period FROM events), q AS (SELECT lag(period) OVER (ORDER BY period) AS before, period AS after FROM p) SELECT before, after FROM q WHERE before IS NOT NULL")
def period_pairs(spark, d):
    return lifecycle.adjacent_pairs(tables.load(spark, d, "events").select(F.to_date("ts").alias("period")).distinct())


# a column for each period of the calendar
@_register(f"WITH {_FIXED} PIVOT fixed ON strftime(period, 'd%Y%m%d') USING coalesce(max(status), '0') GROUP BY road_id")
def status_calendar(spark, d):
    obs = _fixed(spark, d).withColumn("period_name", F.date_format("period", "'d'yyyyMMdd"))
    calendar = tables.load(spark, d, "events").select(F.date_format(F.to_date("ts"), "'d'yyyyMMdd").alias("name")).where("name IS NOT NULL").distinct()
    return lifecycle.status_pivot(obs, sorted(r.name for r in calendar.collect()))


_ODD_WIDTH = """CASE WHEN chain_id % 17 = 0 THEN -width WHEN sample_index % 9 = 0 THEN CAST('NaN' AS DOUBLE) WHEN sample_index % 10 = 0 THEN CAST('Infinity' AS DOUBLE)
    WHEN sample_index % 11 = 0 THEN 0.0 WHEN sample_index % 13 = 0 THEN width * 40 ELSE width END"""


@_register(f"""WITH {tables.SAMPLES_SQL}, o AS (SELECT chain_id, CAST({_ODD_WIDTH} AS DOUBLE) AS x FROM s), f AS (SELECT chain_id, CASE WHEN x > 0 AND NOT isnan(x) AND NOT isinf(x) THEN x END AS v FROM o),
    a AS (SELECT *, median(v) OVER (PARTITION BY chain_id) AS m FROM f), b AS (SELECT *, median(abs(v - m)) OVER (PARTITION BY chain_id) AS mad FROM a),
    k AS (SELECT chain_id, CASE WHEN mad <= 0 OR abs(v - m) <= 3.5 * CAST(1.4826 AS DOUBLE) * mad THEN v END AS v FROM b)
    SELECT chain_id, coalesce(median(v), 0.0) AS median, round(coalesce(stddev_pop(v), 0.0), 5) AS std, count(v) AS n FROM k GROUP BY 1""")
def robust_widths(spark, d):
    s = tables.width_samples(spark, d).withColumn("width", F.expr(_ODD_WIDTH))
    return _rounded(robust.clipped_stats(s, "chain_id", "width"), "std")


@_register(f"WITH {tables.SAMPLES_SQL}, g AS (SELECT chain_id, width, sum(CAST(support AS DECIMAL(28,4))) AS w FROM s WHERE support > 0 GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY chain_id ORDER BY width ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY chain_id) AS total FROM g) SELECT chain_id, min(width) AS weighted_median FROM r WHERE run * 2 >= total GROUP BY 1")
def weighted_median_widths(spark, d):
    return robust.weighted_median(tables.width_samples(spark, d), "chain_id", "width", "support")


@_register(f"WITH {tables.SAMPLES_SQL} SELECT chain_id, sample_index, round((rank() OVER (PARTITION BY chain_id ORDER BY width) - 1) / CAST(count(*) OVER (PARTITION BY chain_id) AS DOUBLE), 6) AS strict_rank, round((rank() OVER (PARTITION BY chain_id ORDER BY width) - 1 + 0.5 * count(*) OVER (PARTITION BY chain_id, width)) / CAST(count(*) OVER (PARTITION BY chain_id) AS DOUBLE), 6) AS mid_rank FROM s")
def empirical_ranks(spark, d):
    s = tables.width_samples(spark, d)
    out = s.select("chain_id", "sample_index", robust.strict_rank(s, "chain_id", "width").alias("strict_rank"), robust.mid_rank("chain_id", "width").alias("mid_rank"))
    return _rounded(out, "strict_rank", "mid_rank", digits=6)


@_register(f"""WITH {tables.SAMPLES_SQL}, n AS (SELECT *, grade <> 'C' AS ok, coalesce(list(width) FILTER (grade <> 'C') OVER (PARTITION BY chain_id ORDER BY sample_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), []) AS near FROM s),
    m AS (SELECT *, list_median(near) AS med FROM n), k AS (SELECT *, list_median([abs(x - med) FOR x IN near]) AS mad FROM m)
    SELECT chain_id, sample_index, CASE WHEN ok THEN med END AS rolling_median, coalesce(ok AND len(near) >= 3 AND abs(width - med) > greatest(1.0, 3.5 * CAST(1.4826 AS DOUBLE) * mad), false) AS outlier FROM k""")
def rolling_hampel(spark, d):
    flagged = robust.hampel(tables.width_samples(spark, d), "chain_id", "sample_index", "width", valid=F.col("grade") != "C")
    return flagged.select("chain_id", "sample_index", "rolling_median", F.coalesce("outlier", F.lit(False)).alias("outlier"))


@_register(f"WITH {tables.SAMPLES_SQL}, m AS (SELECT chain_id, median(width) AS m FROM s WHERE width > 0 GROUP BY 1) SELECT chain_id, sample_index, round(least(greatest(width, m * CAST(0.65 AS DOUBLE)), m * CAST(1.35 AS DOUBLE)), 5) AS clamped FROM s LEFT JOIN m USING (chain_id)")
def clamped_widths(spark, d):
    return _rounded(robust.group_clamp(tables.width_samples(spark, d), "chain_id", "width").select("chain_id", "sample_index", "clamped"), "clamped")


@_register(f"WITH {tables.SAMPLES_SQL} SELECT count(width) FILTER (width > 0) AS n, quantile_cont(width, 0.5) FILTER (width > 0) AS median, round(avg(width) FILTER (width > 0), 5) AS mean, quantile_cont(width, 0.1) FILTER (width > 0) AS p10, quantile_cont(width, 0.9) FILTER (width > 0) AS p90 FROM s")
def global_width_summary(spark, d):
    return _rounded(robust.width_summary(tables.width_samples(spark, d), "width"), "mean")


#: Evidence by arithmetic on a key k, so that all branches are met.
_EVIDENCE = {
    "g": "CASE WHEN k % 23 <> 0 THEN (k * 7 % 11) / 10.0e0 END",
    "s": "CASE WHEN k % 5 <> 0 THEN (k * 5 % 7) / 8.0e0 END",
    "v": "CASE WHEN k % 7 <> 0 THEN (k * 3 % 13) / 12.0e0 END",
    "probed": "k % 3 <> 0",
    "mean": "CASE WHEN k % 3 <> 0 AND k % 19 <> 0 THEN (k % 9) / 40.0e0 END",
    "pct": "CASE WHEN k % 3 <> 0 AND k % 17 <> 0 THEN (k * 11 % 21) / 20.0e0 END",
    "bg": "CASE WHEN k % 3 <> 0 AND k % 29 <> 0 THEN (k * 13 % 21) / 20.0e0 END",
    "contrast": "CASE WHEN k % 3 <> 0 AND k % 31 <> 0 THEN (k % 5 - 2) / 10.0e0 END",
    "p50": "CASE WHEN k % 3 <> 0 THEN 0.2e0 END",
    "p99": "CASE WHEN k % 3 <> 0 THEN 0.2e0 + (k % 4) * 0.005e0 END",
}


def evidence_sql(key: str) -> str:
    columns = ", ".join(f"{v} AS {n}" for n, v in _EVIDENCE.items())
    return f"""SELECT *, CASE WHEN coalesce(g, 0) >= 0.5 THEN 'geometry_match_strong'
            WHEN p99 - p50 >= 0.01 AND pct >= 0.85 AND pct - bg >= 0.10 AND contrast > 0 THEN 'reference_centerline_missing_but_probability_present'
            WHEN s >= 0.55 THEN 'reference_centerline_missing_but_surface_present' WHEN v IS NULL THEN 'valid_observation_unknown' WHEN v < 0.8 THEN 'invalid_or_nodata_reference'
            WHEN coalesce(g, 0) <= 0.1 AND s <= 0.1 AND v >= 0.9 AND (NOT probed OR pct IS NOT NULL AND (p99 - p50 < 0.01 AND coalesce(mean, 0) <= 0.1 OR pct <= 0.7 AND (pct - bg IS NULL OR pct - bg <= 0.1)))
                THEN 'true_absence_confirmed' ELSE 'insufficient_negative_evidence' END AS reason
        FROM (SELECT id, k, {columns} FROM (SELECT p_partkey AS id, {key} AS k FROM part))"""


STATE_SQL = "CASE WHEN reason IN ('geometry_match_strong', 'reference_centerline_missing_but_probability_present', 'reference_centerline_missing_but_surface_present') THEN 'present' WHEN reason = 'true_absence_confirmed' THEN 'absent' ELSE 'uncertain' END"


def evidence(spark, d, key: str = "p_partkey"):
    parts = tables.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(key).alias("k"))
    e = parts.select("id", "k", *[F.expr(v).alias(n) for n, v in _EVIDENCE.items()])
    return e.withColumn("x", decision.existence(*[F.col(c) for c in _EVIDENCE])).select("*", "x.state", "x.reason").drop("x")


@_register(f"WITH e AS ({evidence_sql('p_partkey')}) SELECT id, {STATE_SQL} AS state, reason FROM e")
def existence_evidence(spark, d):
    return evidence(spark, d).select("id", "state", "reason")


_BOTH = f"""b AS ({evidence_sql('p_partkey * 5 + 1')}), a AS ({evidence_sql('p_partkey * 3 + 2')}), both_ AS (SELECT b.id, b AS before, a AS after, {STATE_SQL.replace('reason', 'b.reason')} AS bs, {STATE_SQL.replace('reason', 'a.reason')} AS sa,
    b.reason AS br, a.reason AS ar, CASE WHEN b.id % 2 = 0 THEN 'added' ELSE 'removed' END AS requested FROM b JOIN a USING (id))"""


def _both(spark, d):
    side = lambda key, name: evidence(spark, d, key).select("id", F.struct("*").alias(name))
    both = side("p_partkey * 5 + 1", "before").join(side("p_partkey * 3 + 2", "after"), "id")
    return both.withColumn("requested", F.when(F.col("id") % 2 == 0, "added").otherwise("removed"))


@_register(f"""WITH {_BOTH}, s AS (SELECT *, requested = 'added' AND bs = 'absent' AND sa = 'present' OR requested = 'removed' AND bs = 'present' AND sa = 'absent' AS sure FROM both_)
    SELECT id, CASE WHEN sure THEN 'auto' ELSE 'review' END AS qa_state, CASE WHEN sure THEN 'dual_period_confirmed_change' WHEN 'invalid_or_nodata_reference' IN (br, ar) THEN 'invalid_or_nodata_reference' WHEN 'valid_observation_unknown' IN (br, ar) THEN 'valid_observation_unknown'
        WHEN 'reference_centerline_missing_but_probability_present' IN (br, ar) THEN 'reference_centerline_missing_but_probability_present' WHEN 'reference_centerline_missing_but_surface_present' IN (br, ar) THEN 'reference_centerline_missing_but_surface_present'
        WHEN 'insufficient_negative_evidence' IN (br, ar) THEN 'insufficient_negative_evidence' WHEN bs = 'present' AND sa = 'present' THEN 'cross_sensor_extraction_disagreement' ELSE 'geometry_mismatch_only' END AS qa_reason FROM s""")
def change_decisions(spark, d):
    rule = decision.change_decision(*[F.col(c) for c in ("before.state", "after.state", "before.reason", "after.reason", "requested")])
    return _both(spark, d).select("id", rule.alias("x")).select("id", "x.qa_state", "x.qa_reason")


@_register(f"""WITH {_BOTH} SELECT id, bs AS before_state, sa AS after_state, before.g AS before_geom_cov, after.g AS after_geom_cov, before.mean AS before_center_evidence, after.mean AS after_center_evidence, before.pct AS before_center_pct, after.pct AS after_center_pct,
    before.contrast AS before_contrast, after.contrast AS after_contrast, before.s AS before_surface_cov, after.s AS after_surface_cov, before.v AS before_valid_cov, after.v AS after_valid_cov, before.v IS NOT NULL AS before_valid_known, after.v IS NOT NULL AS after_valid_known,
    'geometry_or_relative_probability_or_surface_present; multi_negative_valid_observation_absent' AS evidence_rule FROM both_""")
def evidence_audit(spark, d):
    return _both(spark, d).select("id", *decision.audit_fields("before", "after"))


@_register("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'hard_veto' WHEN s >= 70 THEN 'auto_accept' WHEN s >= 50 THEN 'medium_confidence_auto' ELSE 'manual_review' END AS band,
    CASE WHEN o_orderstatus <> 'P' AND s >= 50 THEN 'accept' ELSE 'review' END AS decision FROM (SELECT *, o_orderkey % 101 AS s FROM orders)""")
def score_bands(spark, d):
    rule = decision.score_rule(F.col("o_orderkey") % 101, F.col("o_orderstatus") == "P")
    return tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rule.alias("x")).select("id", "x.band", "x.decision")


_SOURCE = "CASE sample_index % 6 WHEN 0 THEN 'manual' WHEN 1 THEN 'samroad' WHEN 2 THEN 'surface_skeleton' WHEN 3 THEN 'connector' WHEN 4 THEN 'other' END"


@_register(f"""WITH {tables.SAMPLES_SQL} SELECT chain_id, sample_index, round(CASE grade WHEN 'A' THEN 3.0e0 WHEN 'B' THEN 2.0e0 ELSE 1.0e0 END + 0.25e0 * least(greatest(width / 40.0e0, support / 60000.0e0, 0.0e0), 1.0e0)
    + CASE coalesce({_SOURCE}, 'samroad') WHEN 'manual' THEN 0.5e0 WHEN 'samroad' THEN 0.25e0 WHEN 'connector' THEN -0.25e0 ELSE 0.0e0 END, 9) AS score FROM s""")
def graded_scores(spark, d):
    s = tables.width_samples(spark, d).withColumn("source", F.expr(_SOURCE))
    score = decision.grade_score(F.lower("grade"), F.col("width") / 40.0, F.col("support") / 60000.0, F.col("source"))
    return _rounded(s.select("chain_id", "sample_index", score.alias("score")), "score", digits=9)


#: Names of changes: all that count, in odd spellings, and some that don't.
_NAMES = [*decision.ADDED, *decision.REMOVED, *decision.WIDENED, *decision.NARROWED, *decision.WIDTH_CHANGED, " Added ", "New Road", "WIDTH CHANGE", "+2", "2", "0", "x", ""]
_NAMED = f"n AS (SELECT event_id, value, replace(lower(trim(l[event_id % len(l) + 1])), ' ', '_') AS n, event_id % 7 AS code FROM (SELECT *, [{registry.quoted(_NAMES)}] AS l FROM events))"


def _class_sql(three: bool) -> str:
    w, quoted = "'width_changed'", registry.quoted
    return f"""CASE WHEN n IN ({quoted(decision.ADDED)}) THEN 'added' WHEN n IN ({quoted(decision.REMOVED)}) THEN 'removed' WHEN n IN ({quoted(decision.WIDENED)}) THEN {w if three else "'widened'"}
        WHEN n IN ({quoted(decision.NARROWED)}) THEN {w if three else "'narrowed'"} WHEN n IN ({quoted(decision.WIDTH_CHANGED)}) THEN {w if three else "NULL"} END"""


@_register(f"""WITH {_NAMED} SELECT event_id, {_class_sql(False)} AS of_four, {_class_sql(True)} AS of_three, CASE WHEN value - 50 > 0 THEN 'added' WHEN value - 50 < 0 THEN 'removed' END AS by_sign,
    CASE code WHEN 2 THEN 'added' WHEN 4 THEN 'removed' END AS coded_four, CASE code WHEN 2 THEN 'added' WHEN 3 THEN 'width_changed' WHEN 4 THEN 'removed' END AS coded_three FROM n""")
def change_codes(spark, d):
    e = tables.load(spark, d, "events")
    name = F.get(F.lit(_NAMES), (F.col("event_id") % len(_NAMES)).cast("int"))
    code = F.concat(F.lit(" "), (F.col("event_id") % 7).cast("string"), F.when(F.col("event_id") % 2 == 0, ".5").otherwise(""))
    of = [decision.change_class(name).alias("of_four"), decision.change_class(name, 3).alias("of_three"), decision.change_sign(F.col("value") - 50).alias("by_sign")]
    return e.select("event_id", *of, decision.coded_change(code).alias("coded_four"), decision.coded_change(code, 3).alias("coded_three"))


_CONF = "c AS (SELECT d.source AS class, count(*) FILTER (l.quality = 1 AND p) AS tp, count(*) FILTER (l.quality <> 1 AND p) AS fp, count(*) FILTER (l.quality = 1 AND NOT p) AS fn, count(*) FILTER (l.quality <> 1 AND NOT p) AS tn FROM labels l JOIN (SELECT *, n_chars > (SELECT median(n_chars) FROM documents) AS p FROM documents) d USING (doc_id) GROUP BY 1)"


def _judged(spark, d):
    docs = tables.load(spark, d, "documents")
    middle = robust.exact_quantile(docs, "n_chars", 0.5).select(F.col("q0").alias("middle"))
    rows = docs.select("doc_id", "source", "n_chars").join(F.broadcast(middle), how="cross")  # one row
    return rows.join(tables.load(spark, d, "labels"), "doc_id").select(F.col("source").alias("class"), "quality", (F.col("n_chars") > F.col("middle")).cast("int").alias("predicted"))


@_register(f"WITH {_CONF}, m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) WHEN tp + fp + fn = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) WHEN tp + fp + fn = 0 THEN 1.0 ELSE 0.0 END AS r FROM c) SELECT class, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, round(CASE WHEN tp + fp + fn > 0 THEN tp / CAST(tp + fp + fn AS DOUBLE) ELSE 1.0 END, 6) AS iou, round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) ELSE 0.0 END, 6) AS accuracy FROM m")
def class_metrics(spark, d):
    return _rounded(evaluate.with_metrics(evaluate.confusion(_judged(spark, d), "quality", "predicted", "class")), "precision", "recall", "f1", "iou", "accuracy", digits=6)


@_register(f"WITH {_CONF} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn, count(*) AS tasks, round(sum(tp) / CAST(sum(tp) + sum(fp) AS DOUBLE), 6) AS precision, round(sum(tp) / CAST(sum(tp) + sum(fn) AS DOUBLE), 6) AS recall, round(2 * sum(tp) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE), 6) AS f1, round(sum(tp) / CAST(sum(tp) + sum(fp) + sum(fn) AS DOUBLE), 6) AS iou FROM c")
def pooled_metrics(spark, d):
    return _rounded(evaluate.pooled(evaluate.confusion(_judged(spark, d), "quality", "predicted", "class")), "precision", "recall", "f1", "iou", digits=6)


_MERGED = f"""{tables.INTERVALS_SQL},
    a AS (SELECT *, CASE WHEN start <= max("end") OVER w + CAST(0.05 AS DOUBLE) THEN 0 ELSE 1 END AS fresh FROM i WHERE "end" - start > 1e-6 WINDOW w AS (PARTITION BY line_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY line_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM a),
    merged AS (SELECT line_id, min(start) AS start, max("end") AS "end" FROM b GROUP BY line_id, island)"""


@_register(f'WITH {_MERGED} SELECT line_id, start, "end" FROM merged')
def merged_intervals(spark, d):
    return intervals.merge(tables.intervals(spark, d), "line_id")


@_register(f"""WITH {_MERGED}, l AS (SELECT line_id, max("end") + 5 AS length FROM i GROUP BY 1), x AS (SELECT line_id, greatest(start, 0) AS start, least("end", length) AS "end" FROM merged JOIN l USING (line_id) UNION ALL SELECT line_id, length, length FROM l),
    g AS (SELECT line_id, coalesce(lag("end") OVER (PARTITION BY line_id ORDER BY start, "end"), 0) AS gap_start, start AS gap_end FROM x) SELECT * FROM g WHERE gap_end - gap_start > 1e-6""")
def interval_gaps(spark, d):
    i = tables.intervals(spark, d)
    return intervals.complement(intervals.merge(i, "line_id"), "line_id", i.groupBy("line_id").agg((F.max("end") + 5).alias("length")))


@_register("WITH n AS (SELECT p_partkey AS id, p_retailprice AS length, CAST(least(greatest(ceil(p_retailprice / 50.0) + 1, 3), 101) AS INT) AS n FROM part) SELECT id, CAST(k AS INT) AS k, round(length * k / (n - 1), 5) AS at FROM (SELECT *, unnest(range(0, n)) AS k FROM n)")
def even_samples(spark, d):
    p = tables.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("length"))
    return _rounded(intervals.even_samples(p, "length", 50.0).select("id", "k", "at"), "at")


_PAIRS = f"{tables.POINTS_SQL}, q AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM p a, p b WHERE a.label < 5 AND b.label >= 5), pairs AS (SELECT * FROM q WHERE distance <= 3)"


def _pairs(spark, d):
    p = tables.points(spark, d)
    a = p.where("label < 5").select(F.col("vec_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.where("label >= 5").select(F.col("vec_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return match.pairs_within(a, b, 3.0).select("a_id", "b_id", "distance")


@_register(f"WITH {_PAIRS} SELECT a_id, b_id, round(distance, 6) AS distance FROM pairs")
def distance_join(spark, d):
    return _rounded(_pairs(spark, d), "distance", digits=6)


@_register(f"WITH {_PAIRS} SELECT a_id, b_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS r FROM pairs) WHERE r = 1")
def nearest_join(spark, d):
    return _rounded(match.nearest(_pairs(spark, d)), "distance", digits=6)


@_register(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY distance, a_id) AS rb FROM pairs) SELECT a_id, b_id, round(distance, 6) AS distance FROM r WHERE ra = 1 AND rb = 1")
def mutual_nearest_join(spark, d):
    return _rounded(match.mutual_nearest(_pairs(spark, d)), "distance", digits=6)


@_register(f"WITH {_PAIRS}, r AS (SELECT *, min(distance) OVER (PARTITION BY a_id) AS ba, min(distance) OVER (PARTITION BY b_id) AS bb FROM pairs) SELECT a_id, b_id FROM r WHERE distance <= ba + CAST(0.5 AS DOUBLE) AND distance <= bb + CAST(0.5 AS DOUBLE)")
def local_best_pairs(spark, d):
    return match.local_best(_pairs(spark, d), 0.5).select("a_id", "b_id")


@_register(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS r FROM pairs) SELECT a_id, round(min(distance), 6) AS best, round(max(distance) FILTER (r = 2), 6) AS runner_up, coalesce(max(distance) FILTER (r = 2) - min(distance) <= 0.25e0, false) AS ambiguous FROM r WHERE r <= 2 GROUP BY 1")
def ambiguous_matches(spark, d):
    return _rounded(match.ambiguous(_pairs(spark, d), 0.25), "best", "runner_up", digits=6)


@_register()
def greedy_matches(spark, d):
    return _rounded(match.greedy_one_to_one(_pairs(spark, d)), "distance", digits=6)


_EDGES = f"{tables.POINTS_SQL}, g AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM p a, p b WHERE a.vec_id < b.vec_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1)"


def _graph(spark, d):
    p = tables.points(spark, d)
    a = p.select(F.col("vec_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.select(F.col("vec_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return p.select(F.col("vec_id").alias("node")), graph.undirected(match.pairs_within(a, b, 1.0).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")))


@_register(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY 1")
def graph_degrees(spark, d):
    return graph.degrees(_graph(spark, d)[1])


_PARTS = _EDGES.replace("p AS", "RECURSIVE p AS", 1) + ", e2 AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g), reach AS (SELECT vec_id AS node, vec_id AS seen FROM p UNION SELECT r.node, e2.dst FROM reach r JOIN e2 ON r.seen = e2.src), parts AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)"


@_register(f"WITH {_PARTS} SELECT node, component FROM parts")
def graph_components(spark, d):
    return graph.components(*_graph(spark, d))


@_register(f"WITH {_PARTS}, dg AS (SELECT vec_id, count(src) AS degree FROM p LEFT JOIN e2 ON vec_id = src GROUP BY 1) SELECT (SELECT count(*) FROM p) AS nodes, (SELECT count(*) FROM g) AS edges, (SELECT count(DISTINCT component) FROM parts) AS components, (SELECT max(n) FROM (SELECT count(*) AS n FROM parts GROUP BY component)) AS largest, (SELECT count(*) FROM dg WHERE degree = 1) AS endpoints, (SELECT count(*) FROM dg WHERE degree = 0) AS isolated, (SELECT count(*) FROM dg WHERE degree >= 3) AS junctions")
def graph_summary(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.summary(nodes, edges, graph.components(nodes, edges))


_VERSIONS = """g AS (SELECT user_id, CAST(ts AS DATE) AS period, sum(event_id) AS fingerprint FROM events GROUP BY ALL),
    prior AS (SELECT * FROM g UNION ALL SELECT -1 - user_id, period, fingerprint FROM g WHERE user_id % 2 = 0),
    cur AS (SELECT user_id, period, fingerprint + user_id % 3 AS fingerprint FROM g UNION ALL SELECT -1 - user_id, period, fingerprint FROM g WHERE user_id % 2 = 1)"""


# all rows take part: every third key keeps its fingerprint; keys below 0 are added or removed
@_register(f"WITH {_VERSIONS} SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.period, b.period) AS period, CASE WHEN a.fingerprint IS NULL THEN 'added' WHEN b.fingerprint IS NULL THEN 'removed' ELSE 'changed' END AS change FROM prior a FULL JOIN cur b ON a.user_id = b.user_id AND a.period = b.period WHERE a.fingerprint IS DISTINCT FROM b.fingerprint")
def specification_diff_all(spark, d):
    g = tables.load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("period")).agg(F.sum("event_id").alias("fingerprint"))
    other = lambda odd: g.where(F.col("user_id") % 2 == odd).withColumn("user_id", -1 - F.col("user_id"))
    return jobs.spec_diff(g.unionByName(other(0)), g.withColumn("fingerprint", F.col("fingerprint") + F.col("user_id") % 3).unionByName(other(1)), ["user_id", "period"])


# all rows are held; even keys come anew, and each key comes once more below 0
@_register("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1 - c_custkey, c_name FROM customer")
def keyed_upsert_all(spark, d):
    c = tables.load(spark, d, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 2 = 0").withColumn("c_name", F.upper("c_name"))
    return jobs.upsert(c, new.unionByName(c.withColumn("c_custkey", -1 - F.col("c_custkey"))), ["c_custkey"])


@_register("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark, d):
    return _rounded(jobs.last_wins(tables.load(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value"), "value", digits=6)


@_register("WITH t AS (SELECT c_mktsegment AS seg, max(c_acctbal) AS v FROM customer WHERE c_nationkey < 12 GROUP BY 1) SELECT c_custkey, coalesce(CASE WHEN c_nationkey = 3 THEN -1.0 END, v) AS v FROM customer LEFT JOIN t ON seg = c_mktsegment")
def wildcard_lookup(spark, d):
    c = tables.load(spark, d, "customer").withColumn("nation", F.col("c_nationkey").cast("string"))
    own = c.where("c_nationkey = 3").select(F.col("nation"), "c_mktsegment", F.lit(-1.0).alias("v")).distinct()
    every = c.where("c_nationkey < 12").groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("v")).select(F.lit("").alias("nation"), "c_mktsegment", "v")
    return jobs.wildcard_lookup(c.select("c_custkey", "nation", "c_mktsegment"), own.unionByName(every), "nation", "c_mktsegment", "v").select("c_custkey", "v")


_W = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_W}+', ''), '{_W}+$', '')"


@_register(rf"""WITH t AS (SELECT doc_id, concat_ws(chr(10), '# list', '"' || lang || '.tif" ', '  ' || chr(39) || source, '"', chr(65279) || ' a', text) AS text FROM documents),
    x AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS x FROM t),
    l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_number, unnest(x) AS raw FROM x),
    b AS (SELECT doc_id, line_number, regexp_replace({_strip_sql("raw")}, '^\x{{FEFF}}+|\x{{FEFF}}+$', '', 'g') AS bare FROM l),
    e AS (SELECT *, CASE WHEN bare[1] IN ('"', chr(39)) AND bare[-1] = bare[1] THEN CASE WHEN length(bare) = 1 THEN '' ELSE {_strip_sql("bare[2:-2]")} END ELSE bare END AS entry FROM b)
    SELECT doc_id, CAST(line_number AS BIGINT) AS line_number, entry FROM e WHERE bare <> '' AND bare[1] <> '#' AND entry <> ''""")
def path_list_lines(spark, d):
    odd = F.concat_ws("\n", F.lit("# list"), F.concat(F.lit('"'), "lang", F.lit('.tif" ')), F.concat(F.lit("  '"), "source"), F.lit('"'), F.lit("﻿ a"), "text")
    return text_lists.list_lines(tables.load(spark, d, "documents").select("doc_id", odd.alias("text")), "doc_id", "text")


@_register(r"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN ' .-. ' ELSE substr(text, 1, 24) END AS raw FROM documents), c AS (SELECT doc_id, regexp_replace(regexp_replace(raw, '[^\p{L}\p{N}_-]', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS name FROM n)
    SELECT doc_id, CASE WHEN name = '' THEN 'grid' ELSE name END AS name FROM c""")
def sanitised_names(spark, d):
    raw = F.when(F.col("doc_id") % 50 == 0, " .-. ").otherwise(F.substring("text", 1, 24))
    return tables.load(spark, d, "documents").select("doc_id", text_lists.clean_name(raw).alias("name"))


def natural_sql(x: str) -> str:
    """SQL for text_lists.natural_key, joined by |."""
    bare = r"regexp_replace(p, '^0+([0-9])', '\1')"
    cut = rf"string_split(regexp_replace(lower({x}), '([0-9]+)', chr(1) || '\1' || chr(1), 'g'), chr(1))"
    return f"array_to_string([CASE WHEN i % 2 = 0 THEN lpad(CAST(length({bare}) AS VARCHAR), 10, '0') || {bare} ELSE p END FOR p, i IN {cut}], '|')"


@_register(f"""WITH r AS (SELECT DISTINCT CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, ' %Y%m ') WHEN 4 THEN 'Phase ' || (o_orderkey % 130) ELSE '2024' || (13 + o_orderkey % 5) END AS raw FROM orders),
    t AS (SELECT raw, trim(raw) AS t, replace(trim(raw), '-', '') AS g FROM r), p AS (SELECT *, regexp_full_match(t, '[0-9]{{4}}|[0-9]{{6}}|[0-9]{{8}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS dated FROM t),
    d AS (SELECT *, CASE WHEN dated THEN try_strptime(CASE length(g) WHEN 4 THEN g || '0101' WHEN 6 THEN g || '01' ELSE g END, '%Y%m%d')::DATE END AS day FROM p)
    SELECT raw, CASE WHEN day IS NOT NULL THEN 0 WHEN NOT dated THEN 1 END AS class, CAST(CASE WHEN day IS NOT NULL THEN date_diff('day', DATE '0001-01-01', day) + 1 WHEN NOT dated THEN 0 END AS INT) AS ordinal,
        CAST(CASE WHEN day IS NOT NULL THEN (length(g) - 4) // 2 WHEN NOT dated THEN 0 END AS INT) AS granularity, CASE WHEN day IS NOT NULL THEN t WHEN NOT dated THEN {natural_sql("t")} END AS text FROM d""")
def parsed_periods(spark, d):
    o, k = tables.load(spark, d, "orders"), F.col("o_orderkey")
    form = lambda f: F.date_format("o_orderdate", f)
    raw = F.when(k % 6 == 0, form("yyyy-MM-dd")).when(k % 6 == 1, form("yyyyMMdd")).when(k % 6 == 2, form("yyyy")).when(k % 6 == 3, form("' 'yyyyMM' '"))
    raw = raw.when(k % 6 == 4, F.concat(F.lit("Phase "), k % 130)).otherwise(F.concat(F.lit("2024"), 13 + k % 5))
    keyed = o.select(raw.alias("raw")).distinct().select("raw", text_lists.period_key(F.col("raw")).alias("k"))
    return keyed.select("raw", "k.class", "k.ordinal", "k.granularity", F.array_join("k.text", "|").alias("text"))


@_register("SELECT c_custkey, sha256('seed|' || c_custkey) AS rank_hash FROM customer ORDER BY 2 LIMIT 50")
def hash_ranked_sample(spark, d):
    return text_lists.hash_sample(tables.load(spark, d, "customer").select("c_custkey"), "c_custkey", "seed", 50)


_PIXELS = "px AS (SELECT vec_id AS tile_id, label, (k // 8) AS r, (k % 8) AS c, least(greatest((CAST(v AS DOUBLE) + 0.6e0) / 1.2e0, 0.0), 1.0) AS v FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS k FROM embeddings))"


def _pixels(spark, d):
    e = tables.load(spark, d, "embeddings")
    scaled = F.transform("embedding", lambda v: F.least(F.greatest((v.cast("double") + 0.6) / 1.2, F.lit(0.0)), F.lit(1.0)))
    return raster.pixels(e.select(F.col("vec_id").alias("tile_id"), scaled.alias("values")), 8).join(e.select(F.col("vec_id").alias("tile_id"), "label"), "tile_id")


@_register(f"WITH {_PIXELS}, w AS (SELECT *, least(greatest(least(r + 1, 8 - r, c + 1, 8 - c) / 4.0e0, 0.05e0), 1.0e0) AS w FROM px) SELECT label, CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(sum(w * v) / sum(w), 6) AS value FROM w GROUP BY ALL")
def feathered_mosaic(spark, d):
    return _rounded(raster.feathered_mean(_pixels(spark, d), ["label", "row", "col"], 8, 8, 4.0), "value", digits=6)


@_register(f"WITH {_PIXELS} SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(arg_max(v, tile_id), 6) AS value FROM px GROUP BY ALL")
def last_wins_mosaic(spark, d):
    return _rounded(raster.last_wins_mosaic(_pixels(spark, d), "tile_id"), "value", digits=6)


@_register(f"WITH {_PIXELS} SELECT label AS zone, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.25), 6) AS q25, count(*) AS n FROM px GROUP BY 1")
def zonal_statistics(spark, d):
    return _rounded(raster.zonal(_pixels(spark, d).withColumnRenamed("label", "zone"), "zone"), "mean", "q25", digits=6)


@_register(f"WITH {_PIXELS} SELECT p.tile_id, CAST(p.r AS INT) AS row, CAST(p.c AS INT) AS col FROM px p WHERE NOT EXISTS (SELECT 1 FROM px q WHERE q.tile_id = p.tile_id AND abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1 AND q.v > p.v)")
def local_maxima(spark, d):
    return raster.local_maxima(_pixels(spark, d)).select("tile_id", "row", "col")


@_register(f"WITH {tables.POINTS_SQL} SELECT vec_id, round(CASE WHEN n > 0 THEN least(abs(x + y) / (n * sqrt(2.0)), 1.0) ELSE 0.5 END, 6) AS cosine FROM (SELECT *, sqrt(x * x + y * y) AS n FROM p)")
def direction_scores(spark, d):
    p = tables.points(spark, d)
    return _rounded(p.select("vec_id", geometry.abs_cosine(F.col("x"), F.col("y"), F.lit(1.0), F.lit(1.0)).alias("cosine")), "cosine", digits=6)


from waymark.bindings import fields, lines, masks, networks, paths, reports, widths  # noqa: E402, F401  register their queries
