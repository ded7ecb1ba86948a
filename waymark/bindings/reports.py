"""Queries of roll-ups, review queues, reports and job state."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.bindings.networks import _E, _PARTS, _REC, net
from waymark.operators import evaluate, graph, jobs, network, reports
from waymark.registry import register, rounded
from waymark.sources import tables

_CHANGES = """ch AS (SELECT l_orderkey * 10 + l_linenumber AS fid, l_partkey, ['added', 'removed', 'widened', 'narrowed', 'width_changed'][l_partkey % 5 + 1] AS change_typ, CASE WHEN l_suppkey % 3 = 0 THEN 'review' WHEN l_suppkey % 3 = 1 THEN 'auto' END AS qa_state, l_quantity AS length_m, CAST(round(l_extendedprice) AS DOUBLE) AS area_m2 FROM lineitem)"""


def _changes(spark, d):
    kinds = F.array(*[F.lit(t) for t in (*reports.CHANGE_TYPES, "width_changed")])
    s = F.col("l_suppkey") % 3
    return tables.load(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fid"), F.get(kinds, (F.col("l_partkey") % 5).cast("int")).alias("change_typ"),
        F.when(s == 0, "review").when(s == 1, "auto").alias("qa_state"), F.col("l_quantity").alias("length_m"), F.round("l_extendedprice").alias("area_m2"),
    )


@register(f"""WITH {_CHANGES}, t AS (SELECT unnest(['added', 'removed', 'widened', 'narrowed']) AS change_typ), s AS (SELECT change_typ, coalesce(qa_state, 'auto') = 'auto' AS a, length_m, area_m2 FROM ch)
    SELECT t.change_typ, count(*) FILTER (a) AS n, coalesce(sum(length_m) FILTER (a), 0) AS length_m, coalesce(sum(area_m2) FILTER (a), 0) AS area_m2, count(*) FILTER (NOT a) AS review_n FROM t LEFT JOIN s USING (change_typ) GROUP BY 1""")
def change_summary(spark, d):
    return reports.class_summary(_changes(spark, d))


@register("""WITH c AS (SELECT o_orderkey, ['added', 'removed', 'widened', 'narrowed'][o_custkey % 4 + 1] AS change_typ FROM orders) SELECT o_orderkey, change_typ, upper(change_typ[1]) || lpad(CAST(row_number() OVER (PARTITION BY change_typ ORDER BY o_orderkey) AS VARCHAR), 7, '0') AS change_id FROM c""")
def numbered_changes(spark, d):
    kinds = F.array(*[F.lit(t) for t in reports.CHANGE_TYPES])
    rows = tables.load(spark, d, "orders").select("o_orderkey", F.get(kinds, (F.col("o_custkey") % 4).cast("int")).alias("change_typ"))
    return reports.change_ids(rows, "o_orderkey")


@register("""WITH a AS (SELECT c_custkey AS id, 'customer' AS source, CASE WHEN c_custkey % 3 = 0 THEN 'review' END AS qa_state, NULL AS extra FROM customer), b AS (SELECT s_suppkey, 'supplier', NULL, s_name FROM supplier) SELECT id, source, coalesce(qa_state, 'auto') AS qa_state, extra FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def combined_tables(spark, d):
    c = tables.load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("source"), F.when(F.col("c_custkey") % 3 == 0, "review").alias("qa_state"))
    s = tables.load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"), F.col("s_name").alias("extra"))
    return reports.combined(c, s).select("id", "source", "qa_state", "extra")


@register("SELECT c_custkey AS id, 'before' AS period FROM customer UNION ALL SELECT s_suppkey, 'after' FROM supplier")
def tagged_tables(spark, d):
    return reports.tagged({"before": tables.load(spark, d, "customer").select(F.col("c_custkey").alias("id")), "after": tables.load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))})


@register(f"WITH {_E}, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM dg), x AS (SELECT a.id AS src, b.id AS dst FROM g JOIN n a ON a.node = src JOIN n b ON b.node = dst) SELECT src, dst FROM x UNION ALL SELECT src + (SELECT count(*) FROM n), dst + (SELECT count(*) FROM n) FROM x")
def joined_graph_edges(spark, d):
    one = network.compact(*net(spark, d))
    return reports.joined_graphs([one, one])[1]


_EV = "ev AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'widened' END AS event_typ, 'temporal' AS evidence, 'auto' AS qa_state FROM events)"


@register(f"WITH {_EV}, pt AS (SELECT DISTINCT event_id FROM events WHERE user_id % 3 = 0) SELECT event_id, CASE WHEN event_typ = 'uncertain' THEN evidence WHEN event_id IN (SELECT event_id FROM pt) THEN 'temporal_state_and_pair_change' ELSE 'state_only_no_pair_part' END AS evidence, CASE WHEN event_typ <> 'uncertain' AND event_id NOT IN (SELECT event_id FROM pt) THEN 'review' ELSE qa_state END AS qa_state FROM ev")
def evidenced_events(spark, d):
    e, k = tables.load(spark, d, "events"), F.col("event_id") % 4
    rows = e.select("event_id", F.when(k == 0, "uncertain").when(k == 1, "added").when(k == 2, "removed").otherwise("widened").alias("event_typ"), F.lit("temporal").alias("evidence"), F.lit("auto").alias("qa_state"))
    parts = e.where("user_id % 3 = 0").select(F.col("event_id").cast("string").alias("event_id"))
    return reports.event_evidence(rows.withColumn("event_id", F.col("event_id").cast("string")), parts, True).select(F.col("event_id").cast("long").alias("event_id"), "evidence", "qa_state")


@register("SELECT count(*) AS images, count(*) FILTER (lang = 'en') AS default_images, count(*) FILTER (lang = 'de') AS weak_images, count(*) FILTER (lang = 'en') > 0 AND count(*) FILTER (lang = 'de') > 0 AS mixed, 'automatic' AS selection FROM documents")
def profile_decisions(spark, d):
    kind = F.when(F.col("lang") == "en", "default").when(F.col("lang") == "de", "weak_sensor")
    return reports.profile_counts(tables.load(spark, d, "documents").select(kind.alias("effective_profile")), "auto")


@register("WITH s AS (SELECT l_suppkey AS src, l_partkey % 40 AS dst, l_discount * 10 AS score FROM lineitem WHERE l_linenumber % 4 > 0), m AS (SELECT src, dst, avg(score) AS score FROM s GROUP BY 1, 2) SELECT src, dst, round(score, 6) AS score, score > 0.51 AS chosen FROM m WHERE score > 0.43")
def averaged_edges(spark, d):
    s = tables.load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 40).alias("dst"), (F.col("l_discount") * 10).alias("score"), (F.col("l_linenumber") % 4 > 0).alias("valid"))
    return rounded(reports.edge_averages(s, 0.43, 0.51), "score", digits=6)


@register("""WITH p AS (SELECT label AS t, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS p FROM embeddings WHERE label < 11), n AS (SELECT unnest(range(0, 11)) AS k), c AS (SELECT k, (SELECT count(*) FROM p WHERE t = k) AS a, (SELECT count(*) FROM p WHERE p.p = k) AS f, (SELECT count(*) FROM p WHERE t = k AND p.p = k) AS tp FROM n),
    m AS (SELECT k, CASE WHEN f > 0 THEN tp / CAST(f AS DOUBLE) ELSE 0 END AS p, CASE WHEN a > 0 THEN tp / CAST(a AS DOUBLE) ELSE 0 END AS r, CASE WHEN a + f - tp > 0 THEN tp / CAST(a + f - tp AS DOUBLE) ELSE 0 END AS i, tp, a FROM c)
    SELECT CAST(k AS INT) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(i, 6) AS iou, CAST(NULL AS DOUBLE) AS accuracy FROM m UNION ALL SELECT NULL, NULL, NULL, NULL, round(avg(i), 6), round(sum(tp) / CAST(sum(a) AS DOUBLE), 6) FROM m""")
def class_confusion(spark, d):
    e = tables.load(spark, d, "embeddings")
    rows = e.select(F.col("label").cast("int").alias("truth"), F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("predicted"))
    return reports.class_confusion(rows, 11)


_STATUS = "CASE (src + dst) % 5 WHEN 0 THEN 'surface_missing' WHEN 1 THEN 'partial_surface' WHEN 2 THEN 'measurement_censored' ELSE 'measured' END"
_BRIDGES = "cut AS (SELECT src AS a, dst AS b, src AS node FROM g UNION SELECT a, b, e2.dst FROM cut JOIN e2 ON e2.src = node WHERE NOT (e2.src = a AND e2.dst = b) AND NOT (e2.src = b AND e2.dst = a)), parting AS (SELECT src, dst FROM g ANTI JOIN (SELECT a AS src, b AS dst FROM cut WHERE node = b) USING (src, dst))"
_ANNOTATED = f"""{_REC(_E)}, {_PARTS}, {_BRIDGES}, sz AS (SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM parts), ed AS (SELECT src * 1000 + dst AS edge_id, src, dst, length * 100 AS length, {_STATUS} AS status, (src + dst) % 4 <> 3 AS review, (src * 7 + dst) % 10 / 10.0e0 AS probability FROM g),
    an AS (SELECT ed.*, size, EXISTS (SELECT 1 FROM parting q WHERE q.src = ed.src AND q.dst = ed.dst) AS bridge, a.degree = 1 OR b.degree = 1 AS free FROM ed JOIN sz ON sz.node = ed.src JOIN dg a ON a.node = ed.src JOIN dg b ON b.node = ed.dst),
    im AS (SELECT *, CASE WHEN bridge AND size >= 4 THEN 'bridge_connectivity' WHEN free THEN 'dangling_branch' ELSE 'network_edge' END AS impact, CASE WHEN status = 'surface_missing' THEN 'line_without_surface' WHEN status IN ('partial_surface', 'measurement_censored') THEN 'line_surface_uncertain' WHEN review THEN 'width_quality' ELSE 'line_surface_agree' END AS conflict FROM an),
    sr AS (SELECT *, least(100, CASE conflict WHEN 'line_without_surface' THEN 55 WHEN 'line_surface_uncertain' THEN 35 WHEN 'width_quality' THEN 20 ELSE 0 END + CASE impact WHEN 'bridge_connectivity' THEN 35 WHEN 'dangling_branch' THEN 15 ELSE 0 END + CASE WHEN length > 80 THEN 5 ELSE 0 END) AS score,
        status = 'surface_missing' AND probability >= 0.6 AND impact <> 'dangling_branch' AS retained FROM im)"""


def _annotated(spark, d):
    nodes, edges = net(spark, d)
    s, t = F.col("src"), F.col("dst")
    rows = network.placed(nodes, edges).select((s * 1000 + t).alias("edge_id"), "src", "dst", (F.col("length") * 100).alias("length"), F.expr(_STATUS).alias("status"), ((s + t) % 4 != 3).alias("review"), ((s * 7 + t) % 10 / F.lit(10.0)).alias("probability"))
    return reports.annotated(rows, graph.components(nodes, edges), graph.degrees(edges), network.bridges(edges))


@register(f"WITH {_ANNOTATED} SELECT edge_id, impact, conflict, score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS priority, retained, review AND NOT retained AS review FROM sr")
def annotated_edges(spark, d):
    return _annotated(spark, d).select("edge_id", "impact", "conflict", "score", "priority", "retained", "review")


@register("""WITH e AS (SELECT p_partkey AS id, CAST(p_size * 2 AS INT) AS score, CASE WHEN p_size > 30 THEN 'high' ELSE 'low' END AS priority FROM part WHERE p_partkey % 3 = 0), c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 END AS region, s_suppkey % 4 = 0 AS ok, s_acctbal / 20000 AS t, s_suppkey % 3 = 0 AS med FROM supplier),
    cs AS (SELECT id, region, ok, CASE WHEN ok THEN CAST(round_even(t * 100, 0) AS INT) WHEN med THEN 70 ELSE 45 END AS score FROM c), r AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 65 WHEN 1 THEN 40 ELSE 20 END AS score FROM customer WHERE c_custkey NOT IN (SELECT region FROM cs WHERE region IS NOT NULL)),
    q AS (SELECT 'edge_review' AS item_type, CAST(id AS VARCHAR) AS item_id, score, priority, false AS manual FROM e UNION ALL SELECT 'candidate_centerline', CAST(id AS VARCHAR), score, CASE WHEN ok THEN 'auto' WHEN score >= 60 THEN 'high' ELSE 'medium' END, NOT ok FROM cs
        UNION ALL SELECT 'surface_only_region', CAST(id AS VARCHAR), score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END, true FROM r) SELECT *, row_number() OVER (ORDER BY score DESC, item_type, item_id) AS rank FROM q""")
def review_queue(spark, d):
    p, s, c = (tables.load(spark, d, t) for t in ("part", "supplier", "customer"))
    e = p.select(F.col("p_partkey").alias("edge_id"), (F.col("p_partkey") % 3 == 0).alias("review"), (F.col("p_size") * 2).alias("score"), F.when(F.col("p_size") > 30, "high").otherwise("low").alias("priority"))
    k = F.col("s_suppkey")
    cand = s.select(k.alias("candidate_id"), F.when(k % 2 == 0, k * 3).alias("region_id"), (k % 4 == 0).alias("accept"), (F.col("s_acctbal") / 20000).alias("topology"), F.when(k % 3 == 0, "medium").otherwise("low").alias("confidence"))
    m = F.col("c_custkey") % 3
    regions = c.select(F.col("c_custkey").alias("region_id"), F.when(m == 0, "surface_only_candidate").when(m == 1, "surface_only_review").otherwise("surface_only_suspect").alias("status"))
    return reports.review_queue(e, cand, regions)


@register("""WITH r AS (SELECT DISTINCT c_mktsegment AS stem, 'edge' AS item_type, CAST(c_custkey % 70 AS VARCHAR) AS item_id FROM customer), d AS (SELECT DISTINCT c_mktsegment AS stem, 'edge' AS item_type, CAST(c_custkey % 90 AS VARCHAR) AS item_id FROM customer WHERE c_nationkey % 5 > 2), x AS (SELECT count(*) AS n FROM r), y AS (SELECT count(*) AS m FROM r SEMI JOIN d USING (stem, item_type, item_id))
    SELECT n AS required, m AS completed, n - m AS remaining, round(100.0e0 * m / greatest(1, n), 1) AS percent, n = m AS complete FROM x, y""")
def review_progress(spark, d):
    c = tables.load(spark, d, "customer")
    key = lambda n: [F.col("c_mktsegment").alias("stem"), F.lit("edge").alias("item_type"), (F.col("c_custkey") % n).cast("string").alias("item_id")]
    m = F.col("c_nationkey") % 5
    said = F.when(m == 0, "defer").when(m == 1, "skip").when(m == 2, "").otherwise("accept")
    return reports.review_progress(c.select(*key(70)), c.select(*key(90), said.alias("decision")))


@register("""WITH t AS (SELECT sum(o_custkey) AS original, sum(o_custkey + o_orderkey % 5) AS optimized, sum(o_orderkey % 3) AS gaps, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS surfaces, count(*) FILTER (o_orderkey % 7 = 0) AS edited FROM orders WHERE o_orderkey % 11 > 0)
    SELECT CAST(original AS BIGINT) AS original, CAST(optimized AS BIGINT) AS optimized, CAST(gaps AS BIGINT) AS gaps, CAST(surfaces AS BIGINT) AS surfaces, edited, CAST(greatest(0, optimized - original) AS BIGINT) AS added FROM t""")
def fusion_totals(spark, d):
    k = F.col("o_orderkey")
    fields = F.struct(F.col("o_custkey").alias("original_edge_count"), (F.col("o_custkey") + k % 5).alias("optimized_edge_count"), (k % 3).alias("auto_accepted_gap_count"), F.when(k % 2 == 0, 1).alias("auto_accepted_surface_count"), (k % 7 == 0).alias("geometry_edited"))
    return reports.fusion_totals(tables.load(spark, d, "orders").select(F.when(k % 11 > 0, F.to_json(fields)).otherwise("{not json").alias("json")))


@register("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(event_id) AS f FROM events GROUP BY ALL), prior AS (SELECT * FROM e UNION ALL SELECT user_id, day + 400, f FROM e WHERE user_id % 9 = 0), cur AS (SELECT user_id, day, f + CASE WHEN (user_id + day(day)) % 6 = 0 THEN 1 ELSE 0 END AS f FROM e),
    ch AS (SELECT coalesce(p.user_id, c.user_id) AS u, coalesce(p.day, c.day) AS d FROM prior p FULL JOIN cur c ON p.user_id = c.user_id AND p.day = c.day WHERE p.f IS DISTINCT FROM c.f), pr AS (SELECT user_id, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before, day AS after FROM cur)
    SELECT user_id AS grid, before, after FROM pr WHERE before IS NOT NULL AND (EXISTS (SELECT 1 FROM ch WHERE u = user_id AND d = before) OR EXISTS (SELECT 1 FROM ch WHERE u = user_id AND d = after))""")
def invalidated_pairs(spark, d):
    e = tables.load(spark, d, "events").groupBy(F.col("user_id").alias("grid"), F.to_date("ts").alias("period")).agg(F.sum("event_id").alias("fingerprint"))
    prior = e.unionByName(e.where("grid % 9 = 0").withColumn("period", F.date_add("period", 400)))
    moved = F.col("fingerprint") + F.when((F.col("grid") + F.dayofmonth("period")) % 6 == 0, 1).otherwise(0)
    return reports.invalidation(prior, e.withColumn("fingerprint", moved))[1]


@register("WITH p AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), q AS (SELECT lag(d) OVER (ORDER BY d) AS before, d AS after FROM p) SELECT before, after FROM q WHERE before IS NOT NULL AND (day(before) % 7 = 0 OR day(after) % 7 = 0)")
def affected_pairs(spark, d):
    from waymark.operators import lifecycle

    days = tables.load(spark, d, "events").select(F.to_date("ts").alias("period")).distinct()
    return jobs.affected_pairs(lifecycle.adjacent_pairs(days), days.where(F.dayofmonth("period") % 7 == 0))


@register("""WITH p AS (SELECT 'period' AS type, c_mktsegment AS grid, c_name AS scope, 'complete' AS status, c_acctbal AS seconds, 'g' || c_custkey AS output, '' AS message FROM customer), c AS (SELECT 'change', s_name, s_suppkey || ' -> ' || (s_suppkey + 1), 'complete', s_acctbal, 'o', '' FROM supplier),
    t AS (SELECT 'temporal', n_name, n_regionkey || ' 期长时序道路', 'complete', CAST(n_nationkey AS DOUBLE), 'life', '' FROM nation), f AS (SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'failure' ELSE 'period' END, r_name, 'x', CASE WHEN r_regionkey = 1 THEN 'skipped' ELSE 'failed' END, 0.5e0, '', 'e' || r_regionkey FROM region)
    SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM t UNION ALL SELECT * FROM f""")
def task_report(spark, d):
    c, s, n, r = (tables.load(spark, d, t) for t in ("customer", "supplier", "nation", "region"))
    text = lambda x: F.col(x).cast("string")
    p = c.select(F.col("c_mktsegment").alias("grid"), F.col("c_name").alias("period"), F.col("c_acctbal").alias("seconds"), F.concat(F.lit("g"), "c_custkey").alias("gpkg"))
    ch = s.select(F.col("s_name").alias("grid"), text("s_suppkey").alias("before"), (F.col("s_suppkey") + 1).cast("string").alias("after"), F.col("s_acctbal").alias("seconds"), F.lit("o").alias("output"))
    t = n.select(F.col("n_name").alias("grid"), F.col("n_regionkey").alias("periods"), F.col("n_nationkey").cast("double").alias("seconds"), F.lit("life").alias("life"))
    k = F.col("r_regionkey")
    f = r.select(F.when(k % 2 != 0, "period").alias("type"), F.col("r_name").alias("grid"), F.lit("x").alias("scope"), F.when(k == 1, "skipped").alias("status"), F.lit(0.5).alias("seconds"), F.concat(F.lit("e"), k).alias("error"))
    return reports.task_report(p, ch, t, f)


_SUP = "x AS (SELECT o_custkey % 20 AS task, ['all', 'added', 'removed'][o_orderkey % 3 + 1] AS class, floor(o_totalprice) AS v, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 90 END AS l FROM orders)"


@register(f"""WITH {_SUP}, s AS (SELECT class, sum(v) AS tp, sum(floor(v / 2)) AS fp, sum(floor(v / 4)) AS fn, sum(1.0e0) AS tn, sum(l) AS tl, sum(2 * l) AS pl, sum(l * 3) AS ti, sum(5.0e0) AS pi, count(*) AS tasks FROM x GROUP BY 1)
    SELECT class, tasks, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(tp / (tp + fp + fn), 9) AS iou, round(CASE WHEN tl > 0 AND pl > 0 THEN CAST(ti AS DOUBLE) / tl END, 9) AS truth_to_predicted, round(CASE WHEN tl > 0 AND pl > 0 THEN CAST(ti + pi AS DOUBLE) / (tl + pl) END, 9) AS mean_offset FROM s""")
def pooled_evaluation(spark, d):
    k, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    kinds = F.array(*[F.lit(x) for x in ("all", "added", "removed")])
    size = F.when(k % 3 == 0, 0.0).otherwise((F.col("o_custkey") % 90).cast("double"))
    cells = [v.alias("tp"), F.floor(v / 2).cast("double").alias("fp"), F.floor(v / 4).cast("double").alias("fn"), F.lit(1.0).alias("tn")]
    more = [size.alias("truth_length"), (2 * size).alias("predicted_length"), (3 * size).alias("truth_integral"), F.lit(5.0).alias("predicted_integral")]
    rows = tables.load(spark, d, "orders").select(F.get(kinds, (k % 3).cast("int")).alias("class"), *cells, *more)
    out = evaluate.pooled(rows, "class").select("class", "tasks", "precision", "recall", "iou", "truth_to_predicted", "mean_offset")
    return rounded(out, "precision", "recall", "iou", "truth_to_predicted", "mean_offset", digits=9)

