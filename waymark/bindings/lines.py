"""Queries of line matching, on two-point lines of four periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import lines, network
from waymark.registry import register, rounded
from waymark.sources import tables

TOL, CELL = 1.0, 4.0


def _point_segment(px: str, py: str, s: str) -> str:
    """SQL: distance of a point to the segment of the row s."""
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    t = f"coalesce(least(greatest((({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0), 1), 0)"
    return f"sqrt(pow({px} - {s}.x1 - {t} * {dx}, 2) + pow({py} - {s}.y1 - {t} * {dy}, 2))"


def _distance(a: str = "a", b: str = "b") -> str:
    turn = lambda s, px, py: f"(({s}.x2 - {s}.x1) * ({py} - {s}.y1) - ({s}.y2 - {s}.y1) * ({px} - {s}.x1))"
    cross = " AND ".join(f"{turn(s, f'{o}.x1', f'{o}.y1')} * {turn(s, f'{o}.x2', f'{o}.y2')} < 0" for s, o in ((a, b), (b, a)))
    ends = ", ".join(_point_segment(f"{s}.x{i}", f"{s}.y{i}", o) for s, o in ((a, b), (b, a)) for i in (1, 2))
    return f"CASE WHEN {cross} THEN 0 ELSE least({ends}) END"


def _length(s: str) -> str:
    return f"sqrt(pow({s}.x2 - {s}.x1, 2) + pow({s}.y2 - {s}.y1, 2))"


def _cover(source: str, s: str, o: str, reach: float, name: str) -> str:
    """SQL: CTEs that add the share of s within reach of o (structs in rows of source)."""
    inf = "CAST('Infinity' AS DOUBLE)"
    return f"""{name}1 AS (SELECT *, {_length(s)} AS sz, {_length(o)} AS lg FROM {source}),
    {name}2 AS (SELECT *, coalesce(({o}.x2 - {o}.x1) / nullif(lg, 0), 1) AS ex, coalesce(({o}.y2 - {o}.y1) / nullif(lg, 0), 0) AS ey FROM {name}1),
    {name}3 AS (SELECT *, ({s}.x1 - {o}.x1) * ex + ({s}.y1 - {o}.y1) * ey AS u, ({s}.y1 - {o}.y1) * ex - ({s}.x1 - {o}.x1) * ey AS v, ({s}.x2 - {s}.x1) * ex + ({s}.y2 - {s}.y1) * ey AS du, ({s}.y2 - {s}.y1) * ex - ({s}.x2 - {s}.x1) * ey AS dv FROM {name}2),
    {name}4 AS (SELECT *, u * du + v * dv AS h0, u * u + v * v - {reach * reach} AS f0, (u - lg) * du + v * dv AS h1, (u - lg) * (u - lg) + v * v - {reach * reach} AS f1 FROM {name}3),
    {name}5 AS (SELECT *, CASE WHEN h0 * h0 - sz * sz * f0 >= 0 THEN sqrt(h0 * h0 - sz * sz * f0) END AS r0, CASE WHEN h1 * h1 - sz * sz * f1 >= 0 THEN sqrt(h1 * h1 - sz * sz * f1) END AS r1,
        CASE WHEN dv <> 0 THEN least(({-reach} - v) / dv, ({reach} - v) / dv) WHEN abs(v) <= {reach} THEN -{inf} END AS vl, CASE WHEN dv <> 0 THEN greatest(({-reach} - v) / dv, ({reach} - v) / dv) WHEN abs(v) <= {reach} THEN {inf} END AS vh,
        CASE WHEN du <> 0 THEN least(-u / du, (lg - u) / du) WHEN u BETWEEN 0 AND lg THEN -{inf} END AS ul, CASE WHEN du <> 0 THEN greatest(-u / du, (lg - u) / du) WHEN u BETWEEN 0 AND lg THEN {inf} END AS uh FROM {name}4),
    {name}6 AS (SELECT *, CASE WHEN vl IS NOT NULL AND ul IS NOT NULL AND greatest(vl, ul) <= least(vh, uh) THEN greatest(vl, ul) END AS ml, CASE WHEN vl IS NOT NULL AND ul IS NOT NULL AND greatest(vl, ul) <= least(vh, uh) THEN least(vh, uh) END AS mh FROM {name}5),
    {name} AS (SELECT * EXCLUDE (sz, lg, ex, ey, u, v, du, dv, h0, f0, h1, f1, r0, r1, vl, vh, ul, uh, ml, mh), CASE WHEN sz > 0 THEN coalesce(greatest(0, least(greatest((-h0 + r0) / (sz * sz), (-h1 + r1) / (sz * sz), mh), 1) - greatest(least((-h0 - r0) / (sz * sz), (-h1 - r1) / (sz * sz), ml), 0)), 0) ELSE 0 END AS {name}_share FROM {name}6)"""


_COSINE = f"CASE WHEN {_length('a')} * {_length('b')} > 0 THEN least(abs((a.x2 - a.x1) * (b.x2 - b.x1) + (a.y2 - a.y1) * (b.y2 - b.y1)) / ({_length('a')} * {_length('b')}), 1) ELSE 0.5 END"


def _scores(first: str, second: str, where: str = "true", tol: float = TOL) -> str:
    """SQL: CTE sc with a, b, distance, overlap, dir, score of near pairs of two row sets."""
    return f"""pr AS (SELECT a, b, {_distance()} AS distance FROM {first} a, {second} b WHERE {where}), nr AS (SELECT * FROM pr WHERE distance <= {tol}),
    {_cover('nr', 'a', 'b', tol, 'ca')}, {_cover('ca', 'b', 'a', tol, 'cb')},
    sd AS (SELECT a, b, distance, least(ca_share, cb_share) AS overlap, {_COSINE} AS dir, {_length('a')} * {_length('b')} > 0 AS ok FROM cb),
    sc AS (SELECT a, b, distance, dir, CASE WHEN ok THEN overlap ELSE 0 END AS overlap, CASE WHEN ok THEN 0.65 * overlap + 0.20 * dir + 0.15 * greatest(0, 1 - distance / {tol}) ELSE 0 END AS score FROM sd)"""


_P = tables.PERIOD_LINES_SQL
_ONE, _TWO = "(SELECT * FROM pl WHERE period = 1)", "(SELECT * FROM pl WHERE period = 2)"


def _period(spark, d, p: int):
    return tables.period_lines(spark, d).where(F.col("period") == p)


@register(f"WITH {_P}, {_scores(_ONE, _TWO)} SELECT a.line_id AS a_id, b.line_id AS b_id, round(distance, 6) AS distance, round(overlap, 6) AS overlap, round(dir, 6) AS dir_sim, round(score, 6) AS score FROM sc")
def line_scores(spark, d):
    near = lines.near_lines(lines.side(_period(spark, d, 1), "a"), lines.side(_period(spark, d, 2), "b"), TOL, CELL)
    return rounded(lines.scored(near, TOL).select("a_id", "b_id", "distance", "overlap", "dir_sim", "score"), "distance", "overlap", "dir_sim", "score", digits=6)


_RANKED = "rk AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM sc WINDOW w AS (PARTITION BY a.line_id ORDER BY round(score, 9) DESC, round(overlap, 9) DESC, distance, b.line_id DESC))"


@register(f"WITH {_P}, {_scores(_ONE, _TWO)}, {_RANKED} SELECT a.line_id AS a_id, b.line_id AS b_id, round(score, 6) AS score, coalesce(second >= score - 0.05 AND second >= 0.35, false) AS ambiguous FROM rk WHERE place = 1")
def best_line_matches(spark, d):
    best = lines.best_match(lines.side(_period(spark, d, 1), "a"), lines.side(_period(spark, d, 2), "b"), TOL, CELL)
    return rounded(best.select("a_id", "b_id", "score", "ambiguous"), "score", digits=6)


_OBSERVED = f"""{_P}, rf AS (SELECT line_id, x1, y1, x2, y2 FROM ln), {_scores('rf', 'pl')},
    rk AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM sc WINDOW w AS (PARTITION BY a.line_id, b.period ORDER BY score DESC, overlap DESC, distance, b.line_id DESC)),
    st AS (SELECT a, b, score, overlap, distance, dir, CASE WHEN overlap >= 0.35 AND score >= 0.48 AND NOT coalesce(second >= score - 0.05 AND second >= 0.35, false) THEN 'present' WHEN overlap >= 0.1 OR distance <= {TOL} THEN 'uncertain' ELSE 'absent' END AS status FROM rk WHERE place = 1),
    ev AS (SELECT r.line_id AS road_id, p.period, coalesce(status, 'absent') AS status, CASE WHEN status = 'present' THEN b.width END AS width_m, coalesce(overlap, 0) AS overlap, coalesce(score, 0) AS score, b.line_id AS source_id FROM rf r CROSS JOIN (SELECT DISTINCT period FROM pl) p LEFT JOIN st ON st.a.line_id = r.line_id AND st.b.period = p.period)"""


# references that claim one line of a period, best first: one that overlaps an accepted one is refused
_OWNED = f"""cl AS (SELECT period, source_id, road_id, row_number() OVER (PARTITION BY period, source_id ORDER BY score DESC, road_id) AS r FROM ev WHERE status = 'present'), np AS (SELECT a, b FROM rf a JOIN rf b ON a.line_id <> b.line_id AND {_distance()} <= {TOL}),
    {_cover('np', 'a', 'b', TOL, 'pa')}, {_cover('pa', 'b', 'a', TOL, 'pb')}, ot AS (SELECT a.line_id AS i, list(b.line_id) AS o FROM pb WHERE least(pa_share, pb_share) >= 0.35 GROUP BY 1),
    gr AS (SELECT period, source_id, r, [road_id] AS acc FROM cl WHERE r = 1 UNION ALL SELECT gr.period, gr.source_id, cl.r, CASE WHEN list_has_any(acc, coalesce(o, [])) THEN acc ELSE list_append(acc, road_id) END FROM gr JOIN cl ON cl.period = gr.period AND cl.source_id = gr.source_id AND cl.r = gr.r + 1 LEFT JOIN ot ON i = road_id),
    fn AS (SELECT period, source_id, arg_max(acc, r) AS acc FROM gr GROUP BY 1, 2), ow AS (SELECT period, road_id FROM cl JOIN fn USING (period, source_id) WHERE NOT list_contains(acc, road_id)),
    e3 AS (SELECT ev.* REPLACE (CASE WHEN ow.road_id IS NOT NULL THEN 'uncertain' ELSE status END AS status, CASE WHEN ow.road_id IS NULL THEN width_m END AS width_m), ow.road_id IS NOT NULL AS owned FROM ev LEFT JOIN ow ON ow.period = ev.period AND ow.road_id = ev.road_id),
    dr AS (SELECT *, coalesce(lag(status) OVER w = 'present' AND status = 'absent' AND lead(status) OVER w = 'present', false) AS dropout FROM e3 WINDOW w AS (PARTITION BY road_id ORDER BY period))"""


@register(f"""WITH {_OBSERVED.replace("p AS", "RECURSIVE p AS", 1)}, {_OWNED} SELECT road_id, period, CASE WHEN dropout THEN 'uncertain' ELSE status END AS status, width_m, round(overlap, 6) AS overlap, round(score, 6) AS score, source_id,
    CASE WHEN dropout THEN 'single_period_dropout' WHEN owned THEN 'duplicate_source_ownership' WHEN status = 'uncertain' THEN 'ambiguous_or_weak_match' ELSE '' END AS qa_reason FROM dr""")
def road_observations(spark, d):
    seen = lines.observations(tables.lines(spark, d), tables.period_lines(spark, d), TOL, CELL)
    return rounded(seen.select("road_id", "period", "status", "width_m", "overlap", "score", "source_id", "qa_reason"), "overlap", "score", digits=6)


@register()
def road_references(spark, d):
    return rounded(lines.references(tables.period_lines(spark, d), TOL, CELL), "x1", "y1", "x2", "y2", digits=6)


@register()
def road_ids(spark, d):
    prior = _period(spark, d, 1).withColumn("road_id", F.when(F.col("line_id") % 4 == 0, F.concat(F.lit("RD"), F.lpad(F.col("line_id").cast("string"), 8, "0"))).otherwise(F.concat(F.lit("x"), "line_id")))
    return lines.road_ids(_period(spark, d, 2), prior, TOL, CELL)


_SAMPLES = f"[{_point_segment('a.x1 + (a.x2 - a.x1) * k / (na - 1)', 'a.y1 + (a.y2 - a.y1) * k / (na - 1)', 'b')} FOR k IN range(0, na)] || [{_point_segment('b.x1 + (b.x2 - b.x1) * k / (nb - 1)', 'b.y1 + (b.y2 - b.y1) * k / (nb - 1)', 'a')} FOR k IN range(0, nb)]"
_COUNT = lambda s: f"CAST(least(greatest(ceil({_length(s)} / 0.5) + 1, 3), 101) AS INT)"


def _ends(tol: float) -> str:
    end = lambda s, i, o: f"greatest(0, 1 - least({', '.join(f'sqrt(pow({s}.x{i} - {o}.x{j}, 2) + pow({s}.y{i} - {o}.y{j}, 2))' for j in (1, 2))}) / {3 * tol})"
    return f"({' + '.join(end(s, i, o) for s, o in (('a', 'b'), ('b', 'a')) for i in (1, 2))}) / 4"


def _degrees(rows: str, name: str) -> str:
    ends = f"(SELECT line_id, 1 AS e, x1 AS x, y1 AS y FROM {rows} UNION ALL SELECT line_id, 2, x2, y2 FROM {rows})"
    return f"{name} AS (SELECT a.line_id, count(*) AS n FROM {ends} a, {ends} b WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.25 GROUP BY 1)"


_MATCHED = f"""{_P}, {_degrees(_ONE, 'd1')}, {_degrees(_TWO, 'd2')}, pr AS (SELECT a, b, {_distance()} AS distance FROM {_ONE} a, {_TWO} b), nr AS (SELECT *, {_COSINE} AS dir FROM pr WHERE distance <= {TOL}),
    dr AS (SELECT * FROM nr WHERE dir >= 0.85), {_cover('dr', 'a', 'b', TOL, 'ca')}, {_cover('ca', 'b', 'a', TOL, 'cb')},
    ov AS (SELECT *, {_COUNT('a')} AS na, {_COUNT('b')} AS nb FROM cb WHERE greatest(ca_share, cb_share) >= 0.35 AND least(ca_share * {_length('a')}, cb_share * {_length('b')}) >= 0.5),
    md AS (SELECT *, list_median({_SAMPLES}) AS med FROM ov), cl AS (SELECT * FROM md WHERE med <= {TOL}),
    fs AS (SELECT a.line_id AS a_id, b.line_id AS b_id, med, 0.30 * greatest(ca_share, cb_share) + 0.10 * least(ca_share, cb_share) + 0.25 * greatest(0, 1 - med / {TOL}) + 0.20 * dir + 0.05 * {_ends(TOL)} + 0.05 * least({_length('a')}, {_length('b')}) / greatest({_length('a')}, {_length('b')}, 1e-9)
        + 0.05 * (1 - least(1, abs(d1.n - d2.n) / 4.0)) AS score FROM cl JOIN d1 ON d1.line_id = a.line_id JOIN d2 ON d2.line_id = b.line_id),
    gd AS (SELECT *, min(med) OVER (PARTITION BY a_id) AS ma, min(med) OVER (PARTITION BY b_id) AS mb FROM fs), vd AS (SELECT a_id, b_id, med, score FROM gd WHERE med <= ma + 0.25 AND med <= mb + 0.25)"""


@register(f"WITH {_MATCHED} SELECT a_id, b_id, round(med, 6) AS median_distance, round(score, 6) AS score FROM vd")
def segment_matches(spark, d):
    m = lines.match_segments(_period(spark, d, 1), _period(spark, d, 2), TOL, CELL, overlap=0.5, spacing=0.5, slack=0.25, related=False)
    return rounded(m.select("a_id", "b_id", "median_distance", "score"), "median_distance", "score", digits=6)


@register(f"""WITH {_MATCHED.replace("p AS", "RECURSIVE p AS", 1)}, lk AS (SELECT x.a_id, y.a_id AS other FROM vd x JOIN vd y ON x.b_id = y.b_id), rc AS (SELECT a_id, a_id AS seen FROM vd UNION SELECT rc.a_id, other FROM rc JOIN lk ON lk.a_id = rc.seen), pt AS (SELECT a_id, min(seen) AS part FROM rc GROUP BY 1),
    sz AS (SELECT part, count(DISTINCT a_id) AS na, count(DISTINCT b_id) AS nb FROM vd JOIN pt USING (a_id) GROUP BY 1)
    SELECT a_id, b_id, part, CASE WHEN na = 1 AND nb = 1 THEN 'one_to_one' WHEN na = 1 THEN 'one_to_many' WHEN nb = 1 THEN 'many_to_one' ELSE 'partial' END AS relation FROM vd JOIN pt USING (a_id) JOIN sz USING (part)""")
def match_relations(spark, d):
    m = lines.match_segments(_period(spark, d, 1), _period(spark, d, 2), TOL, CELL, overlap=0.5, spacing=0.5, slack=0.25)
    return m.select("a_id", "b_id", "part", "relation")


@register("""WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity - 3 AS b, (l_quantity - 3) * (0.4e0 + (l_partkey % 17) / 8.0e0) AS a, l_returnflag <> 'N' AS ok, (l_suppkey % 11) / 10.0e0 AS v, (l_partkey % 5) / 4.0e0 AS s FROM lineitem),
    m AS (SELECT *, abs(a - b) / greatest(b, a, 0.1e0) AS r FROM w) SELECT l_orderkey, l_linenumber, CASE WHEN NOT (abs(a - b) >= 2 AND r >= 0.2) THEN 'none' WHEN r > 0.75 THEN 'excessive' WHEN b <= 0 OR a <= 0 THEN 'missing' WHEN NOT ok THEN 'quality' WHEN v >= 0.6 AND s >= 0.7 THEN 'candidate' ELSE 'unsupported' END AS outcome FROM m""")
def width_outcomes(spark, d):
    before = F.col("l_quantity") - 3
    after = before * (0.4 + F.col("l_partkey") % 17 / F.lit(8.0))
    outcome = lines.width_rejection(before, after, F.col("l_returnflag") != "N", F.col("l_suppkey") % 11 / F.lit(10.0), F.col("l_partkey") % 5 / F.lit(4.0))
    return tables.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", outcome.alias("outcome"))


def _project(px: str, py: str, s: str) -> str:
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    return f"coalesce(least(greatest((({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0), 1), 0)"


_MID = "(s + e) / 2 / nullif(len, 0)"


@register(f"""WITH {_P}, pr AS (SELECT a, b, {_distance()} AS distance FROM {_ONE} a, {_TWO} b), q AS (SELECT a, b, {_length('a')} AS len, {_project('b.x1', 'b.y1', 'a')} * {_length('a')} AS p1, {_project('b.x2', 'b.y2', 'a')} * {_length('a')} AS p2 FROM pr WHERE distance <= {TOL}),
    i AS (SELECT a, b, len, least(p1, p2) AS s, greatest(p1, p2) AS e FROM q) SELECT a.line_id AS a_id, b.line_id AS b_id, round(s, 6) AS start, round(e, 6) AS "end" FROM i WHERE e - s > 1e-6 AND {_point_segment(f'(a.x1 + {_MID} * (a.x2 - a.x1))', f'(a.y1 + {_MID} * (a.y2 - a.y1))', 'b')} <= {TOL}""")
def line_intervals(spark, d):
    out = lines.intervals_on(lines.side(_period(spark, d, 1), "a"), lines.side(_period(spark, d, 2), "b"), TOL, CELL)
    return rounded(out, "start", "end", digits=6)


@register(f"""WITH {_P.replace("p AS", "RECURSIVE p AS", 1)}, sg AS (SELECT *, line_id % 2 AS sign FROM {_ONE}), lk AS (SELECT a.line_id AS i, b.line_id AS j FROM sg a, sg b WHERE a.line_id <> b.line_id AND a.sign = b.sign AND {_distance()} <= 0.8 AND {_COSINE} >= 0.75), rc AS (SELECT line_id, line_id AS seen FROM sg UNION SELECT rc.line_id, j FROM rc JOIN lk ON i = seen)
    SELECT line_id, min(seen) AS part FROM rc GROUP BY 1""")
def line_groups(spark, d):
    return lines.line_components(_period(spark, d, 1).withColumn("sign", F.col("line_id") % 2), 0.8, 0.75, CELL)


_DEN = "((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1))"


@register(f"""WITH {_P}, x AS (SELECT a, b, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / {_DEN} AS t, ((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / {_DEN} AS s FROM ln a, ln b WHERE a.line_id < b.line_id AND {_DEN} <> 0)
    SELECT a.line_id AS a_id, b.line_id AS b_id, round(a.x1 + t * (a.x2 - a.x1), 6) AS x, round(a.y1 + t * (a.y2 - a.y1), 6) AS y FROM x WHERE t > 0 AND t < 1 AND s > 0 AND s < 1""")
def line_crossings(spark, d):
    return rounded(lines.crossings(tables.lines(spark, d), CELL), "x", "y", digits=6)


_DOTS = "dt AS (SELECT vec_id AS id, x + 0.7 AS x, y - 0.4 AS y FROM p)"


@register(f"WITH {_P}, {_DOTS}, n AS (SELECT id, b, a.x AS px, a.y AS py, {_point_segment('a.x', 'a.y', 'b')} AS distance FROM dt a, ln b), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, b.line_id) AS r FROM n WHERE distance <= 2) SELECT id, b.line_id AS line_id, round(distance, 6) AS distance, round(b.x1 + {_project('px', 'py', 'b')} * (b.x2 - b.x1), 6) AS x, round(b.y1 + {_project('px', 'py', 'b')} * (b.y2 - b.y1), 6) AS y FROM m WHERE r = 1")
def nearest_lines(spark, d):
    dots = tables.points(spark, d).select(F.col("vec_id").alias("id"), (F.col("x") + 0.7).alias("x"), (F.col("y") - 0.4).alias("y"))
    return rounded(lines.nearest_line(dots, tables.lines(spark, d), 2.0, CELL), "distance", "x", "y", digits=6)


_NETEDGES = "ed AS (SELECT 1000 * a.vec_id + b.vec_id AS line_id, a.vec_id AS src, b.vec_id AS dst, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a, p b WHERE a.vec_id < b.vec_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1)"


def _net_lines(spark, d):
    from waymark.bindings.networks import net

    nodes, edges = net(spark, d)
    placed = network.placed(nodes, edges)
    return nodes, placed.select((F.col("src") * 1000 + F.col("dst")).alias("line_id"), "src", "dst", "x1", "y1", "x2", "y2")


@register(f"""WITH {tables.POINTS_SQL}, {_NETEDGES}, nn AS (SELECT a.vec_id AS id, arg_min(b.vec_id, struct_pack(d := sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), i := b.vec_id)) AS node FROM p a, p b WHERE a.vec_id <> b.vec_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.5 GROUP BY 1),
    ne AS (SELECT a.vec_id AS id, arg_min(b.line_id, struct_pack(d := {_point_segment('a.x', 'a.y', 'b')}, i := b.line_id)) AS edge FROM p a, ed b WHERE a.vec_id NOT IN (b.src, b.dst) AND {_point_segment('a.x', 'a.y', 'b')} <= 0.5 GROUP BY 1)
    SELECT vec_id AS id, coalesce(node, edge) AS target, CASE WHEN node IS NOT NULL THEN 'node' WHEN edge IS NOT NULL THEN 'edge' ELSE 'none' END AS kind FROM p LEFT JOIN nn ON nn.id = vec_id LEFT JOIN ne ON ne.id = vec_id""")
def snapped_points(spark, d):
    nodes, edges = _net_lines(spark, d)
    return lines.snapped(nodes.withColumnRenamed("node", "id"), nodes, edges, 0.5, CELL)


@register(f"WITH {tables.POINTS_SQL} SELECT vec_id AS id FROM p a WHERE label < 5 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.label >= 5 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 2)")
def lonely_points(spark, d):
    p = tables.points(spark, d)
    return lines.without_near(p.where("label < 5").select(F.col("vec_id").alias("id"), "x", "y"), p.where("label >= 5"), 2.0).select("id")


@register(f"WITH {tables.POINTS_SQL}, n AS (SELECT a.label AS patch, a.vec_id AS id, b.vec_id AS near, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.vec_id) AS place FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 8) SELECT patch, id, place, near FROM n WHERE place <= 3")
def patch_neighbours(spark, d):
    return lines.neighbours_in_patch(tables.points(spark, d).select(F.col("label").alias("patch"), F.col("vec_id").alias("id"), "x", "y"), 3, 8.0)


_KEY = lambda s: f"least(struct_pack(r := CAST(round_even({s}.y1, 0) AS BIGINT), c := CAST(round_even({s}.x1, 0) AS BIGINT)), struct_pack(r := CAST(round_even({s}.y2, 0) AS BIGINT), c := CAST(round_even({s}.x2, 0) AS BIGINT))) AS s, greatest(struct_pack(r := CAST(round_even({s}.y1, 0) AS BIGINT), c := CAST(round_even({s}.x1, 0) AS BIGINT)), struct_pack(r := CAST(round_even({s}.y2, 0) AS BIGINT), c := CAST(round_even({s}.x2, 0) AS BIGINT))) AS t"
_OFF = "least(greatest(sqrt(pow(e.x1 - k.s.c, 2) + pow(e.y1 - k.s.r, 2)), sqrt(pow(e.x2 - k.t.c, 2) + pow(e.y2 - k.t.r, 2))), greatest(sqrt(pow(e.x1 - k.t.c, 2) + pow(e.y1 - k.t.r, 2)), sqrt(pow(e.x2 - k.s.c, 2) + pow(e.y2 - k.s.r, 2))))"


@register(f"""WITH {_P}, k AS (SELECT s, t, avg(v) AS value FROM (SELECT {_KEY('pl')}, width AS v FROM pl WHERE period = 2) GROUP BY 1, 2), e AS (SELECT *, {_KEY('q')} FROM {_ONE} q), x AS (SELECT e.*, k.value FROM e LEFT JOIN k ON e.s = k.s AND e.t = k.t),
    n AS (SELECT e.line_id, k.value, row_number() OVER (PARTITION BY e.line_id ORDER BY {_OFF}, k.s, k.t) AS r FROM x e, k WHERE e.value IS NULL AND {_OFF} <= 1.5) SELECT x.line_id, round(coalesce(x.value, n.value), 6) AS value FROM x LEFT JOIN n ON n.line_id = x.line_id AND r = 1""")
def edge_scores(spark, d):
    records = _period(spark, d, 2).withColumnRenamed("width", "value")
    return rounded(lines.edge_values(_period(spark, d, 1), records, 1.5, CELL), "value", digits=6)
