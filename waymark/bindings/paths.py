"""Queries of polylines, groupings, splits and network change."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark import catalog as base
from waymark.bindings.lines import _ONE, _TWO, CELL, TOL, _distance, _length, _period, _point_segment, _project
from waymark.bindings.networks import net
from waymark.operators import change, lifecycle, lines, paths
from waymark.registry import register, rounded
from waymark.sources import tables

_P = tables.PERIOD_LINES_SQL
_POLY = """pp AS (SELECT vec_id AS line_id, unnest(range(0, 8)) AS k, embedding FROM embeddings), pt AS (SELECT line_id, k, CAST(embedding[2 * k + 1] AS DOUBLE) * 100 AS x, CAST(embedding[2 * k + 2] AS DOUBLE) * 100 AS y FROM pp),
    sg AS (SELECT line_id, k, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pt WINDOW w AS (PARTITION BY line_id ORDER BY k)), sz AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS s FROM sg WHERE x1 IS NOT NULL),
    cm AS (SELECT *, sum(s) OVER (PARTITION BY line_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS c1 FROM sz), tt AS (SELECT line_id, max(c1) AS total FROM cm GROUP BY 1)"""
_AT = "pl AS (SELECT t.line_id, t.j, t.t, arg_max(struct_pack(a := c1 - s, b := s, x0 := x0, y0 := y0, x1 := x1, y1 := y1), k) AS g FROM tg t JOIN cm ON cm.line_id = t.line_id AND c1 - s <= t.t + 1e-12 GROUP BY 1, 2, 3)"
_PLACE = "SELECT line_id, CAST(j AS INT) AS j, round(g.x0 + (g.x1 - g.x0) * (t - g.a) / g.b, 4) AS x, round(g.y0 + (g.y1 - g.y0) * (t - g.a) / g.b, 4) AS y FROM pl"


def _polylines(spark, d):
    point = lambda i: F.struct((F.get("embedding", F.lit(2 * i)).cast("double") * 100).alias("x"), (F.get("embedding", F.lit(2 * i + 1)).cast("double") * 100).alias("y"))
    return tables.load(spark, d, "embeddings").select(F.col("vec_id").alias("line_id"), F.array(*[point(i) for i in range(8)]).alias("points"))


@register(f"WITH {_POLY}, tj AS (SELECT line_id, total, unnest(range(0, CAST(ceil(total / 7) AS BIGINT))) AS j FROM tt), tg AS (SELECT line_id, j, j * 7.0e0 AS t FROM tj UNION ALL SELECT line_id, max(j) + 1, max(total) FROM tj GROUP BY 1 HAVING max(total) - max(j) * 7.0e0 > 1), {_AT} {_PLACE}")
def resampled_lines(spark, d):
    return rounded(paths.resampled(_polylines(spark, d), 7.0), "x", "y", digits=4)


@register(f"WITH {_POLY}, tj AS (SELECT line_id, total, unnest(range(0, 11)) AS j FROM tt), tg AS (SELECT line_id, j, total * j / 10 AS t FROM tj), {_AT} {_PLACE}")
def evenly_sampled_lines(spark, d):
    return rounded(paths.even_points(_polylines(spark, d), 11), "x", "y", digits=4)


@register(f"WITH {_POLY} SELECT line_id, round(CASE WHEN turned THEN b.x ELSE a.x END, 6) AS x, round(CASE WHEN turned THEN b.y ELSE a.y END, 6) AS y FROM (SELECT a.line_id, a, b, a.x > b.x OR a.x = b.x AND a.y > b.y AS turned FROM pt a JOIN pt b ON a.line_id = b.line_id AND a.k = 0 AND b.k = 7)")
def oriented_lines(spark, d):
    turned = _polylines(spark, d).select("line_id", paths.oriented(F.col("points")).alias("p"))
    return rounded(turned.select("line_id", F.get("p", F.lit(0))["x"].alias("x"), F.get("p", F.lit(0))["y"].alias("y")), "x", "y", digits=6)


@register(f"""WITH {tables.POINTS_SQL}, m AS (SELECT a.vec_id AS id, count(*) AS n, var_pop(b.x) AS vx, var_pop(b.y) AS vy, covar_pop(b.x, b.y) AS c FROM p a, p b WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 2 GROUP BY 1),
    e AS (SELECT *, (vx + vy) / 2 + sqrt(pow((vx - vy) / 2, 2) + c * c) AS l FROM m), v AS (SELECT id, n, CASE WHEN abs(c) > 1e-12 THEN l - vy WHEN vx >= vy THEN 1 ELSE 0 END AS ex, CASE WHEN abs(c) > 1e-12 THEN c WHEN vx >= vy THEN 0 ELSE 1 END AS ey FROM e)
    SELECT id, round(CASE WHEN n < 2 THEN 1 ELSE abs(ex) / sqrt(ex * ex + ey * ey) END, 5) AS tx, round(CASE WHEN n < 2 THEN 0 ELSE abs(ey) / sqrt(ex * ex + ey * ey) END, 5) AS ty FROM v""")
def point_tangents(spark, d):
    t = paths.tangents(tables.points(spark, d).select(F.col("vec_id").alias("id"), "x", "y"), 2.0)
    return rounded(t.select("id", F.abs("tx").alias("tx"), F.abs("ty").alias("ty")), "tx", "ty")


def _scored(spark, d):
    return tables.points(spark, d).select(F.col("vec_id").alias("id"), "x", "y", (F.col("vec_id") % 17 / F.lit(15.0)).alias("score"))


@register()
def suppressed_points(spark, d):
    return paths.suppressed(_scored(spark, d), 1.5)


@register()
def branch_suppressed_points(spark, d):
    return paths.branch_suppressed(_scored(spark, d), 2.0, 0.5, 2.0)


@register()
def leader_points(spark, d):
    return paths.first_leaders(tables.points(spark, d).select(F.col("vec_id").alias("id"), "x", "y"), 1.2)


@register()
def leader_lines(spark, d):
    return paths.line_groups(tables.lines(spark, d), 1.5, CELL)


_RIM = [(-3.0, -4.0), (6.0, -2.0), (4.0, 7.0), (-2.0, 5.0)]


def _meets() -> str:
    rim = [f"struct_pack(x1 := {a[0]}e0, y1 := {a[1]}e0, x2 := {b[0]}e0, y2 := {b[1]}e0)" for a, b in zip(_RIM, _RIM[1:] + _RIM[:1], strict=True)]
    return f"rm AS (SELECT unnest([{', '.join(rim)}]) AS b), tc AS (SELECT DISTINCT a.line_id FROM ln a, rm WHERE {_distance('a', 'b')} <= 0)"


# the polygon is convex: a point lies inside where it is left of every side
@register(f"WITH {_P}, {_meets()}, ins AS (SELECT line_id FROM ln a, rm GROUP BY 1 HAVING min((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) >= 0) SELECT line_id FROM tc UNION SELECT line_id FROM ins")
def lines_in_polygon(spark, d):
    return paths.in_polygon(tables.lines(spark, d), _RIM)


@register()
def split_network(spark, d):
    nodes, edges = net(spark, d, 2.0)
    return paths.split_at_nodes(nodes, edges, 0.3, CELL, 2.0)


@register()
def noded_network(spark, d):
    nodes, edges = net(spark, d, 2.0)
    return rounded(paths.noded(nodes, edges, CELL, 2.0)[0].select("x", "y"), "x", "y", digits=4)


_SPANS = f"""pr AS (SELECT a, b, {_distance()} AS distance FROM {_ONE} a, {_TWO} b), q AS (SELECT a, b, {_length('a')} AS len, {_project('b.x1', 'b.y1', 'a')} * {_length('a')} AS p1, {_project('b.x2', 'b.y2', 'a')} * {_length('a')} AS p2 FROM pr WHERE distance <= {TOL}),
    iv AS (SELECT a, b, len, least(p1, p2) AS s, greatest(p1, p2) AS e FROM q), sp AS (SELECT a.line_id, s, e FROM iv WHERE e - s > 1e-6 AND {_point_segment('(a.x1 + (s + e) / 2 / nullif(len, 0) * (a.x2 - a.x1))', '(a.y1 + (s + e) / 2 / nullif(len, 0) * (a.y2 - a.y1))', 'b')} <= {TOL})"""


@register(f"""WITH {_P}, {_SPANS}, nw AS (SELECT *, CASE WHEN s <= max(e) OVER w + 0.05e0 THEN 0 ELSE 1 END AS fresh FROM sp WINDOW w AS (PARTITION BY line_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), gr AS (SELECT *, sum(fresh) OVER (PARTITION BY line_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM nw),
    mg AS (SELECT line_id, min(s) AS s, max(e) AS e FROM gr GROUP BY line_id, g), al AS (SELECT line_id, s, e FROM mg UNION ALL SELECT a.line_id, {_length('a')}, {_length('a')} FROM {_ONE} a), gp AS (SELECT line_id, coalesce(lag(e) OVER (PARTITION BY line_id ORDER BY s, e), 0) AS start, s AS "end" FROM al)
    SELECT line_id, round(start, 6) AS start, round("end", 6) AS "end" FROM gp WHERE "end" - start >= 0.5""")
def unmatched_remainders(spark, d):
    one, two = _period(spark, d, 1), _period(spark, d, 2)
    covered = lines.intervals_on(lines.side(one, "a"), lines.side(two, "b"), TOL, CELL, united=True).withColumnRenamed("a_id", "line_id")
    return rounded(change.remainders(one, covered, 0.5), "start", "end", digits=6)


@register(f"WITH {_P}, c AS (SELECT a.line_id, a.width, {_length('a')} AS len, a FROM {_ONE} a) SELECT line_id, round(len * width, 6) AS area, round(a.x1 - (a.y2 - a.y1) / len * width / 2, 6) AS x, round(a.y1 + (a.x2 - a.x1) / len * width / 2, 6) AS y FROM c WHERE width > 0 AND len > 0")
def line_corridors(spark, d):
    c = change.corridors(_period(spark, d, 1))
    return rounded(c.select("line_id", "area", F.get("ring", F.lit(0))["x"].alias("x"), F.get("ring", F.lit(0))["y"].alias("y")), "area", "x", "y", digits=6)


@register()
def network_coverage(spark, d):
    return rounded(change.network_coverage(_period(spark, d, 1), _period(spark, d, 2), TOL, CELL), "coverage", digits=6)


@register()
def detected_changes(spark, d):
    k = F.col("line_id")
    seg = lambda p: _period(spark, d, p).select("line_id", *lines.XY, "width", F.when(k % 5 == 0, "C").otherwise("A").alias("grade"), F.lit(0.9).alias("valid"), F.lit(0.9).alias("aligned"))
    return rounded(change.detected(seg(1), seg(2), TOL, CELL, 0.5, overlap=0.5, spacing=0.5, slack=0.25), "start", "end", digits=6)


@register(f"""WITH {base._EVENTS}, ob AS (SELECT road_id, arg_max(status, period) AS last, min(period) FILTER (status = 'present') AS first_obs, max(period) FILTER (status = 'present') AS last_obs, count(*) FILTER (status = 'present') AS present_n, max(confidence) AS mx, min(confidence) AS mn, bool_or(status = 'uncertain') AS u FROM fixed GROUP BY 1),
    en AS (SELECT road_id, count(*) FILTER (event_typ <> 'uncertain') AS n, bool_or(event_typ = 'uncertain') AS r FROM events_ WHERE event_typ IS NOT NULL GROUP BY 1)
    SELECT road_id, first_obs, last_obs, CASE last WHEN 'present' THEN 'active' WHEN 'absent' THEN 'removed' ELSE 'uncertain' END AS life_state, present_n, coalesce(n, 0) AS event_n, round(mx, 6) AS max_conf, round(mn, 6) AS min_conf, CASE WHEN u OR coalesce(r, false) THEN 'review' ELSE 'auto' END AS review_st FROM ob LEFT JOIN en USING (road_id)""")
def life_rows(spark, d):
    obs = base._fixed(spark, d).withColumnRenamed("confidence", "score")
    return rounded(lifecycle.life_rows(obs, lifecycle.transitions(obs)), "max_conf", "min_conf", digits=6)


@register(f"WITH {base._EVENTS} SELECT 'EV' || lpad(CAST(row_number() OVER (ORDER BY road_id, from_per) AS VARCHAR), 8, '0') AS event_id, road_id, from_per, event_typ FROM events_ WHERE event_typ IS NOT NULL")
def numbered_events(spark, d):
    return lifecycle.numbered_events(lifecycle.transitions(base._fixed(spark, d))).select("event_id", "road_id", "from_per", "event_typ")
