"""Queries of network operators, on the graph of points that lie within 1 of each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import graph, match, network
from waymark.registry import register, rounded
from waymark.sources import tables

_NEAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_G = f"{tables.POINTS_SQL}, g AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_NEAR} AS length FROM p a, p b WHERE a.vec_id < b.vec_id AND {_NEAR} <= 1)"
_E = f"{_G}, e2 AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g), dg AS (SELECT src AS node, count(*) AS degree FROM e2 GROUP BY 1)"
_REC = lambda q: q.replace("p AS", "RECURSIVE p AS", 1)
_PARTS = "reach AS (SELECT vec_id AS node, vec_id AS seen FROM p UNION SELECT r.node, e2.dst FROM reach r JOIN e2 ON r.seen = e2.src), parts AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)"


def net(spark, d, within: float = 1.0):
    p = tables.points(spark, d)
    a = p.select(F.col("vec_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.select(F.col("vec_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    edges = graph.undirected(match.pairs_within(a, b, within).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")))
    return p.select(F.col("vec_id").alias("node"), "x", "y"), edges


@register(f"WITH {_E}, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM dg) SELECT a.id AS src, b.id AS dst FROM g JOIN n a ON a.node = src JOIN n b ON b.node = dst")
def compacted_edges(spark, d):
    nodes, edges = net(spark, d)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    return network.compact(nodes, both)[1]


@register(f"WITH {_E}, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM dg) SELECT id AS node, round(x, 6) AS x, round(y, 6) AS y FROM n JOIN p ON vec_id = node")
def compacted_nodes(spark, d):
    return rounded(network.compact(*net(spark, d))[0], "x", "y", digits=6)


@register(f"WITH {_G}, n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS id FROM p WHERE x >= 0 AND x < 12 AND y >= 0 AND y < 15) SELECT a.id AS src, b.id AS dst, round(length, 6) AS score FROM g JOIN n a ON a.vec_id = src JOIN n b ON b.vec_id = dst")
def edges_in_bounds(spark, d):
    nodes, edges = net(spark, d)
    scored = network.placed(nodes, edges).select("src", "dst", F.col("length").alias("score"))
    return rounded(network.inside(nodes, scored, 15.0, 12.0)[1], "score", digits=6)


@register(f"WITH {_E} SELECT src AS node, array_to_string(list_sort(list(DISTINCT dst)), ',') AS near FROM e2 GROUP BY 1")
def adjacency_lists(spark, d):
    return network.neighbours(net(spark, d)[1]).select("node", F.array_join("near", ",").alias("near"))


@register(f"WITH {_E} SELECT src, dst FROM e2")
def edges_of_adjacency(spark, d):
    return network.edges_of(network.neighbours(net(spark, d)[1]))


@register(f"WITH {_G}, dir AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g WHERE (src + dst) % 3 > 0) SELECT (SELECT count(*) FROM dir a WHERE NOT EXISTS (SELECT 1 FROM dir b WHERE b.src = a.dst AND b.dst = a.src)) AS one_way, (SELECT count(*) FROM p a, p b WHERE a.vec_id < b.vec_id AND {_NEAR} < 0.4) AS near_duplicates")
def graph_lint(spark, d):
    nodes, edges = net(spark, d)
    back = edges.where((F.col("src") + F.col("dst")) % 3 > 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return network.lint(nodes, edges.unionByName(back), 0.4)


@register(f"WITH {_G} SELECT src, dst, round(length, 6) AS length FROM g")
def edge_lengths(spark, d):
    return rounded(network.placed(*net(spark, d)).select("src", "dst", "length"), "length", digits=6)


_ENDS = f"{_E}, ends AS (SELECT node, a.x, a.y, (a.x - b.x) / {_NEAR} AS ux, (a.y - b.y) / {_NEAR} AS uy FROM dg JOIN e2 ON src = node JOIN p a ON a.vec_id = node JOIN p b ON b.vec_id = dst WHERE degree = 1 AND {_NEAR} > 0)"
_PAIRS = f"{_ENDS}, ep AS (SELECT a.node AS a_id, b.node AS b_id, {_NEAR} AS n, a.ux AS au, a.uy AS av, b.ux AS bu, b.uy AS bv, b.x - a.x AS dx, b.y - a.y AS dy FROM ends a JOIN ends b ON a.node < b.node)"


@register(f"WITH {_ENDS} SELECT node, round(ux, 6) AS ux, round(uy, 6) AS uy FROM ends")
def outward_ends(spark, d):
    return rounded(network.outward(*net(spark, d)).select("node", "ux", "uy"), "ux", "uy", digits=6)


@register(f"WITH {_PAIRS} SELECT a_id, b_id, round(CASE WHEN n > 0 THEN least(au * dx / n + av * dy / n, -(bu * dx / n + bv * dy / n)) ELSE -1 END, 6) AS alignment FROM ep WHERE n <= 6")
def end_alignments(spark, d):
    return rounded(network.end_pairs(network.outward(*net(spark, d)), 6.0).select("a_id", "b_id", "alignment"), "alignment", digits=6)


@register(f"WITH {_PAIRS}, q AS (SELECT * FROM ep WHERE n BETWEEN 0.5 AND 12 AND au * bu + av * bv >= 0.8 AND greatest(abs(dx / n * au + dy / n * av), abs(dx / n * bu + dy / n * bv)) <= 0.7) SELECT a_id AS node FROM q UNION SELECT b_id FROM q")
def divided_road_ends(spark, d):
    return network.divided_ends(*net(spark, d), least=0.5, most=12.0, parallel=0.8, lateral=0.7)


@register(f"WITH {_G} SELECT src, dst FROM g WHERE NOT ((src + dst) % 5 = 0)")
def deleted_edges(spark, d):
    edges = net(spark, d)[1]
    gone = edges.where((F.col("src") + F.col("dst")) % 5 == 0).unionByName(edges.select((-F.col("src") - 1).alias("src"), F.col("dst")))
    return network.delete_edges(edges, gone, ["src", "dst"])


@register(f"WITH {_G}, m AS (SELECT CASE WHEN src % 7 = 3 THEN src - 3 ELSE src END AS a, CASE WHEN dst % 7 = 3 THEN dst - 3 ELSE dst END AS b FROM g) SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM m WHERE a <> b")
def merged_nodes(spark, d):
    nodes, edges = net(spark, d)
    return network.merge_nodes(edges, nodes.where("node % 7 = 3").select(F.col("node").alias("source"), (F.col("node") - 3).alias("target")))


@register(f"WITH {_G}, s AS (SELECT src, dst, 1000000 + src * 1000 + dst AS n FROM g WHERE (src + dst) % 4 = 0) SELECT src, dst FROM g ANTI JOIN s USING (src, dst) UNION ALL SELECT src, n FROM s UNION ALL SELECT n, dst FROM s")
def split_edges(spark, d):
    nodes, edges = net(spark, d)
    lines = network.placed(nodes, edges).where((F.col("src") + F.col("dst")) % 4 == 0)
    new = F.lit(1_000_000).cast("long") + F.col("src") * 1000 + F.col("dst")
    splits = lines.select("src", "dst", new.alias("node"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return network.split_edges(nodes, edges, splits)[1]


_CLOSE = _REC(f"{tables.POINTS_SQL}, c AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM p a, p b WHERE a.vec_id <> b.vec_id AND {_NEAR} <= 0.6), reach AS (SELECT vec_id AS node, vec_id AS seen FROM p UNION SELECT r.node, c.dst FROM reach r JOIN c ON r.seen = c.src), parts AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)")


@register(f"WITH {_CLOSE} SELECT component AS node, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS size FROM parts JOIN p ON vec_id = node GROUP BY 1")
def merged_close_nodes(spark, d):
    return rounded(network.merge_close(*net(spark, d), 0.6)[0], "x", "y", digits=6)


@register(f"WITH {_CLOSE}, g AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM p a, p b WHERE a.vec_id < b.vec_id AND {_NEAR} <= 1), m AS (SELECT a.component AS a, b.component AS b FROM g JOIN parts a ON a.node = src JOIN parts b ON b.node = dst) SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM m WHERE a <> b")
def merged_close_edges(spark, d):
    return network.merge_close(*net(spark, d), 0.6)[1]


@register(f"WITH {_G}, n AS (SELECT g.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, greatest(1, CAST(floor(length / 0.3) AS INT)) AS n FROM g JOIN p a ON a.vec_id = src JOIN p b ON b.vec_id = dst), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n) SELECT src, dst, CAST(k AS INT) AS k, round(x1 + k / CAST(n AS DOUBLE) * (x2 - x1), 6) AS x, round(y1 + k / CAST(n AS DOUBLE) * (y2 - y1), 6) AS y FROM k")
def subdivided_edges(spark, d):
    return rounded(network.subdivided(*net(spark, d), 0.3), "x", "y", digits=6)


@register(f"WITH {_REC(_E)}, r AS (SELECT vec_id AS start, vec_id AS node, 0 AS depth FROM p UNION SELECT start, dst, depth + 1 FROM r JOIN e2 ON src = node WHERE depth < 4 AND node % 13 <> 0) SELECT start, node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1, 2")
def bounded_reach(spark, d):
    nodes, edges = net(spark, d)
    return network.reach(edges, nodes, nodes.where("node % 13 = 0"), 4, nodes, 1.0)


_CHAINS = f"""{_REC(_E)}, named AS (SELECT src, dst, length, lpad(CAST(src AS VARCHAR), 12, '0') || '-' || lpad(CAST(dst AS VARCHAR), 12, '0') AS name FROM g),
    tip AS (SELECT name, src AS node FROM named UNION ALL SELECT name, dst FROM named), link AS (SELECT a.name AS a, b.name AS b FROM tip a JOIN tip b ON a.node = b.node AND a.name <> b.name JOIN dg ON dg.node = a.node AND degree = 2),
    cr AS (SELECT name, name AS seen FROM named UNION SELECT cr.name, link.b FROM cr JOIN link ON cr.seen = link.a), cc AS (SELECT name, min(seen) AS chain FROM cr GROUP BY 1)"""


@register(f"WITH {_CHAINS} SELECT chain, src, dst FROM named JOIN cc USING (name)")
def chain_edges(spark, d):
    return network.chains(*net(spark, d))[0].select("chain", "src", "dst")


@register(f"""WITH {_CHAINS}, t AS (SELECT chain, min(struct_pack(x := x, y := y, node := dg.node, degree := degree)) AS s, max(struct_pack(x := x, y := y, node := dg.node, degree := degree)) AS e FROM tip JOIN cc USING (name) JOIN dg ON dg.node = tip.node JOIN p ON vec_id = dg.node WHERE degree <> 2 GROUP BY 1)
    SELECT c.chain, c.edges, c.length, coalesce(s.node, c.first) AS start, coalesce(e.node, c.first) AS "end", coalesce(s.degree, 2) AS start_degree, coalesce(e.degree, 2) AS end_degree
    FROM (SELECT chain, count(*) AS edges, round(sum(length), 6) AS length, arg_min(src, name) AS first FROM named JOIN cc USING (name) GROUP BY 1) c LEFT JOIN t ON t.chain = c.chain""")
def chain_table(spark, d):
    return rounded(network.chains(*net(spark, d))[1], "length", digits=6)


_BRIDGES = "cut AS (SELECT src AS a, dst AS b, src AS node FROM g UNION SELECT a, b, e2.dst FROM cut JOIN e2 ON e2.src = node WHERE NOT (e2.src = a AND e2.dst = b) AND NOT (e2.src = b AND e2.dst = a)), parting AS (SELECT src, dst FROM g ANTI JOIN (SELECT a AS src, b AS dst FROM cut WHERE node = b) USING (src, dst))"


@register(f"WITH {_REC(_E)}, {_BRIDGES} SELECT src, dst FROM parting")
def bridge_edges(spark, d):
    return network.bridges(net(spark, d)[1])


@register(f"""WITH {_REC(_E)}, l AS (SELECT src AS here, dst AS there, length FROM g UNION ALL SELECT dst, src, length FROM g), w AS (SELECT src, dst, src AS here, CAST(0 AS DOUBLE) AS way, [src] AS seen FROM g
    UNION ALL SELECT src, dst, there, way + length, list_append(seen, there) FROM w JOIN l ON l.here = w.here WHERE NOT (w.here = src AND there = dst) AND NOT (w.here = dst AND there = src) AND way + length <= 1.6 AND NOT list_contains(seen, there) AND w.here <> dst)
    SELECT src, dst, round(min(way), 6) AS detour FROM w WHERE here = dst GROUP BY 1, 2""")
def edge_detours(spark, d):
    return rounded(network.detours(*net(spark, d), 1.6), "detour", digits=6)


@register(f"""WITH {_REC(_E)}, {_PARTS}, {_BRIDGES}, sizes AS (SELECT component, count(*) AS n FROM parts GROUP BY 1), top AS (SELECT component, n FROM sizes ORDER BY n DESC, component LIMIT 1)
    SELECT (SELECT count(*) FROM sizes) AS components, (SELECT CAST(sum(n) AS BIGINT) FROM sizes) AS nodes, (SELECT n FROM top) AS largest_nodes, (SELECT count(*) FROM g JOIN parts ON node = src WHERE component = (SELECT component FROM top)) AS largest_edges,
        round((SELECT n FROM top) / CAST((SELECT count(*) FROM p) AS DOUBLE), 9) AS largest_share, (SELECT count(*) FROM dg WHERE degree = 1) AS ends, (SELECT count(*) FROM p WHERE vec_id NOT IN (SELECT node FROM dg)) AS isolated, (SELECT count(*) FROM dg WHERE degree >= 3) AS junctions,
        (SELECT count(*) FROM g) AS edges, (SELECT count(*) FROM g WHERE length < 0.5) AS short_edges, (SELECT count(*) FROM parting) AS bridges""")
def network_statistics(spark, d):
    return rounded(network.statistics(*net(spark, d), 0.5), "largest_share", digits=9)


_LINES = f"{tables.POINTS_SQL}, ln AS (SELECT vec_id AS line_id, x AS x1, y AS y1, x + CAST(embedding[3] AS DOUBLE) * 20 AS x2, y + CAST(embedding[4] AS DOUBLE) * 20 AS y2 FROM p JOIN embeddings USING (vec_id)), le AS (SELECT line_id, 1 AS e, x1 AS x, y1 AS y FROM ln UNION ALL SELECT line_id, 2, x2, y2 FROM ln)"


@register(f"WITH {_LINES}, n AS (SELECT a.line_id, a.e, count(*) AS n FROM le a, le b WHERE {_NEAR} <= 0.75 GROUP BY 1, 2) SELECT line_id, max(n) FILTER (e = 1) AS start_degree, max(n) FILTER (e = 2) AS end_degree FROM n GROUP BY 1")
def snapped_end_degrees(spark, d):
    return network.snap_degrees(tables.lines(spark, d), 3.0)


@register(f"WITH {_LINES} SELECT a.line_id AS a_line, b.line_id AS b_line, a.e AS a_end, b.e AS b_end FROM le a, le b WHERE a.line_id <> b.line_id AND {_NEAR} < 0.5")
def touching_lines(spark, d):
    return network.touching(tables.lines(spark, d), 0.5)
