"""Queries of field operators and decision tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import decision, fields
from waymark.registry import quoted, register, rounded
from waymark.sources import tables, text_lists

_RAW = ["3.5", "NaN", "abc", "", "Infinity", "-2", " 7 "]
_PICK = f"l[event_id % {len(_RAW)} + 1] AS a, l[event_id // 7 % {len(_RAW)} + 1] AS b, l[event_id // 49 % {len(_RAW)} + 1] AS c FROM (SELECT *, [{quoted(_RAW)}] AS l FROM events)"


def _picked(spark, d):
    at = lambda n: F.get(F.lit(_RAW), (F.floor(F.col("event_id") / n) % len(_RAW)).cast("int"))
    return tables.load(spark, d, "events").select("event_id", at(1).alias("a"), at(7).alias("b"), at(49).alias("c"))


def _number(c: str) -> str:
    return f"CASE WHEN isfinite(try_cast(trim({c}) AS DOUBLE)) THEN try_cast(trim({c}) AS DOUBLE) END"


@register(f"SELECT event_id, coalesce({_number('a')}, {_number('b')}, {_number('c')}, -1.0e0) AS value FROM (SELECT event_id, {_PICK})")
def first_valid_numbers(spark, d):
    return _picked(spark, d).select("event_id", decision.first_valid(F.col("a"), F.col("b"), F.col("c"), default=-1.0).alias("value"))


@register("""WITH g AS (SELECT l_orderkey, l_linenumber, upper(trim(l_returnflag)) AS a, upper(trim(' ' || lower(l_linestatus) || ' ')) AS b, CASE l_linenumber WHEN 1 THEN 'B' WHEN 2 THEN 'A' END AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN a IN ('A', 'B', 'C') THEN a WHEN b IN ('A', 'B', 'C') THEN b WHEN c IN ('A', 'B', 'C') THEN c ELSE 'C' END AS grade FROM g""")
def normalised_grades(spark, d):
    other = F.when(F.col("l_linenumber") == 1, "b ").when(F.col("l_linenumber") == 2, "A")
    status = F.concat(F.lit(" "), F.lower("l_linestatus"), F.lit(" "))
    return tables.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fields.grade(F.col("l_returnflag"), status, other).alias("grade"))


_SAID = ["Manual ", "", "other", "connector", "surface_skeleton"]
_SOURCES = ["MANUAL_x", "review_added_candidate", "auto_gap", "Connector", "surface", "a skeleton", "plain", "", "gap in surface"]


@register(f"""WITH s AS (SELECT p_partkey, lower(trim(l[p_partkey % {len(_SAID)} + 1])) AS said, CASE WHEN p_partkey % 11 > 0 THEN lower(m[p_partkey % {len(_SOURCES)} + 1]) ELSE '' END AS t FROM (SELECT *, [{quoted(_SAID)}] AS l, [{quoted(_SOURCES)}] AS m FROM part))
    SELECT p_partkey, CASE WHEN said IN ('samroad', 'surface_skeleton', 'connector', 'manual') THEN said WHEN t LIKE '%manual%' OR t LIKE '%review_added%' THEN 'manual'
        WHEN t LIKE '%connector%' OR t LIKE '%gap%' THEN 'connector' WHEN t LIKE '%surface%' OR t LIKE '%skeleton%' THEN 'surface_skeleton' ELSE 'samroad' END AS source FROM s""")
def line_sources(spark, d):
    k = F.col("p_partkey")
    said = F.get(F.lit(_SAID), (k % len(_SAID)).cast("int"))
    source = F.when(k % 11 > 0, F.get(F.lit(_SOURCES), (k % len(_SOURCES)).cast("int")))
    return tables.load(spark, d, "part").select("p_partkey", fields.line_source(said, source).alias("source"))


@register("""WITH w AS (SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN ' c ' WHEN 1 THEN 'A' END AS quality_gr FROM part)
    SELECT p_partkey, 'width_units' AS field, CAST(p_size AS DOUBLE) AS width, coalesce(upper(trim(quality_gr)) <> 'C', true) AS usable FROM w""")
def width_columns(spark, d):
    p = tables.load(spark, d, "part")
    text = F.when(F.col("p_partkey") % 2 == 0, "n/a").otherwise("0")  # has no width above 0
    rows = p.select("p_partkey", F.lit(-1.0).alias("width_map"), text.alias("width_m"), F.col("p_size").cast("double").alias("width_units"), F.when(F.col("p_size") % 3 == 0, " c ").when(F.col("p_size") % 3 == 1, "A").alias("quality_gr"))
    name = fields.field_with_values(rows)
    return rows.select("p_partkey", F.lit(name).alias("field"), F.col(name).alias("width"), fields.usable_width(rows).alias("usable"))


_NATURAL = r"""string_split(regexp_replace(lower(v), '([0-9]+)', chr(1) || '\1' || chr(1), 'g'), chr(1))"""


@register(f"""WITH n AS (SELECT doc_id, substr(source, 1, 3) || doc_id || '0.' || n_chars AS v FROM documents), p AS (SELECT doc_id, {_NATURAL} AS p FROM n),
    k AS (SELECT doc_id, CAST(p[2] AS HUGEINT) AS a, p[3] AS dot, CAST(p[4] AS HUGEINT) AS b, p[1] AS t, len(p) AS n FROM p) SELECT doc_id, rank() OVER (ORDER BY t, a, dot, b) AS place FROM k""")
def natural_order(spark, d):
    name = F.concat(F.substring("source", 1, 3), "doc_id", F.lit("0."), "n_chars")
    keyed = tables.load(spark, d, "documents").select("doc_id", text_lists.natural_key(name).alias("k"))
    return keyed.select("doc_id", F.rank().over(Window.orderBy("k")).alias("place"))


@register("""WITH s AS (SELECT vec_id, CAST(round_even(CAST(embedding[1] AS DOUBLE) * 100 / 1.5, 0) AS BIGINT) AS a, CAST(round_even(CAST(embedding[2] AS DOUBLE) * 100 / 1.5, 0) AS BIGINT) AS b FROM embeddings)
    SELECT vec_id, 'N' || upper(substr(sha1(a || ':' || b), 1, 9)) AS node FROM s""")
def snapped_ids(spark, d):
    return tables.points(spark, d).select("vec_id", text_lists.snap_id(F.col("x"), F.col("y"), 3.0).alias("node"))


@register("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_custkey || ' ' || c_name || ' ' || c_mktsegment), '7 build')")
def filtered_rows(spark, d):
    rows = tables.load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name").select("c_custkey", "c_name", "c_mktsegment")
    return fields.text_filter(rows, " 7 BUILD ")


_HARMLESS = r"TIFFReadDirectory|unknown field with tag [0-9]+"


@register(f"""WITH l AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'TIFFReadDirectory: x' WHEN 1 THEN 'has unknown field with tag ' || event_id WHEN 2 THEN 'done ' || event_type ELSE 'tag ' || event_id END AS line FROM events)
    SELECT event_id, line FROM l WHERE NOT regexp_matches(line, '{_HARMLESS}')""")
def visible_log(spark, d):
    k, end = F.col("event_id"), F.lit("\r\n")
    line = F.when(k % 4 == 0, "TIFFReadDirectory: x").when(k % 4 == 1, F.concat(F.lit("has unknown field with tag "), k)).when(k % 4 == 2, F.concat(F.lit("done "), "event_type", end)).otherwise(F.concat(F.lit("tag "), k))
    return fields.shown_lines(tables.load(spark, d, "events").select("event_id", line.alias("line")), "line", _HARMLESS)


@register("""SELECT o_orderkey, s NOT IN ('stale', 'failed', 'running') AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS period_ready, s NOT IN ('stale', 'failed', 'running') AND o_orderkey % 3 <> 0 AS change_ready
    FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'stale' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' WHEN 3 THEN '' ELSE 'complete' END AS s FROM orders)""")
def ready_results(spark, d):
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, "Stale").when(k % 7 == 1, "FAILED").when(k % 7 == 2, "running").when(k % 7 > 3, "complete")
    summary, gpkg = k % 3 != 0, F.when(k % 5 != 0, F.lit(True))
    return tables.load(spark, d, "orders").select("o_orderkey", fields.ready(status, summary, gpkg).alias("period_ready"), fields.ready(status, summary).alias("change_ready"))


@register("""WITH p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), e AS (SELECT user_id, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before, day AS after FROM p),
    x AS (SELECT user_id, before, after FROM e WHERE before IS NOT NULL), g AS (SELECT user_id, before, after FROM x WHERE user_id % 4 <> 1 UNION ALL SELECT user_id, before, after FROM x WHERE user_id % 6 = 0 UNION ALL SELECT user_id, after, before FROM x WHERE user_id % 5 = 0),
    c AS (SELECT user_id, before, after, count(*) AS n FROM g GROUP BY ALL)
    SELECT user_id, before, after, 'duplicate' AS fault FROM c WHERE n > 1 UNION ALL SELECT user_id, before, after, 'unexpected' FROM c ANTI JOIN x USING (user_id, before, after) UNION ALL SELECT user_id, before, after, 'missing' FROM x ANTI JOIN c USING (user_id, before, after)""")
def adjacent_key_faults(spark, d):
    days = tables.load(spark, d, "events").select("user_id", F.to_date("ts").alias("after")).distinct()
    expected = days.withColumn("before", F.lag("after").over(Window.partitionBy("user_id").orderBy("after"))).where("before IS NOT NULL").select("user_id", "before", "after")
    swapped = expected.where("user_id % 5 = 0").select("user_id", F.col("after").alias("before"), F.col("before").alias("after"))
    given = expected.where("user_id % 4 <> 1").unionByName(expected.where("user_id % 6 = 0")).unionByName(swapped)
    return fields.key_faults(given, expected, ["user_id", "before", "after"])


_VETOES = [*fields.UNSAFE_ATTACHMENTS, "short", "crosses_tile"]


@register(f"""WITH v AS (SELECT p_partkey, [x FOR x, i IN [{quoted(_VETOES)}] IF (p_partkey * i) % 3 = 0] AS r FROM part)
    SELECT p_partkey, array_to_string(list_sort([x FOR x IN r IF x IN ({quoted(fields.UNSAFE_ATTACHMENTS)})]), ',') AS vetoes FROM v""")
def attachment_vetoes(spark, d):
    every = F.lit(_VETOES)
    some = F.filter(every, lambda x, i: (F.col("p_partkey") * (i + 1)) % 3 == 0)
    return tables.load(spark, d, "part").select("p_partkey", F.array_join(fields.attachment_vetoes(some), ",").alias("vetoes"))


@register("""WITH e AS (SELECT p_partkey AS k, (p_partkey % 11) / 10.0e0 AS m, (p_partkey % 7) / 10.0e0 AS q, (p_partkey % 13) / 12.0e0 AS w, (p_partkey % 5) / 20.0e0 AS c FROM part)
    SELECT k, CASE WHEN m < 0.3 THEN 'mean_probability_low' WHEN q < 0.2 THEN 'q25_probability_low' WHEN w < 0.5 THEN 'weak_fraction_low' WHEN c < 0.1 THEN 'background_contrast_low' ELSE 'insufficient_independent_support' END AS reason FROM e""")
def evidence_rejections(spark, d):
    k = F.col("p_partkey")
    values = [k % 11 / F.lit(10.0), k % 7 / F.lit(10.0), k % 13 / F.lit(12.0), k % 5 / F.lit(20.0)]
    return tables.load(spark, d, "part").select(k.alias("k"), fields.first_failed(*values, {"mean": 0.3, "q25": 0.2, "weak": 0.5, "contrast": 0.1}).alias("reason"))


@register("""WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_size ELSE 0 END AS q, CASE p_partkey % 4 WHEN 1 THEN p_size / 10.0e0 ELSE 0 END AS a, CASE p_partkey % 4 WHEN 1 THEN p_size / 5.0e0 WHEN 2 THEN 3.0e0 ELSE 0 END AS e, CASE p_partkey % 8 WHEN 1 THEN 2.0e0 ELSE 0 END AS b FROM part),
    h AS (SELECT *, sqrt(b * b + e * e) AS r, sqrt(a * a) AS c FROM t)
    SELECT k, round(CASE WHEN q > 0 THEN q WHEN r > 0 AND c > 0 THEN (r + c) / 2 WHEN r > 0 THEN r WHEN c > 0 THEN c ELSE 1.0 END, 6) AS size, CASE WHEN q > 0 THEN 'argument' WHEN r > 0 OR c > 0 THEN 'raster_transform_mean' ELSE 'fallback_1' END AS source FROM h""")
def pixel_sizes(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    zero = F.lit(0.0)
    q = F.when(k % 4 == 0, size.cast("double")).otherwise(zero)
    a, e = F.when(k % 4 == 1, size / 10.0).otherwise(zero), F.when(k % 4 == 1, size / 5.0).when(k % 4 == 2, 3.0).otherwise(zero)
    b = F.when(k % 8 == 1, 2.0).otherwise(zero)
    out = tables.load(spark, d, "part").select(k.alias("k"), fields.pixel_size(q, a, b, zero, e).alias("x")).select("k", "x.size", "x.source")
    return rounded(out, "size", digits=6)


@register("""WITH e AS (SELECT p_partkey AS edge_id, CASE p_partkey % 5 WHEN 0 THEN 'auto_added_gap' WHEN 1 THEN 'auto_added_surface' WHEN 2 THEN 'review_added_candidate' WHEN 3 THEN 'samroad' END AS source, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'f' || (p_partkey % 50) END AS f, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS c FROM part),
    g AS (SELECT edge_id, source, coalesce(nullif(f, ''), nullif(c, '')) AS key FROM e) SELECT source || ':' || key AS path, count(*) AS edges, min(edge_id) AS first FROM g WHERE source IN ('auto_added_gap', 'auto_added_surface', 'review_added_candidate') AND key IS NOT NULL GROUP BY 1""")
def supplemental_paths(spark, d):
    k = F.col("p_partkey")
    source = F.when(k % 5 == 0, "auto_added_gap").when(k % 5 == 1, "auto_added_surface").when(k % 5 == 2, "review_added_candidate").when(k % 5 == 3, "samroad")
    feature = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("f"), k % 50))
    rows = tables.load(spark, d, "part").select(k.alias("edge_id"), source.alias("source"), feature.alias("line_feature_id"), F.when(k % 4 > 0, F.col("p_size").cast("string")).otherwise("").alias("candidate_id"))
    return fields.path_groups(rows).groupBy("path").agg(F.count("*").alias("edges"), F.min("edge_id").alias("first"))


@register("""WITH m AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'Unmatched' WHEN 2 THEN 'one_to_one' END AS relation, CASE WHEN l_partkey % 9 > 0 THEN l_partkey END AS b, l_quantity - 5 AS w FROM lineitem)
    SELECT l_orderkey, l_linenumber FROM m WHERE lower(coalesce(relation, '')) <> 'unmatched' AND b IS NOT NULL AND w > 0""")
def formal_matches(spark, d):
    n = F.col("l_linenumber")
    rows = tables.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 1, "Unmatched").when(n == 2, "one_to_one").alias("relation"), F.when(F.col("l_partkey") % 9 > 0, F.col("l_partkey")).alias("before_segment"), (F.col("l_quantity") - 5).alias("after_w"))
    return fields.matched_widths(rows).select("l_orderkey", "l_linenumber")


@register("SELECT c_custkey, CASE WHEN c_acctbal IS NOT NULL AND b <> 0 THEN round((c_acctbal - b) / b, 9) END AS change FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey - 3 END AS b FROM customer)")
def relative_differences(spark, d):
    before = F.when(F.col("c_custkey") % 5 > 0, (F.col("c_nationkey") - 3).cast("double"))
    return rounded(tables.load(spark, d, "customer").select("c_custkey", decision.safe_relative(before, F.col("c_acctbal")).alias("change")), "change", digits=9)


@register("SELECT p_partkey, CASE WHEN s >= 0.8 THEN 'surface_supported' WHEN s <= 0.05 THEN 'surface_missing' ELSE 'partial_surface' END AS status, CASE WHEN s >= 0.8 THEN 'high' ELSE 'low' END AS confidence, s < 0.8 AS review FROM (SELECT p_partkey, (p_partkey % 21) / 20.0e0 AS s FROM part)")
def support_statuses(spark, d):
    state = decision.support_status(F.col("p_partkey") % 21 / F.lit(20.0))
    return tables.load(spark, d, "part").select("p_partkey", state.alias("x")).select("p_partkey", "x.*")
