"""Fields of records: normalisers, choice of columns by name and by data, rules, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.sources.text_lists import stripped

# Line sources, and fields by their many names.
LINE_SOURCES = ("samroad", "surface_skeleton", "connector", "manual")
WIDTH_FIELDS = ("width_map", "width_m", "width_units", "final_width", "width")
TRUTH_TYPE_FIELDS = ("BHBM", "bhbm", "change_typ", "change_type", "change", "type", "class", "label", "变化类型", "变化", "类别")
SUPPLEMENTAL_SOURCES = ("auto_added_gap", "auto_added_surface", "review_added_candidate")
UNSAFE_ATTACHMENTS = ("duplicate_or_near_parallel", "protected_divided_carriageway", "short_loop", "dense_branching_or_blocky", "invalid_endpoint_connection")
NOT_READY = ("stale", "failed", "running")


def grade(*fields: Column) -> Column:
    """The first field that reads A, B or C, whatever its case and blanks; else C."""
    each = [F.upper(stripped(c)) for c in fields]
    return F.coalesce(*[F.when(c.isin("A", "B", "C"), c) for c in each], F.lit("C"))


def line_source(explicit: Column, source: Column) -> Column:
    """A known explicit source, else one by words in the other field, else samroad."""
    said, text = F.lower(stripped(F.coalesce(explicit, F.lit("")))), F.lower(stripped(F.coalesce(source, F.lit(""))))
    return (
        F.when(said.isin(*LINE_SOURCES), said)
        .when(text.contains("manual") | text.contains("review_added"), "manual")
        .when(text.contains("connector") | text.contains("gap"), "connector")
        .when(text.contains("surface") | text.contains("skeleton"), "surface_skeleton")
        .otherwise("samroad")
    )


def field_with_values(rows: DataFrame, names: tuple[str, ...] = WIDTH_FIELDS) -> str | None:
    """The first of the named columns that has any value above 0: one pass over all rows."""
    there = [n for n in names if n in rows.columns]
    if not there:
        return None
    found = rows.agg(*[F.max((F.col(n).cast("string").try_cast("double") > 0).cast("int")).alias(n) for n in there]).first()
    return next((n for n in there if found[n]), None)


def field_or_zero(rows: DataFrame, names: tuple[str, ...] = WIDTH_FIELDS, name: str = "_width_zero") -> tuple[DataFrame, str]:
    """rows and the first of the named columns that they have; else with a column of 0."""
    found = first_field(rows, names)
    return (rows, found) if found else (rows.withColumn(name, F.lit(0.0)), name)


def first_field(rows: DataFrame, names: tuple[str, ...] = TRUTH_TYPE_FIELDS, requested: str | None = None) -> str | None:
    """The requested column (an error if there is none), else the first of the names."""
    if requested:
        if requested not in rows.columns:
            raise ValueError(f"no column {requested}")
        return requested
    return next((n for n in names if n in rows.columns), None)


def usable_width(rows: DataFrame, exclude_low: bool = True) -> Column:
    """False where a field of quality that rows have reads C."""
    there = [n for n in ("quality_gr", "quality_grade") if n in rows.columns]
    if not exclude_low or not there:
        return F.lit(True)
    low = [F.coalesce(F.upper(stripped(F.col(n))) == "C", F.lit(False)) for n in there]
    return ~F.greatest(*low) if len(low) > 1 else ~low[0]


def short_names(prefix: str, periods: list[str], used: set[str]) -> dict[str, str]:
    """A column name of at most ten characters for each period: the end of prefix and the
    period's letters and digits in upper case; a number replaces the end of a taken one.
    Case doesn't make names differ. `used` gets the new ones."""
    out = {}
    for period in periods:
        base = (prefix + ("".join(c for c in period if c.isalnum()).upper() or "P"))[-10:]
        name, n = base, 0
        while name.casefold() in used:
            n += 1
            name = base[: 10 - len(str(n))] + str(n)
        used.add(name.casefold())
        out[period] = name
    return out


def text_filter(rows: DataFrame, needle: str) -> DataFrame:
    """Rows whose values, joined by blanks, hold the needle, whatever its case; a blank
    needle keeps all. Nulls read as nothing."""
    plain = needle.strip().lower()
    if not plain:
        return rows
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    return rows.where(F.contains(F.lower(text), F.lit(plain)))


def shown_lines(lines: DataFrame, column: str, harmless: str) -> DataFrame:
    """Lines without their ends, but those that the pattern calls harmless. The table itself
    keeps every line: write it to the log, and this beside it."""
    bare = F.regexp_replace(F.col(column), r"[\r\n]+$", "")
    return lines.withColumn(column, bare).where(~F.col(column).rlike(harmless))


def ready(status: Column, *files: Column) -> Column:
    """Whether a result can be resumed from: its status says so and all its files exist."""
    good = ~F.lower(F.coalesce(status, F.lit(""))).isin(*NOT_READY)
    for f in files:
        good = good & F.coalesce(f, F.lit(False))
    return good


def thresholds(config: dict, profile: str | None = None) -> tuple[float, float, str]:
    """High and low threshold and the profile's name: the profile's own, in either case, else
    the configuration's, else that of older ones. 0 <= low < high <= 1 must hold."""
    name = str(config.get("ROAD_THRESHOLD_PROFILE", "default") if profile is None else profile)
    if name == "auto":
        raise ValueError("auto must be resolved to a profile first")
    own = (config.get("ROAD_THRESHOLD_PROFILES") or {}).get(name, {})

    def of(key: str, fallback: float) -> float:
        return float(own.get(key, own.get(key.lower(), config.get(key, fallback))))

    high = of("ROAD_HIGH_THRESHOLD", float(config.get("ROAD_THRESHOLD", 0.364)))
    low = of("ROAD_LOW_THRESHOLD", min(0.20, 0.65 * high))
    if not 0.0 <= low < high <= 1.0:
        raise ValueError(f"thresholds must satisfy 0 <= low < high <= 1: {low}, {high}")
    return high, low, name


def attachment_vetoes(reasons: Column) -> Column:
    """Of a list of vetoes those that make an attachment unsafe, sorted; repeats stay."""
    unsafe = F.array(*[F.lit(x) for x in UNSAFE_ATTACHMENTS])
    return F.array_sort(F.filter(reasons, lambda x: F.array_contains(unsafe, x)))


def first_failed(mean: Column, q25: Column, weak: Column, contrast: Column, least: dict[str, float]) -> Column:
    """The first rule of road evidence that fails."""
    return (
        F.when(mean < least["mean"], "mean_probability_low")
        .when(q25 < least["q25"], "q25_probability_low")
        .when(weak < least["weak"], "weak_fraction_low")
        .when(contrast < least["contrast"], "background_contrast_low")
        .otherwise("insufficient_independent_support")
    )


def pixel_size(requested: Column, a: Column, b: Column, d: Column, e: Column) -> Column:
    """Pixel size and where it comes from: the request, else the mean of the positive sizes of
    an affine transform's columns (a, d) and rows (b, e), else 1."""
    sizes = F.filter(F.array(F.hypot(b, e), F.hypot(a, d)), lambda x: x > 0)
    mean = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x) / F.size(sizes)
    made = lambda v, s: F.struct(v.cast("double").alias("size"), F.lit(s).alias("source"))
    return F.when(requested > 0, made(requested, "argument")).when(F.size(sizes) > 0, made(mean, "raster_transform_mean")).otherwise(made(F.lit(1.0), "fallback_1"))


def path_groups(edges: DataFrame) -> DataFrame:
    """(path, edge_id) of edges (edge_id, source, line_feature_id, candidate_id) that were
    added as part of one line: of three sources, with a feature's id or else a candidate's."""
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    key = F.coalesce(text("line_feature_id"), text("candidate_id"))
    return edges.where(F.col("source").isin(*SUPPLEMENTAL_SOURCES) & key.isNotNull()).select(F.concat_ws(":", "source", key).alias("path"), "edge_id")


def matched_widths(matches: DataFrame) -> DataFrame:
    """Matches that are formal: related, both ids there, both widths above 0. A test whose
    column is missing (under either of its names) is passed over."""
    there = lambda *names: next((n for n in names if n in matches.columns), None)
    keep = F.lit(True)
    if c := there("relation"):
        keep = keep & (F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "unmatched")
    for names in (("before_seg", "before_segment"), ("after_seg", "after_segment")):
        if c := there(*names):
            keep = keep & F.col(c).isNotNull()
    for names in (("before_w", "before_width"), ("after_w", "after_width")):
        if c := there(*names):
            keep = keep & (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0)
    return matches.where(keep)


def key_faults(given: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are given twice, given but not expected, or expected but not given, with
    the fault; both tables are grouped by the keys, so a repeated one can't multiply rows."""
    g = given.groupBy(*keys).agg(F.count("*").alias("n"))
    e = expected.select(*keys).distinct().withColumn("wanted", F.lit(True))
    faults = F.filter(
        F.array(F.when(F.col("n") > 1, "duplicate"), F.when(F.col("n").isNotNull() & F.col("wanted").isNull(), "unexpected"), F.when(F.col("n").isNull(), "missing")),
        lambda x: x.isNotNull(),
    )
    return g.join(e, keys, "full").select(*keys, F.explode(faults).alias("fault"))

