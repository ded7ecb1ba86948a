"""Decision tables: evidence, alias normalisers, scores, bands and provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def existence(
    geometry: Column, surface: Column, valid: Column, probed: Column, mean: Column, rank: Column, background: Column, contrast: Column, p50: Column, p99: Column
) -> Column:
    """Present by geometry, probability or surface; absent only where the place was seen and
    all evidence is low; else uncertain. Returns (state, reason).

    probed: whether there is a probability raster; mean, rank and background (ranks in the
    scene), contrast and the scene's percentiles p50 and p99 are null where it has no value.
    A null geometry counts as 0, a null valid as not known."""
    made = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).alias("reason"))
    known = lambda c: F.coalesce(c, F.lit(False))
    geometry, spread, gap = F.coalesce(geometry, F.lit(0.0)), p99 - p50, rank - background
    probable = known((spread >= 0.01) & (rank >= 0.85) & (gap >= 0.10) & (contrast > 0))
    flat = known(spread < 0.01) & (F.coalesce(mean, F.lit(0.0)) <= 0.10)
    improbable = rank.isNotNull() & (flat | (known(rank <= 0.70) & known(gap.isNull() | (gap <= 0.10))))
    unseen = known(valid >= 0.90) & (geometry <= 0.10) & known(surface <= 0.10) & (improbable | ~known(probed))
    return (
        F.when(geometry >= 0.50, made("present", "geometry_match_strong"))
        .when(probable, made("present", "reference_centerline_missing_but_probability_present"))
        .when(surface >= 0.55, made("present", "reference_centerline_missing_but_surface_present"))
        .when(valid.isNull(), made("uncertain", "valid_observation_unknown"))
        .when(valid < 0.80, made("uncertain", "invalid_or_nodata_reference"))
        .when(unseen, made("absent", "true_absence_confirmed"))
        .otherwise(made("uncertain", "insufficient_negative_evidence"))
    )


def change_decision(before: Column, after: Column, before_reason: Column, after_reason: Column, requested: Column) -> Column:
    """(state, reason) of a change: automatic where one period confirms presence and the other
    absence; else a review for the first of the reasons that either period has."""
    made = lambda s, r: F.struct(F.lit(s).alias("qa_state"), F.lit(r).alias("qa_reason"))
    sure = ((requested == "added") & (before == "absent") & (after == "present")) | ((requested == "removed") & (before == "present") & (after == "absent"))
    out = F.when(sure, made("auto", "dual_period_confirmed_change"))
    for reason in REVIEW_ORDER:
        out = out.when((before_reason == reason) | (after_reason == reason), made("review", reason))
    return out.when((before == "present") & (after == "present"), made("review", "cross_sensor_extraction_disagreement")).otherwise(made("review", "geometry_mismatch_only"))


# Reasons for a review, first ones first; the rule of evidence; audit columns.
REVIEW_ORDER = (
    "invalid_or_nodata_reference", "valid_observation_unknown", "reference_centerline_missing_but_probability_present",
    "reference_centerline_missing_but_surface_present", "insufficient_negative_evidence",
)
EVIDENCE_RULE = "geometry_or_relative_probability_or_surface_present; multi_negative_valid_observation_absent"
AUDIT = {"state": "state", "geom_cov": "g", "center_evidence": "mean", "center_pct": "pct", "contrast": "contrast", "surface_cov": "s", "valid_cov": "v"}


def audit_fields(before: str, after: str) -> list[Column]:
    """The seventeen audit columns of a change, from two struct columns of evidence."""
    pairs = [F.col(f"{t}.{c}").alias(f"{side}_{name}") for name, c in AUDIT.items() for side, t in (("before", before), ("after", after))]
    known = [F.col(f"{t}.v").isNotNull().alias(f"{side}_valid_known") for side, t in (("before", before), ("after", after))]
    return [*pairs, *known, F.lit(EVIDENCE_RULE).alias("evidence_rule")]


def score_band(score: Column, veto: Column) -> Column:
    """Any veto reviews; 70 accepts, 50 accepts with medium confidence, the rest reviews."""
    return score_rule(score, veto)["band"]


def score_rule(score: Column, veto: Column) -> Column:
    """(band, decision) of a score; veto: whether there is any."""
    made = lambda b, d: F.struct(F.lit(b).alias("band"), F.lit(d).alias("decision"))
    return F.when(veto, made("hard_veto", "review")).when(score >= 70, made("auto_accept", "accept")).when(score >= 50, made("medium_confidence_auto", "accept")).otherwise(made("manual_review", "review"))


# Bonus of a line's source.
SOURCE_BONUS = {"manual": 0.5, "samroad": 0.25, "surface_skeleton": 0.0, "connector": -0.25}


def grade_score(grade: Column, center: Column, surface: Column, source: Column) -> Column:
    """3, 2 or 1 by grade (1 if unknown), a quarter of the larger confidence, a bonus by
    source (that of samroad where there is none, 0 if unknown)."""
    base = F.when(F.upper(grade) == "A", 3.0).when(F.upper(grade) == "B", 2.0).otherwise(1.0)
    confidence = F.greatest(F.coalesce(center, F.lit(0.0)), F.coalesce(surface, F.lit(0.0)))
    bonus = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_BONUS.items() for x in kv])[F.coalesce(source, F.lit("samroad"))], F.lit(0.0))
    return base + 0.25 * F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) + bonus


# Names of change classes.
ADDED = ("added", "add", "new", "new_road", "新增", "新增道路", "增加道路", "新建", "新建道路", "1", "+1")
REMOVED = ("removed", "remove", "deleted", "delete", "lost", "removed_road", "消失", "灭失", "删除", "道路灭失", "废弃", "-1")
WIDENED = ("widened", "widen", "widening", "expanded", "expansion", "width_increase", "拓宽", "变宽", "加宽", "扩宽", "宽度增加")
NARROWED = ("narrowed", "narrow", "narrowing", "contracted", "contraction", "width_decrease", "变窄", "缩窄", "收窄", "宽度减少")
WIDTH_CHANGED = ("width_changed", "width_change", "changed_width", "width", "宽度变化", "宽度改变", "宽变", "道路宽度变化")


def change_class(name: Column, classes: int = 4) -> Column:
    """Class of a change by its name; with three classes all changes of width are one, with
    four a change of width without a direction has none. Other text is null."""
    if classes not in (3, 4):
        raise ValueError("3 or 4 classes")
    plain = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))
    width = F.lit("width_changed")
    return (
        F.when(plain.isin(*ADDED), "added")
        .when(plain.isin(*REMOVED), "removed")
        .when(plain.isin(*WIDENED), width if classes == 3 else F.lit("widened"))
        .when(plain.isin(*NARROWED), width if classes == 3 else F.lit("narrowed"))
        .when(plain.isin(*WIDTH_CHANGED), width if classes == 3 else F.lit(None).cast("string"))
    )


def change_sign(code: Column) -> Column:
    """Class of a numeric code: above 0 added, below 0 removed; 0, NaN and inf are null."""
    n = code.cast("double")
    finite = ~F.isnan(n) & (F.abs(n) != float("inf"))
    return F.when(finite & (n > 0), "added").when(finite & (n < 0), "removed")


def coded_change(code: Column, classes: int = 4) -> Column:
    """Class of a coded domain: 2 added, 3 width changed (none of four classes), 4 removed.
    The code is text or a number whose fraction is dropped."""
    n = F.trim(code.cast("string")).try_cast("double")
    whole = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n))
    return F.when(whole == 2, "added").when(whole == 3, F.lit("width_changed" if classes == 3 else None)).when(whole == 4, "removed")


def safe_relative(before: Column, after: Column) -> Column:
    """(after - before) / before; null where before is null or 0."""
    return (after - before) / F.nullif(before, F.lit(0.0))


def first_valid(*values: Column, default: float = 0.0) -> Column:
    """First value that parses to a finite number, else the default."""
    number = lambda c: F.when(~F.isnan(c.try_cast("double")) & (F.abs(c.try_cast("double")) != float("inf")), c.try_cast("double"))
    return F.coalesce(*[number(c) for c in values], F.lit(default))


def support_status(share: Column, supported: float = 0.8, missing: float = 0.05) -> Column:
    """(status, confidence, review) of an edge by the share of its pixels on the surface."""
    made = lambda s, c, r: F.struct(F.lit(s).alias("status"), F.lit(c).alias("confidence"), F.lit(r).alias("review"))
    return F.when(share >= supported, made("surface_supported", "high", False)).when(share <= missing, made("surface_missing", "low", True)).otherwise(made("partial_surface", "low", True))
