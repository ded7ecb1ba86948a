"""Path lists, periods and names as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# What ends a line, and white space.
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def stripped(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WHITE}+", ""), f"{WHITE}+$", "")


def list_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_number, entry) of texts that hold one path a line: white space and byte
    order marks at the ends go, then blank lines and # comments; one layer of matched quotes
    around a line is taken off. Numbers start at 1 and count every line."""
    lines = docs.select(key, F.posexplode(F.split(text, LINE_ENDS)).alias("p", "raw"))
    bare = F.regexp_replace(stripped(F.col("raw")), r"^\uFEFF+|\uFEFF+$", "")
    quoted = bare.rlike(r"(?s)^([\"']).*\1$") & (F.length(bare) > 1)
    entry = F.when(quoted, stripped(F.substring(bare, F.lit(2), F.length(bare) - 2))).when(bare.isin('"', "'"), "").otherwise(bare)
    kept = lines.select(key, (F.col("p") + 1).cast("long").alias("line_number"), entry.alias("entry"), bare.alias("bare"))
    return kept.where("bare <> '' AND substr(bare, 1, 1) <> '#' AND entry <> ''").drop("bare")


def period_key(raw: Column, strict: bool = False) -> Column:
    """Sort key of a period: (0, day number, granularity 0 to 2, its text) of YYYY, YYYYMM,
    YYYYMMDD or YYYY-MM-DD, or (1, 0, 0, natural key) of other text. Day 1 is 0001-01-01.
    Blank text and a date that no calendar has are null; strict makes them errors."""
    raw = stripped(raw)
    digits = F.regexp_replace(raw, "-", "")
    dated = raw.rlike(r"^(\d{4}|\d{6}|\d{8}|\d{4}-\d{2}-\d{2})$")
    size = F.length(digits)
    padded = F.when(size == 4, F.concat(digits, F.lit("0101"))).when(size == 6, F.concat(digits, F.lit("01"))).otherwise(digits)
    day = F.when(F.substring(padded, 1, 4) != "0000", F.try_to_date(padded, "yyyyMMdd"))
    number = (F.date_diff(day, F.lit("0001-01-01").cast("date")) + 1).cast("int")
    made = lambda c, n, g, t: F.struct(F.lit(c).alias("class"), n.alias("ordinal"), g.alias("granularity"), t.alias("text"))
    key = made(0, number, ((size - 4) / 2).cast("int"), F.array(raw))
    other = made(1, F.lit(0), F.lit(0), natural_key(raw))
    found = F.when(dated & day.isNotNull(), key).when(~dated & (raw != ""), other)
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no period: "), F.coalesce(raw, F.lit("null")))).cast(PERIOD))


PERIOD = "struct<class int, ordinal int, granularity int, text array<string>>"


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers of any length: an array of text
    and numbers by turns, beginning with text; a number is written behind its length."""
    cut = F.regexp_replace(F.lower(name), r"(\d+)", "\u0001$1\u0001")
    bare = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    number = lambda p: F.concat(F.lpad(F.length(bare(p)).cast("string"), 10, "0"), bare(p))
    return F.transform(F.split(cut, "\u0001"), lambda p, i: F.when(i % 2 == 1, number(p)).otherwise(p))


def clean_name(name: Column) -> Column:
    """Each character but letters, digits, _ and - becomes _; those go from the ends. What
    has none left is called grid."""
    bare = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(bare == "", "grid").otherwise(bare)


def snap_id(x: Column, y: Column, tolerance: float) -> Column:
    """Id of the grid cell that a point snaps to: N and nine hex digits of SHA-1."""
    step = max(tolerance / 2, 0.1)
    at = lambda c: F.rint(c / step).cast("long").cast("string")
    return F.concat(F.lit("N"), F.upper(F.substring(F.sha1(F.concat_ws(":", at(x), at(y))), 1, 9)))


def hash_sample(rows: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """The k rows whose keys hash lowest: a sampling operator that needs no random state."""
    rank = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    return rows.withColumn("rank_hash", rank).orderBy("rank_hash", key).limit(k)
