"""Results as files: fixed schemas, products by class, CSV, JSON, event logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.reports import combined

# Column names of at most ten characters for the audit of changes.
SHORT_NAMES = {
    "audit_reason": "audit_reas", "before_state": "bef_state", "after_state": "aft_state", "before_geom_cov": "bef_gcov", "after_geom_cov": "aft_gcov",
    "before_center_evidence": "bef_cmean", "after_center_evidence": "aft_cmean", "before_center_pct": "bef_cpct", "after_center_pct": "aft_cpct",
    "before_contrast": "bef_ctrst", "after_contrast": "aft_ctrst", "before_surface_cov": "bef_scov", "after_surface_cov": "aft_scov",
    "before_valid_cov": "bef_vcov", "after_valid_cov": "aft_vcov", "evidence_rule": "evid_rule",
}


def shaped(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with just the named columns of the named types, in order; a missing one is empty
    text or NaN."""
    blank = lambda kind: F.lit("") if kind == "string" else F.lit(float("nan")) if kind in ("double", "float") else F.lit(None)
    return rows.select(*[(F.col(c) if c in rows.columns else blank(k)).cast(k).alias(c) for c, k in columns.items()])


def write_shaped(rows: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Writes Parquet of a fixed schema; no rows still give a table that can be read."""
    shaped(rows, columns).write.mode("overwrite").parquet(path)


def write_changes(added: DataFrame, removed: DataFrame, path: str) -> DataFrame:
    """Writes all changes as one table in folders by state and type (a layer is a filter on
    folders), short column names; returns it. A missing state is auto, a missing reason empty."""
    rows = combined(added, removed)
    rows = rows if "audit_reason" in rows.columns else rows.withColumn("audit_reason", F.lit(""))
    rows = rows.withColumn("audit_reason", F.coalesce("audit_reason", F.lit(""))).withColumnsRenamed(SHORT_NAMES)
    rows.repartition("qa_state", "change_typ").write.mode("overwrite").partitionBy("qa_state", "change_typ").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """Writes one small JSON file beside its place and then renames it, so that no reader
    sees half of it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, beside = hadoop.Path(path), hadoop.Path(path + ".tmp")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(beside, place):
        raise OSError(f"can't rename to {path}")


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def event_lines(events: DataFrame, prefix: str = "@@EVENT@@") -> DataFrame:
    """One line of text for each event (kind, ...): the prefix and its fields as JSON."""
    return events.select(F.concat(F.lit(prefix), F.to_json(F.struct("*"))).alias("value"))
