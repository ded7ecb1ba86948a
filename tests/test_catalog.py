"""Every query against its SQL on the smallest tables, and the entry points."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__
from waymark import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        v = v.date()
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


def same(spark_df, relation):
    columns = sorted(spark_df.columns)
    names = [c[0] for c in relation.description]
    assert columns == sorted(names)
    left = sorted([plain(r[c]) for c in columns] for r in spark_df.collect())
    right = sorted([plain(v) for _, v in sorted(zip(names, row, strict=True))] for row in relation.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same(catalog.queries()[name](spark, sf_dir), duck.execute(catalog.oracle_sql()[name]))


def test_entry(spark):
    assert {r.event_typ for r in __spark_entry__.entry(spark).collect()} <= {"added", "removed", "widened", "narrowed", "uncertain"}


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_status_calendar_has_every_period(spark, tmp_path):
    days = [datetime.datetime(2024, m, k, 12) for m, k in ((1, 9), (1, 31), (2, 1), (2, 9))]
    rows = [(i, day, 1, 1.0) for i, day in enumerate(days)] + [(9, days[3], 1, 1.0), (10, days[0], 2, 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["status_calendar"](spark, str(tmp_path))
    assert got.columns == ["road_id", "d20240109", "d20240131", "d20240201", "d20240209"]
    u, a = "uncertain", "absent"
    assert sorted(map(tuple, got.collect())) == [(1, u, u, u, "present"), (2, u, a, a, a)]


def test_every_row_takes_part_in_versions(spark, sf_dir, duck):
    keys = {r.c_custkey for r in catalog.queries()["keyed_upsert_all"](spark, sf_dir).collect()}
    assert keys >= {k for (k,) in duck.execute("SELECT c_custkey FROM customer").fetchall()}
    diff = [tuple(r) for r in catalog.queries()["specification_diff_all"](spark, sf_dir).collect()]
    groups = duck.execute("SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events").fetchall()
    assert {(-1 - u, p) for u, p, c in diff if c != "changed"} == set(groups)
    assert {(u, p) for u, p, c in diff if c == "changed"} == {(u, p) for u, p in groups if u % 3}
