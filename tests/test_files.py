"""Sources and sinks on files, and the batch driver."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from waymark.operators import fields, reports
from waymark.sources import files, sinks


def put(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_encodings(spark, tmp_path):
    texts = {"a.txt": "影像/一.tif".encode("gbk"), "b.txt": "影像/二.tif".encode("utf-16"), "c.txt": "﻿x".encode(), "d.txt": b"caf\xe9 \x81", "e.txt": "é".encode("utf-8-sig")}
    for name, data in texts.items():
        put(tmp_path / "t" / name, data)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.encoding) for r in files.texts(spark, str(tmp_path / "t")).collect()}
    assert got["a.txt"] == ("影像/一.tif", "gb18030") and got["b.txt"] == ("影像/二.tif", "utf-16") and got["c.txt"] == ("x", "utf-8-sig") and got["e.txt"][0] == "é"


def test_path_lists(spark, tmp_path):
    root, lists = tmp_path / "root", tmp_path / "lists"
    put(root / "b.tif")
    put(lists / "a.tif")
    put(lists / "one.txt", f"# list\na.tif\n\n'b.tif'\n{root}/b.tif\n")
    rows = files.path_list(spark, str(lists), [str(root)]).orderBy("line_number").collect()
    assert [(r.line_number, r.path) for r in rows] == [(2, f"{lists}/a.tif"), (4, f"{root}/b.tif"), (5, f"{root}/b.tif")]
    put(lists / "two.txt", "gone.tif\n".encode("utf-16"))
    with pytest.raises(FileNotFoundError, match="two.txt:1: gone.tif"):
        files.path_list(spark, str(lists), [str(root)])
    assert files.path_list(spark, str(lists), [str(root)], require=False).where("NOT found").count() == 1
    assert {(r.group, r.path.rsplit("/", 1)[1]) for r in files.image_records(spark, str(root / "none"), str(lists), "txt").collect()} >= {("one", "a.tif"), ("two", "gone.tif")}
    assert files.image_records(spark, str(root), None).collect()[0].group is None
    assert {r.batch for r in files.inference_batches(spark, lists=str(lists)).collect()} == {"one", "two"}
    with pytest.raises(ValueError):
        files.inference_batches(spark)


def test_grids(spark, tmp_path):
    root = str(tmp_path / "g")
    for p in ("n/2021.txt", "n/2021.tif", "n/2022.TIF", "n/2023/a/x.tif", "n/note.md", "shp/1.txt", "shp/2.txt", "_x/1.txt", "s/1.tif", "s/2.tif"):
        put(f"{root}/{p}")
    got = {(r.grid, r.period): r.source[len(root) + 1 :] for r in files.grid_periods(files.listing(spark, root), root).collect()}
    assert got == {("n", "2021"): "n/2021.txt", ("n", "2022"): "n/2022.TIF", ("n", "2023"): "n/2023", ("s", "1"): "s/1.tif", ("s", "2"): "s/2.tif"}
    put(f"{root}/alone/1.tif")
    with pytest.raises(ValueError, match="alone"):
        files.grid_periods(files.listing(spark, root), root)
    assert files.fingerprints(spark, root).first().files == 10  # hidden folders are not listed
    assert files.images(spark, root).count() == 6


def test_projects(spark, tmp_path):
    root = str(tmp_path / "p")
    for p in ("a/01_area/b.shp", "a/02_images/9.txt", "a/02_images/10.txt", "a/02_images/11.txt", "a/03_truth/9_to_10.shp", "a/03_truth/9_to_11.shp", "a/03_truth/x.shp"):
        put(f"{root}/{p}")
    got = files.project(files.listing(spark, root), root)
    assert [(r.before, r.after) for r in got["truths"].collect()] == [("9", "10")]
    assert got["periods"].count() == 3
    put(f"{root}/b/02_images/1.txt")
    with pytest.raises(ValueError, match="b"):
        files.project(files.listing(spark, root), root)


def test_csv_and_jobs(spark, tmp_path):
    path = put(tmp_path / "c.csv", "﻿a,b\n1,x\n02,\n")
    assert [tuple(r) for r in files.csv_rows(spark, path, ["a", "b"]).collect()] == [("1", "x"), ("02", None)]
    assert files.csv_rows(spark, path + "x", ["a", "b"]).count() == 0
    t = lambda rows: spark.createDataFrame(rows, "stem string, path string")
    got = files.image_jobs(t([("im1", "/1"), ("im2", "/2"), ("im3", "/3")]), t([("im1", "/g2"), ("im1", "/g1"), ("im2", "/g")]), t([("im1_x_mask", "/c"), ("im1_mask", "/d"), ("im1", "/b"), ("im3_mask", "/e"), ("im2x", "/f")]), 2)
    assert [tuple(r) for r in got.collect()] == [("im1", "/1", "/g1", "/d")]
    near = spark.createDataFrame([(0.5, 1.5, [(2.4, 2.0), (0.2, 2.0)]), (2.0, 2.0, [(0.0, 2.0)])], "y double, x double, near array<struct<y: double, x: double>>")
    nodes, edges = files.graph_of(near)
    assert nodes.count() == 2 and edges.count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", 2.5)], "id string, w double")
    shape = {"id": "string", "note": "string", "w": "double", "z": "double"}
    sinks.write_shaped(rows, str(tmp_path / "s"), shape)
    got = spark.read.parquet(str(tmp_path / "s")).first()
    assert (got.id, got.note, got.w) == ("1", "", 2.5) and got.z != got.z
    sinks.write_shaped(rows.limit(0), str(tmp_path / "e"), shape)
    assert spark.read.parquet(str(tmp_path / "e")).columns == list(shape)
    a = spark.createDataFrame([(1, "added", None, 1.0)], "id int, change_typ string, qa_state string, before_geom_cov double")
    out = sinks.write_changes(a, spark.createDataFrame([(2, "removed", "review", 0.5)], a.schema), str(tmp_path / "ch"))
    assert sorted((r.id, r.qa_state, r.change_typ, r.bef_gcov, r.audit_reas) for r in out.collect()) == [(1, "auto", "added", 1.0, ""), (2, "review", "removed", 0.5, "")]
    sinks.write_csv(rows, str(tmp_path / "csv"), ["w", "id"])
    assert files.csv_rows(spark, str(tmp_path / "csv"), []).columns == ["w", "id"]
    path = str(tmp_path / "j.json")
    sinks.write_json(spark, path, {"a": 1})
    sinks.write_json(spark, path, {"a": "ü"})
    assert sinks.read_json(spark, path) == {"a": "ü"} and not os.path.exists(path + ".tmp")
    assert sinks.event_lines(spark.createDataFrame([("done", 3)], "kind string, n int")).first()[0] == '@@EVENT@@{"kind":"done","n":3}'


def test_batch_driver():
    done = []

    def period(g, p):
        done.append((g, p))
        if p == "b":
            raise RuntimeError("broken")

    pair = lambda *k: done.append(k)
    kept = []
    rows = reports.run_batch({"n": ["a", "b", "c", "d"]}, period, pair, ready=lambda u: u == ("n", "a"), go_on=True, keep=lambda r: kept.append(len(r)))
    assert [r["status"] for r in rows] == ["skipped", "failed", "complete", "complete", "dependency_skipped", "dependency_skipped", "complete"]
    assert ("n", "c", "d") in done and ("n", "a") not in done and kept == [1, 2, 3, 4, 5, 6, 7]
    with pytest.raises(RuntimeError):
        reports.run_batch({"n": ["b"]}, period, pair)


def test_stages_resume():
    ran = []
    work = {s: (lambda s=s: ran.append(s)) for s in reports.STAGES}
    state = {"extract": "complete", "surface": "complete", "width": "complete"}
    out = reports.run_stages(state, lambda s: s != "surface", work)
    assert ran == ["surface", "width", "finalize", "export"] and set(out.values()) == {"complete"}


def test_rerun_states(spark):
    ch = spark.createDataFrame([("g", "1", "2", "ok"), ("g", "2", "3", "ok"), ("g", "3", "4", "ok"), ("h", "1", "2", "ok")], "grid string, before string, after string, status string")
    assert [r.status for r in reports.after_rerun(ch, "g", "2", False).collect()] == ["stale", "stale", "ok", "ok"]
    assert [r.status for r in reports.after_rerun(ch, "g", "2", True).collect()] == ["rerun", "rerun", "ok", "ok"]
    t = lambda rows: spark.createDataFrame(rows, "grid string, period string, fingerprint string")
    now = t([("north", p, p) for p in ("2021", "2022", "2024")])
    periods, pairs = reports.invalidation(now, now, thresholds=True)
    assert periods.count() == 0 and pairs.count() == 2
    periods, pairs = reports.invalidation(now, t([("north", p, "x" if p == "2022" else p) for p in ("2021", "2022", "2024")]))
    assert [tuple(r) for r in periods.collect()] == [("north", "2022")] and pairs.count() == 2


def test_names_and_thresholds(spark):
    used = {"s2021"}
    assert fields.short_names("S", ["2021", "long-period-2022", "", "2021"], used) == {"2021": "S20212", "long-period-2022": "PERIOD2022", "": "SP"}
    assert fields.thresholds({}) == (0.364, 0.2, "default")
    assert fields.thresholds({"ROAD_THRESHOLD_PROFILES": {"w": {"road_high_threshold": 0.2}}}, "w")[:2] == (0.2, pytest.approx(0.13))
    with pytest.raises(ValueError):
        fields.thresholds({"ROAD_HIGH_THRESHOLD": 0.1, "ROAD_LOW_THRESHOLD": 0.2})
    rows = spark.createDataFrame([(0.0, "x", 3.0)], "width_map double, width_m string, width double")
    assert fields.field_with_values(rows) == "width" and fields.field_with_values(rows.select("width_map")) is None
    assert fields.field_or_zero(rows.select(F.lit(1).alias("q")))[1] == "_width_zero" and fields.first_field(rows.withColumn("change", F.lit(1))) == "change"
    with pytest.raises(ValueError):
        fields.first_field(rows, requested="nope")
