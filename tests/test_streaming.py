from __future__ import annotations

from waymark.streaming import transitions


def test_stream_of_changes(spark, tmp_path):
    source, rows = str(tmp_path / "in"), [(1, 1, "present"), (1, 2, "present"), (1, 3, "absent"), (2, 1, "absent"), (2, 2, "present")]
    spark.createDataFrame(rows, "road_id long, seen long, status string").write.parquet(source)
    stream = spark.readStream.schema("road_id long, seen long, status string").parquet(source)
    q = transitions.detect(stream).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.road_id, r.from_status, r.to_status) for r in spark.table("changes").collect()} == {(1, "present", "absent"), (2, "absent", "present")}
