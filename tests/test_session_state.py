from __future__ import annotations

from datetime import timedelta

from quatrain.streaming.sessions import stateful_sessions, widened


def test_sessions_that_touch_are_one():
    assert widened([(20, 30, 1), (0, 10, 2), (9, 12, 1), (12, 15, 1)]) == [(0, 12, 3), (12, 15, 1), (20, 30, 1)]


def test_state_is_a_value_that_any_store_keeps(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([(1, 0), (1, 600), (2, 100)], [(None, 90_000)], [(None, 180_000)]):
        spark.createDataFrame(rows, "user_id long, s long").selectExpr("user_id", "timestamp_seconds(1700000000 + s) AS ts").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    closed = stateful_sessions(stream, gap=timedelta(minutes=30))
    closed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "notes")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(closed.schema).parquet(str(tmp_path / "out")).selectExpr("user_id", "unix_seconds(session_start) - 1700000000", "unix_seconds(session_end) - 1700000000", "n").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 2400, 2), (2, 100, 1900, 1)]
