"""Devices of a day share state groups: state and calls of Python follow days, not device-days; ids that are null keep apart."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators import sessions as batch
from logloom.streaming import first_fit, reopening, sessions
from logloom.streaming.runs import BUCKETS

T = datetime(2024, 1, 1, 8)
BIG = 2**60 + 1
STREAMS = {
    "close": lambda s: sessions.close_sessions(s.withWatermark("ts", "1 minute").select("user_id", "day", "ts"), 60),
    "reopen": lambda s: reopening.session_moves(s.withColumnRenamed("ts", "arrived").withColumn("failed", F.lit(False)).withWatermark("arrived", "1 minute"), 60),
    "first-fit": lambda s: first_fit.assigned(s.withWatermark("ts", "1 minute"), 2, 60.0),
}


@pytest.mark.parametrize("name", STREAMS)
def test_state_follows_days(spark, tmp_path, name):
    rows = [(None if i % 300 == 0 else BIG + i % 300, T.date(), i, T + timedelta(seconds=i), float(i % 50)) for i in range(900)]
    rows += [(7, (T + timedelta(days=1)).date(), 900, T + timedelta(days=1), 1.0)]
    df = spark.createDataFrame(rows, "user_id bigint, day date, event_id bigint, ts timestamp, seconds double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    made = STREAMS[name](spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = first_fit.with_rocks(spark, lambda: made.writeStream.format("memory").queryName("state_groups").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start())
    try:
        q.processAllAvailable()
        got = spark.table("state_groups").collect()
        held = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    finally:
        q.stop()
    assert held <= 2 * (BUCKETS + 1)
    users = {None, *(BIG + i for i in range(1, 300))}
    if name == "close":
        assert {(r.user_id, r.parts, r.reason) for r in got} == {(u, 3, "stale_day") for u in users} and len(got) == 300
    elif name == "reopen":
        first = [r for r in got if str(r.day) == "2024-01-01"]
        assert {r.user_id for r in first} == users and sorted(r.status for r in first) == ["MERGING"] * 600 + ["OPEN"] * 300 + ["SAVED"] * 900
    else:
        want = batch.assign_overflow(df, ["user_id", "day"], ["ts", "event_id"], "event_id", "seconds", 2, 60.0).collect()
        assert sorted((r.event_id, r.user_id or 0, r.overflow) for r in got) == sorted((r.event_id, r.user_id or 0, r.overflow) for r in want)
