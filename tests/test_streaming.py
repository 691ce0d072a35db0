"""Streams over many micro-batches against batch results and against the closing rule, replayed by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators import sessions as batch
from logloom.sources import load
from logloom.streaming import runs, sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """The events in order of time, over six files."""
    root = tmp_path_factory.mktemp("arrivals")
    e = load(spark, SF, "events").orderBy("ts").toPandas()
    n = -(-len(e) // 6)
    (root / "events.parquet").mkdir()
    for i in range(6):
        e.iloc[i * n : (i + 1) * n].to_parquet(root / "events.parquet" / f"part-{i}.parquet", coerce_timestamps="us")
    return str(root)


def stream(spark, root):
    return runs.stream(spark, root, "events", 1).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def test_day_sessions_equal_the_batch(spark, arrivals):
    e = stream(spark, arrivals).withColumn("day", F.to_date("ts"))
    out = runs.drained(sessions.day_sessions(e, ["user_id", "day"], "ts", "ts", "value"), "t", "update")
    assert out.select("_batch").distinct().count() == 6
    got = {(r.user_id, str(r.day)): (r.part_count, round(r.recorded_seconds, 6)) for r in runs.latest(out, ["user_id", "day"]).collect()}
    e = load(spark, SF, "events").withColumn("day", F.to_date("ts"))
    want = {(r.user_id, str(r.day)): (r.part_count, round(r.recorded_seconds, 6)) for r in batch.roll_up(e, ["user_id", "day"], "ts", "ts", "value").collect()}
    assert got == want


def test_rising_edges_do_not_depend_on_batches(spark, arrivals):
    e = stream(spark, arrivals).withColumn("n", (F.col("event_type") == "error").cast("bigint"))
    got = sorted(r.event_id for r in runs.drained(sessions.rising_edges(e.select("user_id", "event_id", "ts", "n")), "t", "append").collect())
    want = sorted(r.event_id for r in sessions.q_rising_edge(spark, SF).collect())
    assert got == want


def test_intake_is_once(spark, arrivals):
    e = stream(spark, arrivals)
    twice = e.unionByName(e)
    got = runs.drained(sessions.intake(twice.select("event_id"), "event_id"), "t", "append")
    assert got.count() == got.select("event_id").distinct().count() == load(spark, SF, "events").count()


def test_a_session_closes_reopens_and_closes_again(spark, tmp_path):
    t = datetime(2024, 1, 1, 8)
    waves = [[(1, t), (1, t + timedelta(minutes=5))], [(2, t + timedelta(hours=3))], [(1, t + timedelta(hours=4))], [(2, t + timedelta(hours=30))]]
    d = tmp_path / "events.parquet"
    for i, wave in enumerate(waves):
        spark.createDataFrame(wave, "user_id bigint, ts timestamp").coalesce(1).write.mode("append").parquet(str(d))
        import time

        time.sleep(1.1)  # files are taken in order of their time
    e = runs.stream(spark, str(tmp_path), "events", 1).withWatermark("ts", "1 minute").withColumn("day", F.to_date("ts"))
    rows = runs.drained(sessions.close_sessions(e.select("user_id", "day", "ts"), 3600), "t", "append").collect()
    got = sorted((r.user_id, r.parts, r.reason, r.regenerated) for r in rows)
    assert got == [(1, 2, "idle", 0), (1, 3, "stale_day", 1), (2, 1, "stale_day", 0)]


def test_steps_run_in_order_and_a_replayed_batch_changes_nothing(spark, arrivals):
    seen = []
    steps = [lambda b, n: (seen.append(("first", n)), b.filter("event_id % 2 = 0"))[1], lambda b, n: (seen.append(("second", n)), b.withColumn("value", F.lit(0.0)))[1]]
    out = runs.drained(stream(spark, arrivals).select("event_id", "value"), "t", "append", steps)
    assert seen == [(s, n) for n in range(6) for s in ("first", "second")]
    assert out.agg(F.sum("value")).first()[0] == 0 and out.filter("event_id % 2 = 1").count() == 0
