"""Streams fed in waves, against batch results and folds by hand; one key of each has most of the rows."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from logloom.operators import sessions
from logloom.streaming import first_fit, outcomes, reopening
from logloom.streaming.runs import fed

T = datetime(2024, 1, 1)


def moves_by_hand(rows, idle, until):
    """rows of (user, day, failed, arrived); ``until``: the watermark after the last batch."""
    out = []
    for key in sorted({r[:2] for r in rows}):
        parts = failed = again = n = 0
        due = None
        end = datetime.combine(key[1], datetime.min.time()) + timedelta(days=1)
        late = False

        def close():
            return (*key, "SAVED", "stale_day" if late or due >= end else "idle", parts, failed, again)

        for at, bad in sorted((r[3], r[2]) for r in rows if r[:2] == key):
            if due is not None and due < at:
                out.append(close())
                due = None
            if due is None:
                again += n > 0
            parts, failed, late = parts + 1, failed + bad, at >= end
            if due is None:
                out.append((*key, "MERGING" if n else "OPEN", None, parts, failed, again))
            n += 1
            due = at + timedelta(seconds=idle) if late else min(end, at + timedelta(seconds=idle))
        if due < until:
            out.append(close())
    return sorted(out, key=repr)


def test_moves_do_not_depend_on_waves(spark):
    rnd = random.Random(4)
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 5), date(2024, 1, 1), rnd.random() < 0.3, T + timedelta(seconds=rnd.randint(0, 200_000))) for _ in range(300)]
    df = spark.createDataFrame(rows, "user_id bigint, day date, failed boolean, arrived timestamp")
    want = moves_by_hand(rows, 1200, max(r[3] for r in rows) - timedelta(minutes=1))
    assert {r[6] for r in want} >= {0, 1, 2} and any(r[5] for r in want)
    for n in (1, 4):
        wave = F.least(F.floor((F.unix_seconds("arrived") - int(T.timestamp())) * n / 200_000), F.lit(n - 1))
        got = fed(df, wave, n, lambda s: reopening.session_moves(s.withWatermark("arrived", "1 minute"), 1200), "t").collect()
        assert sorted(((r.user_id, r.day, r.status, r.reason, r.parts, r.failed_parts, r.regenerated) for r in got), key=repr) == want, n
        assert len({(r.user_id, r.day, r.n) for r in got}) == len(got)


def test_first_fit_equals_the_batch_for_a_hot_day(spark):
    rnd = random.Random(6)
    rows = [(0 if rnd.random() < 0.7 else rnd.randint(1, 4), date(2024, 1, 1), i, T + timedelta(seconds=i * 50), rnd.choice([None, 1.0, 7.0, 30.0, 90.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "user_id bigint, day date, event_id bigint, ts timestamp, seconds double")
    want = {(r.user_id, r.event_id): r.overflow for r in sessions.assign_overflow(df, ["user_id", "day"], ["ts", "event_id"], "event_id", "seconds", 3, 60.0).collect()}
    build = lambda s: first_fit.assigned(s.withWatermark("ts", "1 minute"), 3, 60.0)
    got = first_fit.with_rocks(spark, lambda: fed(df, F.floor(F.col("event_id") / 80), 4, build, "t")).collect()
    assert {(r.user_id, r.event_id): r.overflow for r in got} == want and len(got) == 300 and max(want.values()) > 20
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_results_in_time_late_missing_and_unasked(spark):
    s = lambda n: T + timedelta(seconds=n)
    rows = [("q", i, None, s(i * 10)) for i in range(40)] + [("a", i, "completed" if i % 2 else "refused", s(i * 10 + (50 if i % 4 else 500))) for i in range(30)] + [("a", 99, "completed", s(3))]
    rows += [("q", -1, None, s(9000)), ("a", -1, None, s(9000))]
    df = spark.createDataFrame(rows, "kind string, request_id bigint, outcome string, at timestamp")

    def build(x):
        asked = x.filter("kind = 'q'").select("request_id", F.col("at").alias("requested_at")).withWatermark("requested_at", "1 second")
        told = x.filter("kind = 'a'").select("request_id", "outcome", F.col("at").alias("answered_at")).withWatermark("answered_at", "1 second")
        return outcomes.outcomes(asked, told, 120)

    got = fed(df, F.when(F.col("request_id") < 0, 2).otherwise(F.least(F.floor((F.unix_seconds("at") - int(T.timestamp())) / 200), F.lit(1))), 3, build, "t").filter("request_id >= 0").collect()
    assert {r.request_id: r.outcome for r in got} == {i: "timed_out" if i >= 30 or i % 4 == 0 else "completed" if i % 2 else "refused" for i in range(40)} and len(got) == 40
