"""Streaming twins: exactly-once intake, day sessions, closing with timers and reopening, rising edges."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.streaming.runs import bucketed, drained, latest, packed, stream, unpacked


def intake(parts: DataFrame, key: str) -> DataFrame:
    """Each key once, whenever it comes again. Lateness has no bound, so the state keeps every key."""
    return parts.dropDuplicates([key])


def day_sessions(parts: DataFrame, by: list[str], start: str, end: str, seconds: str) -> DataFrame:
    """Roll-up of each device-day, updated as parts come."""
    return parts.groupBy(*by).agg(F.count("*").alias("part_count"), F.min(start).alias("started_at"), F.max(end).alias("ended_at"), F.sum(seconds).alias("recorded_seconds"))


_CLOSED = "user_id bigint, day date, parts bigint, last_at timestamp, reason string, regenerated bigint"
_STATE = "users binary, parts binary, last_us binary, closed binary, regenerated binary, timer binary"
_NEVER = np.iinfo(np.int64).max


def close_sessions(parts: DataFrame, idle_s: int) -> DataFrame:
    """A row each time a device-day session closes: at the day's end (stale_day) or ``idle_s`` after its last part.

    ``parts`` has user_id, day and ts with a watermark, which is the clock. The devices of a day share BUCKETS state groups; the
    state of a session is six numbers, its timer is the earlier of both ends, and that of a group the earliest of its
    sessions. A part that comes to a closed session opens it again: it closes once more, with regenerated counted up.
    """

    def close(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        users, parts, last, closed, again, timer = map(unpacked, state.get) if state.exists else np.zeros((6, 0), np.int64)
        now = state.getCurrentWatermarkMs()
        day_end = (pd.Timestamp(key[0]) - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1) + 86_400_000
        b = pd.concat([x for x in batches if len(x)] or [pd.DataFrame({"user_id": [], "ts": []})])
        us = b["ts"].to_numpy("datetime64[us]").astype(np.int64)
        come, at = np.unique(b["user_id"].to_numpy(np.int64), return_inverse=True)
        # Sessions of the parts that have come, after those that are there.
        fresh = come[~np.isin(come, users)]
        zero = np.zeros(len(fresh), np.int64)
        users, parts, last, closed, again, timer = (np.append(a, f) for a, f in ((users, fresh), (parts, zero), (last, zero), (closed, zero), (again, zero), (timer, zero + _NEVER)))
        order = np.argsort(users)
        place = order[np.searchsorted(users, come, sorter=order)]
        touched = np.zeros(len(users), bool)
        touched[place] = True
        # Those whose end came before these parts, only no batch ran in between, and those without parts whose timer is over.
        ends = (parts > 0) & (closed == 0) & np.where(touched, np.minimum(day_end, last // 1000 + idle_s * 1000) < now, timer < now)
        n = int(ends.sum())
        reason = "stale_day" if now >= day_end else "idle"
        user = pd.array(users[ends], dtype="Int64") if not pd.isna(key[1]) else pd.array([None] * n, dtype="Int64")
        out = pd.DataFrame({"user_id": user, "day": [key[0]] * n, "parts": parts[ends], "last_at": pd.to_datetime(last[ends], unit="us"), "reason": [reason] * n, "regenerated": again[ends]})
        closed[ends], timer[ends] = 1, _NEVER
        parts[place] += np.bincount(at, minlength=len(come))
        newest = last[place]
        np.maximum.at(newest, at, us)
        last[place] = newest
        again[place] += closed[place]
        closed[place] = 0
        timer[place] = np.maximum(np.minimum(day_end, newest // 1000 + idle_s * 1000), now + 1)
        state.update(packed(users, parts, last, closed, again, timer))
        if len(timer) and timer.min() < _NEVER:
            state.setTimeoutTimestamp(max(int(timer.min()), now + 1))
        yield out

    return bucketed(parts).groupBy("day", "bucket").applyInPandasWithState(close, _CLOSED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def rising_edges(snapshots: DataFrame) -> DataFrame:
    """user_id, event_id and n of snapshots (with ts) that are not empty after an empty one; each key's first fires always."""

    def edges(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (before,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        n = rows["n"].to_numpy()
        was = [before, *n[:-1]]
        fires = [(i == 0 and not state.exists) or (w == 0 and x > 0) for i, (w, x) in enumerate(zip(was, n))]
        state.update((int(n[-1]),))
        yield rows.loc[fires, ["user_id", "event_id", "n"]]

    return snapshots.groupBy("user_id").applyInPandasWithState(edges, "user_id bigint, event_id bigint, n bigint", "n bigint", "append", GroupStateTimeout.NoTimeout)


# -- queries ----------------------------------------------------------------------------------------------------------

IDLE = 3600


def _events(spark, sf_dir):
    return stream(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def q_intake(spark, sf_dir):
    e = _events(spark, sf_dir)
    twice = e.unionByName(e.filter("event_type = 'click'"))
    return drained(intake(twice.select("event_id", "user_id"), "event_id"), "intake", "append").drop("_batch")


def q_day_sessions(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    out = latest(drained(day_sessions(e, ["user_id", "day"], "ts", "ts", "value"), "day-sessions", "update"), ["user_id", "day"])
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")]
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "part_count", *ntz, F.round("recorded_seconds", 2).alias("recorded_seconds"))


def q_session_close(spark, sf_dir):
    e = _events(spark, sf_dir).withWatermark("ts", "10 minutes").withColumn("day", F.to_date("ts"))
    out = drained(close_sessions(e.select("user_id", "day", "ts"), IDLE), "session-close", "append")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "parts", F.col("last_at").cast("timestamp_ntz").alias("last_at"), "reason", "regenerated")


def q_rising_edge(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("n", (F.col("event_type") == "error").cast("bigint"))
    return drained(rising_edges(e.select("user_id", "event_id", "ts", "n")), "rising-edge", "append").drop("_batch")


def q_steps(spark, sf_dir):
    """Steps that run in order on each batch: the second drops what the first has marked, the third counts from what is left."""
    e = _events(spark, sf_dir).select("event_id", "user_id", F.lit(0).cast("bigint").alias("mark"), F.lit(0).cast("bigint").alias("rest"))
    steps = [
        lambda b, n: b.withColumn("mark", F.col("event_id") % 3),
        lambda b, n: b.filter("mark > 0"),
        lambda b, n: b.drop("rest").join(b.groupBy("user_id").agg(F.count("*").alias("rest")), "user_id").select("event_id", "user_id", "mark", "rest"),
    ]
    return drained(e, "steps", "append", steps).drop("_batch")


QUERIES = {"stream_steps": q_steps, "stream_intake": q_intake, "stream_day_sessions": q_day_sessions, "stream_session_close": q_session_close, "stream_rising_edge": q_rising_edge}
ORACLES = {
    "stream_steps": "SELECT event_id, user_id, event_id % 3 AS mark, count(*) OVER (PARTITION BY user_id) AS rest FROM events WHERE event_id % 3 > 0",
    "stream_intake": "SELECT event_id, user_id FROM events",
    "stream_day_sessions": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS part_count, min(ts) AS started_at, max(ts) AS ended_at, round(sum(value), 2) AS recorded_seconds FROM events GROUP BY ALL",
    "stream_session_close": f"""WITH w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events), s AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS parts, max(ts) AS last_at FROM events GROUP BY ALL)
      SELECT user_id, strftime(d, '%Y-%m-%d') AS day, parts, last_at, CASE WHEN d + INTERVAL 1 DAY <= date_trunc('millisecond', w) THEN 'stale_day' ELSE 'idle' END AS reason, 0::BIGINT AS regenerated FROM s, w
      WHERE least(d + INTERVAL 1 DAY, date_trunc('millisecond', last_at) + INTERVAL {IDLE} SECOND) < date_trunc('millisecond', w)""",
    "stream_rising_edge": """WITH s AS (SELECT user_id, event_id, CAST(event_type = 'error' AS BIGINT) AS n, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT user_id, event_id, n FROM s WHERE r = 1 OR (NOT b AND n > 0)""",
}
