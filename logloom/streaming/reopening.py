"""Late parts: sessions that close by the clock of arrivals, and are reopened by parts that come after that."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.sources import load
from logloom.streaming.runs import bucketed, fed, packed, unpacked

_MOVES = "user_id bigint, day date, n bigint, status string, reason string, parts bigint, failed_parts bigint, regenerated bigint, at timestamp"
_STATE = "users binary, parts binary, failed binary, due_us binary, open binary, regenerated binary, n binary, late binary"


def session_moves(parts: DataFrame, idle_s: int) -> DataFrame:
    """A row for each move of a device-day session: OPEN by its first part, SAVED when it closes, MERGING when a part
    reopens it; n counts its moves, regenerated how often it was reopened.

    ``parts`` has user_id, day, failed (counted, but it opens and reopens like any part) and arrived, with a watermark on
    arrived, which is the clock. A session closes ``idle_s`` after its last part arrived, and at the end of its day at the
    latest (stale_day, as is any later close). The devices of a day share BUCKETS state groups, and the state of a session is
    eight numbers; the parts of a batch are taken in order of arrival, and a session whose end came before the next part is
    closed first, so the moves don't depend on how arrivals fall into batches.
    """
    idle = idle_s * 1_000_000

    def moves(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = np.stack([unpacked(c) for c in state.get]).T.tolist() if state.exists else []
        sessions = {s[0]: s[1:] for s in kept}
        day_end = (pd.Timestamp(key[0]) - pd.Timestamp(0)) // pd.Timedelta(microseconds=1) + 86_400_000_000
        out = []

        def move(user: int, s: list, status: str, at: int, reason: str | None = None):
            s[5] += 1
            out.append((user, s[5], status, reason, s[0], s[1], s[4], at))

        def close(user: int, s: list):
            s[3] = 0
            move(user, s, "SAVED", s[2], "stale_day" if s[6] or s[2] >= day_end else "idle")

        b = pd.concat([x for x in batches if len(x)] or [pd.DataFrame({"user_id": [], "arrived": [], "failed": []})])  # a timer brings an empty one
        b = b.assign(at=b["arrived"].to_numpy("datetime64[us]").astype(np.int64)).sort_values(["user_id", "at", "failed"])
        for user, at, bad in zip(b["user_id"].astype("int64").tolist(), b["at"].tolist(), b["failed"].astype(bool).tolist()):
            s = sessions.get(user)
            if s is None:
                s = sessions[user] = [0] * 7  # parts, failed, due, open, regenerated, n, late
            if s[3] and s[2] < at:
                close(user, s)
            s[4] += bool(s[5] and not s[3])
            s[0], s[1], s[6] = s[0] + 1, s[1] + bad, int(at >= day_end)
            if not s[3]:
                move(user, s, "MERGING" if s[5] else "OPEN", at)
            s[3], s[2] = 1, at + idle if s[6] else min(day_end, at + idle)
        now, first = state.getCurrentWatermarkMs(), None
        for user, s in sessions.items():
            if s[3] and s[2] < now * 1000:
                close(user, s)
            if s[3] and (first is None or s[2] < first):
                first = s[2]
        state.update(packed(*np.array([[user, *s] for user, s in sessions.items()], np.int64).reshape(-1, 8).T))
        if first is not None:
            state.setTimeoutTimestamp(max(first // 1000 + 1, now + 1))
        user, n, status, reason, parts, failed, again, at = zip(*out) if out else [()] * 8
        who = pd.array(user if not pd.isna(key[1]) else [None] * len(out), dtype="Int64")
        yield pd.DataFrame({"user_id": who, "day": [key[0]] * len(out), "n": n, "status": status, "reason": reason, "parts": parts, "failed_parts": failed, "regenerated": again, "at": pd.to_datetime(np.array(at, np.int64), unit="us")})

    return bucketed(parts).groupBy("day", "bucket").applyInPandasWithState(moves, _MOVES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


# -- query ------------------------------------------------------------------------------------------------------------

IDLE, WAVES = 7200, 4
#: Every fifth event arrives two days late, every eleventh three and a half.
_LATE = "CASE WHEN event_id % 11 = 0 THEN 84 WHEN event_id % 5 = 0 THEN 48 ELSE 0 END"


def arrivals(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "error").alias("failed"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return e.withColumn("arrived", F.col("ts") + F.make_dt_interval(hours=F.expr(_LATE))).drop("ts", "event_id")


def q_session_reopen(spark, sf_dir):
    """Events as parts, some of them late, fed in the order of their arrival."""
    rows = arrivals(spark, sf_dir)
    first, last = rows.agg(F.min(F.unix_seconds("arrived")), F.max(F.unix_seconds("arrived"))).first()
    wave = F.least(F.floor((F.unix_seconds("arrived") - (first or 0)) * WAVES / max(1, (last or 0) - (first or 0))), F.lit(WAVES - 1))
    out = fed(rows, wave, WAVES, lambda s: session_moves(s.withWatermark("arrived", "10 minutes"), IDLE), "reopen")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "status", "reason", "parts", "failed_parts", "regenerated", F.col("at").cast("timestamp_ntz").alias("at"))


QUERIES = {"stream_session_reopen": q_session_reopen}
ORACLES = {
    "stream_session_reopen": f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, event_id, event_type = 'error' AS bad, ts + to_hours({_LATE}) AS a FROM events),
      w AS (SELECT date_trunc('millisecond', max(a) - INTERVAL 10 MINUTE) AS w FROM e),
      p AS (SELECT *, d + INTERVAL 1 DAY AS dayend, row_number() OVER (PARTITION BY user_id, d ORDER BY a, bad, event_id) AS parts, count(*) FILTER (bad) OVER (PARTITION BY user_id, d ORDER BY a, bad, event_id ROWS UNBOUNDED PRECEDING) AS failed, a >= d + INTERVAL 1 DAY AS late FROM e),
      q AS (SELECT *, CASE WHEN late THEN a + INTERVAL {IDLE} SECOND ELSE least(dayend, a + INTERVAL {IDLE} SECOND) END AS due, lead(a) OVER (PARTITION BY user_id, d ORDER BY parts) AS next FROM p),
      r AS (SELECT *, parts > 1 AND lag(due) OVER (PARTITION BY user_id, d ORDER BY parts) < a AS again FROM q),
      s AS (SELECT *, count(*) FILTER (again) OVER (PARTITION BY user_id, d ORDER BY parts ROWS UNBOUNDED PRECEDING) AS regenerated FROM r),
      m AS (SELECT user_id, d, CASE WHEN parts = 1 THEN 'OPEN' ELSE 'MERGING' END AS status, NULL AS reason, parts, failed, regenerated, a AS "at", 0 AS z FROM s WHERE parts = 1 OR again
        UNION ALL SELECT user_id, d, 'SAVED', CASE WHEN late OR due >= dayend THEN 'stale_day' ELSE 'idle' END, parts, failed, regenerated, due, 1 FROM s, w WHERE coalesce(due < next, due < w))
      SELECT user_id, strftime(d, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, d ORDER BY parts, z) AS n, status, reason, parts, failed AS failed_parts, regenerated, "at" FROM m""",
}
