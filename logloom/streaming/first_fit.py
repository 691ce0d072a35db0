"""First-fit grouping of parts into sessions as they arrive."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.operators import sessions
from logloom.sources import load
from logloom.streaming.runs import bucketed, fed, packed, unpacked

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SESSIONS = "user_id bigint, day date, event_id bigint, overflow int"
_BINS = "users binary, sizes binary, n binary, s binary"


class FirstFit(StatefulProcessor):
    """The sessions of the device-days of a state group, device by device, as columns of parts and seconds; a timer clears them
    ``keep_ms`` after the day's end."""

    def __init__(self, max_parts: int, max_seconds: float, keep_ms: int):
        self.max_parts, self.max_seconds, self.keep_ms = max_parts, max_seconds, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bins = handle.getValueState("bins", _BINS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days: dict[int, list[list]] = {}
        if self.bins.exists():
            kept = self.bins.get()
            users, sizes, n, s = unpacked(kept[0]), unpacked(kept[1]), unpacked(kept[2]).tolist(), unpacked(kept[3], "<f8").tolist()
            ends = np.cumsum(sizes)
            for user, a, z in zip(users.tolist(), (ends - sizes).tolist(), ends.tolist()):
                days[user] = [list(x) for x in zip(n[a:z], s[a:z])]
        else:
            end = (pd.Timestamp(key[0]) - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1) + 86_400_000 + self.keep_ms
            self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        new = pd.concat(list(rows)).sort_values(["user_id", "ts", "event_id"])
        out, most, longest = [], self.max_parts, self.max_seconds
        for user, s in zip(new["user_id"].tolist(), new["seconds"].fillna(0.0).tolist()):
            bins = days.setdefault(user, [])
            at = next((i for i, (n, t) in enumerate(bins) if n < most and t + s <= longest), len(bins))
            if at == len(bins):
                bins.append([0, 0.0])
            bins[at][0] += 1
            bins[at][1] += s
            out.append(at + 1)
        flat = [x for bins in days.values() for x in bins]
        columns = ([*days], [len(bins) for bins in days.values()], [n for n, _ in flat], [s for _, s in flat])
        self.bins.update(packed(*(np.array(c, k) for c, k in zip(columns, ("<i8", "<i8", "<i8", "<f8")))))
        user = pd.array(new["user_id"] if not pd.isna(key[1]) else [None] * len(new), dtype="Int64")
        yield pd.DataFrame({"user_id": user, "day": [key[0]] * len(new), "event_id": new["event_id"].to_numpy(), "overflow": pd.array(out, dtype="int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bins.clear()
        return iter(())

    def close(self) -> None:
        pass


def assigned(parts: DataFrame, max_parts: int, max_seconds: float, keep_s: int = 86_400) -> DataFrame:
    """user_id, day, event_id and overflow, the number of the first session of the device-day with room for the part; what
    operators.sessions.assign_overflow gives for all parts at once, for any cut of them into batches that keeps
    their order within a device-day. ``parts`` has user_id, day, event_id, seconds (null: 0) and ts with a watermark.

    The devices of a day share BUCKETS state groups. State is two numbers a session, not the parts; it goes ``keep_s`` after
    the day's end, and a part that comes even later begins a day anew. The session's state store must be RocksDB (``with_rocks``).
    """
    processor = FirstFit(max_parts, max_seconds, keep_s * 1000)
    return bucketed(parts).groupBy("day", "bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=_SESSIONS, outputMode="Append", timeMode="EventTime")


def with_rocks(spark, run):
    """``run()`` while the session's state store is RocksDB, which lists and timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(_PROVIDER, before)


# -- query ------------------------------------------------------------------------------------------------------------

WAVES = 3


def q_first_fit(spark, sf_dir):
    """Events as parts, fed in thirds of their time."""
    e = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("double").alias("seconds"))
    first, last = e.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    wave = F.least(F.floor((F.unix_seconds("ts") - (first or 0)) * WAVES / max(1, (last or 0) - (first or 0))), F.lit(WAVES - 1))
    build = lambda s: assigned(s.withWatermark("ts", "10 minutes"), sessions.MAX_PARTS, sessions.MAX_SECONDS)
    out = with_rocks(spark, lambda: fed(e, wave, WAVES, build, "first-fit"))
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "event_id", "overflow")


QUERIES = {"stream_first_fit": q_first_fit}
ORACLES = {"stream_first_fit": sessions.ORACLES["day_sessions_overflow"]}
