"""Device-day sessions: grouping with first-fit overflow, roll-up, closing, and merging on one absolute timeline."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import dims
from logloom.sources import load


def roll_up(parts: DataFrame, by: list[str], start: str, end: str, seconds: str, status: str | None = None) -> DataFrame:
    """One row a session; a sum of nothing but nulls stays null. Recomputed from the parts, never carried forward."""
    excluded = F.count_if(F.col(status).isin(*dims.EXCLUDED_FROM_MERGE)) if status else F.lit(0).cast("bigint")
    return parts.groupBy(*by).agg(
        F.count("*").alias("part_count"), F.min(start).alias("started_at"), F.max(end).alias("ended_at"),
        F.sum(seconds).alias("recorded_seconds"), excluded.alias("failed_part_count"),
    )


def assign_overflow(parts: DataFrame, by: list[str], order: list[str], id_col: str, seconds: str, max_parts: int, max_seconds: float) -> DataFrame:
    """``by``, ``id_col`` and ``overflow``: the smallest session number with room for the part, in arrival order.

    A session has room below ``max_parts`` parts while its seconds and the part's (null: 0) stay within ``max_seconds``;
    a fresh session takes anything. First fit depends on order, so the parts of one device-day are folded in one row.
    Parts of a day are few; a day that needs one session only (most) skips the fold, and only ids and lengths travel.
    """
    item = F.struct(*[F.col(c) for c in order], F.col(id_col).alias("_id"), F.coalesce(F.col(seconds), F.lit(0.0)).cast("double").alias("_s"))
    days = parts.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_p"), F.count("*").alias("_n"), F.sum(F.greatest(F.coalesce(F.col(seconds), F.lit(0.0)), F.lit(0.0))).alias("_t"))
    start = F.struct(F.array().cast("array<struct<n:int,s:double>>").alias("bins"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.transform(acc["bins"], lambda b, i: F.when((b["n"] < max_parts) & (b["s"] + p["_s"] <= max_seconds), i).otherwise(-1))
        at = F.coalesce(F.array_min(F.filter(fits, lambda i: i >= 0)), F.size(acc["bins"]))
        grown = F.when(
            at == F.size(acc["bins"]), F.concat(acc["bins"], F.array(F.struct(F.lit(1).alias("n"), p["_s"].alias("s"))))
        ).otherwise(F.transform(acc["bins"], lambda b, i: F.struct((b["n"] + (i == at).cast("int")).alias("n"), (b["s"] + F.when(i == at, p["_s"]).otherwise(0.0)).alias("s"))))
        return F.struct(grown.alias("bins"), F.concat(acc["out"], F.array(at + 1)).alias("out"))

    fold = F.aggregate("_p", start, step, lambda a: a["out"])
    one = F.transform("_p", lambda p: F.lit(1))
    numbered = days.withColumn("_o", F.when((F.col("_n") <= max_parts) & (F.col("_t") <= max_seconds), one).otherwise(fold))
    each = numbered.select(*by, F.explode(F.arrays_zip("_p", "_o")).alias("x"))
    return each.select(*by, F.col("x._p._id").alias(id_col), F.col("x._o").alias("overflow"))


def new_parts(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Candidates whose key no part has yet."""
    return candidates.join(known.select(key), key, "left_anti")


def close_reason(day: Column, updated_at: Column, now: Column, idle_seconds: int) -> Column:
    """stale_day if the session's day is any other than today, else idle from exactly ``idle_seconds`` on, else null."""
    idle = updated_at <= now - F.make_dt_interval(secs=F.lit(float(idle_seconds)).cast("decimal(18,6)"))
    return F.when(day != F.to_date(now), "stale_day").when(idle, "idle")


def merge_segments(parts: DataFrame, segments: DataFrame, session: str, part: str, started: str, pos: str, start: str, end: str, text: str, status: str | None = None) -> DataFrame:
    """Segments on absolute time, in the order (at, end_at, part start, part, position), of parts that are not excluded.
    Blank texts go. ``segments`` has start and end in seconds from its part's start."""
    valid = parts.filter(~F.col(status).isin(*dims.EXCLUDED_FROM_MERGE)) if status else parts
    joined = segments.join(valid.select(session, part, started), part)

    def at(c: str) -> Column:
        return (F.col(started).cast("timestamp") + F.make_dt_interval(secs=F.col(c).cast("decimal(18,6)"))).cast("timestamp_ntz")

    said = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    return joined.select(session, part, started, pos, at(start).alias("at"), at(end).alias("end_at"), said.alias("text")).filter(F.length("text") > 0)


def merge_stats(merged: DataFrame, session: str, part: str) -> DataFrame:
    return merged.groupBy(session).agg(
        F.countDistinct(part).alias("included"), F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"), F.min("at").alias("first_at"), F.max("end_at").alias("last_at")
    )


def all_terminal(sessions: DataFrame, parts: DataFrame, key: str, status: str, terminal: list[str]) -> DataFrame:
    """Sessions that have parts, every one of them in a terminal state."""
    good = parts.groupBy(key).agg(F.bool_and(F.coalesce(F.col(status).isin(terminal), F.lit(False))).alias("_ok")).filter("_ok")
    return sessions.join(good.select(key), key, "left_semi")


def orphans(files: DataFrame, parts: DataFrame, key: str, status: str) -> DataFrame:
    """Files left behind: those of parts that no stage will read again."""
    return files.join(parts.filter(F.col(status).isin(*dims.ORPHANED)).select(key), key, "left_semi")


# -- queries ----------------------------------------------------------------------------------------------------------

MAX_PARTS, MAX_SECONDS, IDLE = 2, 60.0, 1800
NOW = "2024-01-30 20:00:00"


def _parts(spark, sf_dir):
    return load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", F.to_date("ts").alias("day"))


def _day(c="day"):
    return F.date_format(c, "yyyy-MM-dd").alias("day")


def q_day_sessions(spark, sf_dir):
    p = _parts(spark, sf_dir).withColumn("status", F.when(F.col("event_type") == "error", "FAILED").otherwise("RAW_SAVED"))
    s = roll_up(p, ["user_id", "day"], "ts", "ts", "value", "status")
    return s.select("user_id", _day(), "part_count", "started_at", "ended_at", F.round("recorded_seconds", 2).alias("recorded_seconds"), "failed_part_count")


def q_day_sessions_overflow(spark, sf_dir):
    p = _parts(spark, sf_dir).withColumn("whole", F.floor("value").cast("double"))
    found = assign_overflow(p, ["user_id", "day"], ["ts", "event_id"], "event_id", "whole", MAX_PARTS, MAX_SECONDS)
    return found.select("user_id", _day(), "event_id", "overflow")


def q_session_close(spark, sf_dir):
    s = _parts(spark, sf_dir).groupBy("user_id", "day").agg(F.max("ts").alias("updated_at"))
    reason = close_reason(F.col("day"), F.col("updated_at"), F.lit(NOW).cast("timestamp_ntz"), IDLE)
    return s.select("user_id", _day(), "updated_at", reason.alias("reason"))


def _conversation_parts(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    parts = c.groupBy(F.col("conv_id").alias("part")).agg(F.bool_or(F.col("role") == "system").alias("bad")).withColumn("session", F.floor(F.col("part") / 4))
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    start = (base + F.make_dt_interval(secs=(F.col("part") * 100).cast("decimal(18,6)"))).cast("timestamp_ntz")
    seg = c.select(F.col("conv_id").alias("part"), F.col("turn").alias("pos"), (F.col("turn") * 30).alias("s"), (F.col("turn") * 30 + F.length("text") % 40).alias("e"), "text")
    status = F.when(F.col("bad"), "FAILED").otherwise("TRANSCRIBED")
    return parts.withColumn("started", start).withColumn("status", status), seg


def _merged(spark, sf_dir):
    parts, seg = _conversation_parts(spark, sf_dir)
    return merge_segments(parts, seg, "session", "part", "started", "pos", "s", "e", "text", "status")


def q_absolute_merge(spark, sf_dir):
    from pyspark.sql.window import Window

    m = _merged(spark, sf_dir)
    w = Window.partitionBy("session").orderBy("at", "end_at", "started", "part", "pos")
    return m.select("session", "part", "pos", "at", "end_at", F.md5("text").alias("text_md5"), F.row_number().over(w).alias("place"))


def q_merge_stats(spark, sf_dir):
    return merge_stats(_merged(spark, sf_dir), "session", "part")


def q_all_terminal_sessions(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return all_terminal(c, o, "c_custkey", "o_orderstatus", ["F", "O"])


def q_new_parts(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return new_parts(d, load(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def q_orphans(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    status = F.when(F.col("quality") == 1, "COMPLETED").otherwise("FAILED")
    return orphans(d, load(spark, sf_dir, "labels").withColumn("status", status), "doc_id", "status")


_CONV = """p AS (SELECT conv_id AS part, conv_id // 4 AS session, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 100) AS started FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'system')),
 g AS (SELECT conv_id AS part, turn AS pos, turn * 30 AS s, turn * 30 + length(text) % 40 AS e, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text FROM conversations),
 m AS (SELECT session, part, started, pos, started + to_seconds(s) AS "at", started + to_seconds(e) AS end_at, text FROM g JOIN p USING (part) WHERE length(text) > 0)"""

QUERIES = {
    "day_sessions": q_day_sessions,
    "day_sessions_overflow": q_day_sessions_overflow,
    "session_close": q_session_close,
    "absolute_merge": q_absolute_merge,
    "merge_stats": q_merge_stats,
    "all_terminal_sessions": q_all_terminal_sessions,
    "new_parts_anti": q_new_parts,
    "orphans_semi": q_orphans,
}
ORACLES = {
    "day_sessions": """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS part_count, min(ts) AS started_at, max(ts) AS ended_at,
        round(sum(value), 2) AS recorded_seconds, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed_part_count FROM events GROUP BY ALL""",
    "day_sessions_overflow": f"""WITH RECURSIVE p AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, floor(value) AS s,
          row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events),
        f AS (SELECT user_id, day, event_id, i, 1 AS o, [1] AS n, [s] AS t FROM p WHERE i = 1
          UNION ALL SELECT p.user_id, p.day, p.event_id, p.i, x.o,
            CASE WHEN x.o > len(f.n) THEN list_append(f.n, 1) ELSE list_transform(f.n, lambda v, k: CASE WHEN k = x.o THEN v + 1 ELSE v END) END,
            CASE WHEN x.o > len(f.t) THEN list_append(f.t, p.s) ELSE list_transform(f.t, lambda v, k: CASE WHEN k = x.o THEN v + p.s ELSE v END) END
          FROM f JOIN p ON p.user_id = f.user_id AND p.day = f.day AND p.i = f.i + 1,
          LATERAL (SELECT CAST(coalesce(list_min(list_filter(range(1, len(f.n) + 1), lambda k: f.n[k] < {MAX_PARTS} AND f.t[k] + p.s <= {MAX_SECONDS})), len(f.n) + 1) AS INTEGER) AS o) x)
        SELECT user_id, strftime(day, '%Y-%m-%d') AS day, event_id, CAST(o AS INTEGER) AS overflow FROM f""",
    "session_close": f"""SELECT user_id, strftime(d, '%Y-%m-%d') AS day, u AS updated_at, CASE WHEN d <> DATE '{NOW[:10]}' THEN 'stale_day'
        WHEN u <= TIMESTAMP '{NOW}' - INTERVAL {IDLE} SECOND THEN 'idle' END AS reason FROM (SELECT user_id, CAST(ts AS DATE) AS d, max(ts) AS u FROM events GROUP BY ALL)""",
    "absolute_merge": f"""WITH {_CONV} SELECT session, part, pos, "at", end_at, md5(text) AS text_md5, row_number() OVER (PARTITION BY session ORDER BY "at", end_at, started, part, pos) AS place FROM m""",
    "merge_stats": f"""WITH {_CONV} SELECT session, count(DISTINCT part) AS included, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars, min("at") AS first_at, max(end_at) AS last_at FROM m GROUP BY session""",
    "all_terminal_sessions": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus IN ('F', 'O')))",
    "new_parts_anti": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "orphans_semi": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
}
