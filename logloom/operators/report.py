"""Status snapshot and performance report: zero-filled histograms, backlog, oldest failures, throughput, verdicts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.functions import dims
from logloom.sources import load
from logloom.sources.logs import parse_lines, with_parsed


def histogram(rows: DataFrame, status: str, domain: DataFrame) -> DataFrame:
    """Every value of ``domain`` (ordinal, status) with its count, in order; values outside it are not listed."""
    counts = rows.groupBy(status).agg(F.count("*").alias("n")).withColumnRenamed(status, "status")
    return domain.join(counts, "status", "left").select("ordinal", "status", F.coalesce("n", F.lit(0)).alias("n"))


def backlog(parts: DataFrame, pending: Column, seconds: str) -> DataFrame:
    """Parts not yet done, their seconds (unknown: 0), and how many are unknown. One row even if there are none."""
    return parts.filter(pending).agg(
        F.count("*").alias("parts"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"), F.count_if(F.col(seconds).isNull()).alias("unknown_parts")
    )


def oldest_failed(parts: DataFrame, failed: Column, order: list[str], limit: int) -> DataFrame:
    """The ``limit`` oldest failures with the number of all (ties by the later columns of ``order``). Top-k runs per
    task first; nothing is sorted whole."""
    bad = parts.filter(failed)
    total = bad.agg(F.count("*")).scalar()
    return bad.orderBy(*order).limit(limit).withColumn("failed_total", total)


def counts(**tables: DataFrame) -> DataFrame:
    """Row count of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def speech_metrics(segments: Column, elapsed: Column, duration: Column, text: Column) -> Column:
    """elapsed_s, chars, rtf and speech_ratio of a transcript; ratios are null without a positive duration."""
    speech = F.aggregate(segments, F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), s["end"] - s["start"]))
    total = F.when(duration > 0, duration)
    return F.struct(
        F.round(elapsed, 1).alias("elapsed_s"), F.length(text).alias("chars"), F.round(elapsed / total, 3).alias("rtf"), F.round(F.coalesce(speech, F.lit(0.0)) / total, 3).alias("speech_ratio")
    )


def asr_report(log: DataFrame, day_hours: float = 16.0, limit_hours: float = 24.0, least_percent: float = 10.0) -> DataFrame:
    """Totals over transcription lines (elapsed_s, chars, rtf, speech_ratio): audio length is elapsed / rtf, summed over
    lines with a positive rtf only while elapsed sums over all, as the figures have always been defined. The verdict is
    held below ``least_percent`` of a day, and passes at the limit."""
    d = F.when(F.col("rtf") > 0, F.col("elapsed_s") / F.col("rtf"))
    t = log.filter("elapsed_s IS NOT NULL").agg(
        F.count("*").alias("parts"), F.sum("elapsed_s").alias("elapsed"), F.sum("chars").alias("chars"), F.avg("rtf").alias("mean_rtf"), F.avg("speech_ratio").alias("mean_speech_ratio"), F.coalesce(F.sum(d), F.lit(0.0)).alias("audio")
    )
    coverage = F.when(F.col("audio") > 0, F.col("audio") / (day_hours * 3600) * 100)
    day = F.when(F.col("audio") > 0, F.col("elapsed") / F.col("audio") * day_hours)
    verdict = (
        F.when(F.col("parts") == 0, "NO DATA").when(coverage.isNull() | (coverage < least_percent), "HELD").when(day <= limit_hours, "PASS").otherwise("FAIL")
    )
    code = F.create_map(*[F.lit(x) for x in ("PASS", 0, "FAIL", 6, "NO DATA", 7, "HELD", 8)])
    return t.select("parts", "elapsed", "chars", "mean_rtf", "mean_speech_ratio", "audio", coverage.alias("coverage_percent"), day.alias("day_hours"), verdict.alias("verdict")).withColumn("exit_code", code[F.col("verdict")])


def llm_report(log: DataFrame, day_chunks: int = 18, limit_minutes: float = 30.0) -> DataFrame:
    """Seconds per chunk as a ratio of sums, projected to a day; lines without chunks don't count."""
    t = log.filter("elapsed_s IS NOT NULL AND chunks > 0").agg(F.count("*").alias("sessions"), F.sum("elapsed_s").alias("elapsed"), F.sum("chunks").alias("chunks"))
    per = F.col("elapsed") / F.col("chunks")
    day = per * day_chunks / 60
    return t.select("sessions", "elapsed", "chunks", per.alias("per_chunk"), day.alias("day_minutes"), F.when(F.col("sessions") == 0, "NO DATA").when(day <= limit_minutes, "PASS").otherwise("FAIL").alias("verdict"))


def space_check(seconds: Column, free: Column, used: Column, multiplier: float, margin: int, cap: int, default_seconds: float = 1800.0, rate: int = 32000) -> Column:
    """Struct of expected bytes, ok, and the reason: free below expected * multiplier + margin, or used + expected over cap."""
    expected = (F.greatest(F.lit(0.0), F.coalesce(seconds, F.lit(default_seconds))) * rate).cast("bigint")
    reason = F.when(free.isNull(), "free space unknown").when(free < (expected * multiplier + margin).cast("bigint"), "free space").when(used + expected > cap, "staging cap")
    return F.struct(expected.alias("expected"), reason.isNull().alias("ok"), reason.alias("reason"))


def backoff(retries: Column, waits: list[int]) -> Column:
    """Wait before the next attempt: the n-th of ``waits``, the first below one, the last beyond the end."""
    return F.element_at(F.array(*map(F.lit, waits)), F.least(F.greatest(retries, F.lit(1)), F.lit(len(waits))).cast("int"))


def exact_median(rows: DataFrame, by: str, value: str, bins: int = 1024) -> DataFrame:
    """``by`` and ``median`` of each group, null values left out. Ranks are found in a histogram of ``bins`` equal bins between
    the least and the greatest value, counted map-side; only the values of the one or two bins that hold the middle ranks
    are put in order, so a group's values are never in one task."""
    rows = rows.select(by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    ends = rows.groupBy(by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_total"))
    bin_ = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    dealt = rows.join(ends, by).withColumn("_bin", bin_)
    w = Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.groupBy(by, "_bin", "_total").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    first, last = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    held = counted.filter((F.col("_before") + F.col("_n") >= first) & (F.col("_before") < last)).select(by, "_bin", "_before")
    few = dealt.join(held, [by, "_bin"]).groupBy(by, "_bin", "_before", "_total", "_v").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by, "_bin").orderBy("_v")
    few = few.withColumn("_until", F.col("_before") + F.sum("_n").over(w))
    middle = few.filter((F.col("_until") >= first) & (F.col("_until") - F.col("_n") < last))
    return middle.groupBy(by).agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


# -- queries ----------------------------------------------------------------------------------------------------------

_STATES = ["O", "P", "F", "R", "X"]


def q_status_histogram(spark, sf_dir):
    domain = spark.createDataFrame(list(enumerate(_STATES)), "ordinal int, status string")
    return histogram(load(spark, sf_dir, "orders"), "o_orderstatus", domain)


def q_part_histogram(spark, sf_dir):
    """Orders as parts in the full domain of part states."""
    names = {"O": "RAW_SAVED", "P": "TRANSCRIBING", "F": "FAILED"}
    status = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("o_orderstatus")]
    return histogram(load(spark, sf_dir, "orders").withColumn("status", status), "status", dims.state_table(spark, "part").select("ordinal", "status"))


def q_backlog(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("s", F.when(F.col("o_orderkey") % 10 != 0, F.floor("o_totalprice").cast("double")))
    return backlog(o, F.col("o_orderstatus") != "F", "s")


def q_failed_top_k(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return oldest_failed(e, F.col("event_type") == "error", ["ts", "event_id"], 20)


def q_table_counts(spark, sf_dir):
    return counts(**{t: load(spark, sf_dir, t) for t in ("orders", "customer", "events")})


def _lines(spark, sf_dir):
    """Log lines made of events: one text line and one JSON line of the same fields for each."""
    e = load(spark, sf_dir, "events")
    rtf = F.when(F.col("event_id") % 5 == 0, F.lit("null")).otherwise(F.format_string("%.3f", (F.col("event_id") % 90 + 10) / 1000.0))
    vals = e.select(
        "event_id", F.when(F.col("event_type") == "view", "transcription_completed").when(F.col("event_type") == "click", "llm_completed").otherwise(F.col("event_type")).alias("ev"), (F.floor("value") + 1).cast("int").alias("el"),
        (F.col("event_id") % 1000).alias("ch"), rtf.alias("rtf"), (F.col("event_id") % 4).alias("ck"), "user_id",
    )
    text = F.concat_ws(" ", F.lit("2024-01-01T00:00:00+00:00 INFO"), "ev", F.concat(F.lit("elapsed_s="), "el"), F.concat(F.lit("chars="), "ch"), F.concat(F.lit("rtf="), "rtf"), F.concat(F.lit("chunks="), "ck"), F.concat(F.lit("recording_key=dev/"), "user_id"))
    json = F.concat(F.lit('{"event": "'), "ev", F.lit('", "elapsed_s": '), "el", F.lit(', "chars": '), "ch", F.lit(', "rtf": '), "rtf", F.lit(', "chunks": '), "ck", F.lit(', "recording_key": "dev/'), "user_id", F.lit('"}'))
    return vals.select("event_id", text.alias("text"), json.alias("json"))


def q_log_parse(spark, sf_dir):
    """Both formats through one parser, in one row; ``agree`` says whether they read the same."""
    both = with_parsed(with_parsed(_lines(spark, sf_dir), "text", "t"), "json", "j")
    cols = ["event", "elapsed_s", "chars", "rtf", "chunks", "recording_key"]
    same = F.forall(F.array(*[F.col(f"t.{c}").eqNullSafe(F.col(f"j.{c}")) for c in cols]), lambda x: x)
    return both.select("event_id", *[F.col(f"t.{c}").alias(c) for c in cols], same.alias("agree"))


def _rounded(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def q_perf_report(spark, sf_dir):
    log = parse_lines(_lines(spark, sf_dir).select(F.col("text").alias("line")), "line").filter("event = 'transcription_completed'")
    r = asr_report(log, least_percent=0.0)
    return _rounded(r, ["mean_rtf", "mean_speech_ratio", "audio", "coverage_percent", "day_hours", "elapsed"])


def q_llm_report(spark, sf_dir):
    log = parse_lines(_lines(spark, sf_dir).select(F.col("json").alias("line")), "line").filter("event = 'llm_completed'")
    return _rounded(llm_report(log), ["elapsed", "per_chunk", "day_minutes"])


def q_space_check(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity") - 5).alias("s"), F.col("l_extendedprice").cast("bigint").alias("p"))
    c = space_check(F.col("s"), F.col("p") * 20, F.col("p"), 1.5, 100000, 1500000, default_seconds=30.0)
    return li.select("l_orderkey", "l_linenumber", "s", c.alias("c")).groupBy("l_orderkey").agg(F.sum("c.expected").alias("expected"), F.count_if("c.ok").alias("n_ok"), F.count_if(F.col("c.reason") == "free space").alias("n_free"), F.count_if(F.col("c.reason") == "staging cap").alias("n_cap"))


def q_backoff_clamp(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 2).alias("r"), "l_quantity")
    return li.select("l_orderkey", "l_linenumber", backoff(F.col("r"), [3, 10, 30]).alias("wait"), clamp(F.col("l_quantity"), 10.0, 40.0).alias("timeout"))


def q_median_latency(spark, sf_dir):
    """Cold value (the first by time) and median of the later ones, by event type."""
    e = load(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    first = e.groupBy("event_type").agg(F.min(at).alias("first"), F.min_by("value", at).alias("cold"))
    later = e.join(first.select("event_type", "first"), "event_type").filter(at != F.col("first"))
    return first.join(exact_median(later, "event_type", "value"), "event_type", "left").select("event_type", "cold", F.col("median").alias("warm"))


def q_speech_metrics(spark, sf_dir):
    """Metrics of conversations as transcripts: a segment a turn, some of them with an end before their start."""
    k = F.col("conv_id")
    seg = F.struct("turn", (F.col("turn") * 30).cast("double").alias("start"), (F.col("turn") * 30 + F.length("text") % 40 - 5).cast("double").alias("end"))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"), F.max(F.struct("turn", "text"))["text"].alias("text"))
    m = speech_metrics(F.col("segments"), (k % 100 + 0.25).cast("double"), F.when(k % 9 != 0, F.when(k % 10 == 0, 0.0).otherwise(F.size("segments") * 32.0)), F.col("text"))
    return c.select("conv_id", m.alias("m")).select("conv_id", "m.*")


_PART_CASE = "CASE o_orderstatus WHEN 'O' THEN 'RAW_SAVED' WHEN 'P' THEN 'TRANSCRIBING' ELSE 'FAILED' END"
_LINES = """l AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'transcription_completed' WHEN 'click' THEN 'llm_completed' ELSE event_type END AS ev, CAST(floor(value) + 1 AS DOUBLE) AS el,
  CAST(event_id % 1000 AS BIGINT) AS ch, CASE WHEN event_id % 5 <> 0 THEN CAST((event_id % 90 + 10) / 1000.0 AS DOUBLE) END AS rtf, CAST(event_id % 4 AS BIGINT) AS ck, user_id FROM events)"""

QUERIES = {
    "status_histogram": q_status_histogram,
    "part_state_histogram": q_part_histogram,
    "backlog_summary": q_backlog,
    "failed_top_k": q_failed_top_k,
    "table_counts": q_table_counts,
    "log_parse": q_log_parse,
    "perf_report": q_perf_report,
    "llm_report": q_llm_report,
    "space_check": q_space_check,
    "backoff_clamp": q_backoff_clamp,
    "median_latency": q_median_latency,
    "speech_metrics": q_speech_metrics,
}
ORACLES = {
    "status_histogram": "SELECT CAST(i AS INTEGER) AS ordinal, s AS status, count(o_orderstatus) AS n FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(_STATES)) + ") v(i, s) LEFT JOIN orders ON o_orderstatus = s GROUP BY ALL",
    "part_state_histogram": "SELECT CAST(i AS INTEGER) AS ordinal, s AS status, count(o_orderstatus) AS n FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(dims.PART_STATES)) + f") v(i, s) LEFT JOIN orders ON {_PART_CASE} = s GROUP BY ALL",
    "backlog_summary": "SELECT count(*) AS parts, coalesce(sum(CASE WHEN o_orderkey % 10 <> 0 THEN floor(o_totalprice) END), 0) AS seconds, count(CASE WHEN o_orderkey % 10 = 0 THEN 1 END) AS unknown_parts FROM orders WHERE o_orderstatus <> 'F'",
    "failed_top_k": "SELECT event_id, ts, user_id, event_type, count(*) OVER () AS failed_total FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 20",
    "table_counts": "SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events",
    "log_parse": f"WITH {_LINES} SELECT event_id, ev AS event, el AS elapsed_s, ch AS chars, rtf, ck AS chunks, 'dev/' || user_id AS recording_key, true AS agree FROM l",
    "perf_report": f"""WITH {_LINES}, t AS (SELECT count(*) AS parts, sum(el) AS elapsed, CAST(sum(ch) AS BIGINT) AS chars, avg(rtf) AS mean_rtf, sum(el / rtf) AS audio FROM l WHERE ev = 'transcription_completed')
      SELECT parts, round(elapsed, 6) AS elapsed, chars, round(mean_rtf, 6) AS mean_rtf, CAST(NULL AS DOUBLE) AS mean_speech_ratio, round(audio, 6) AS audio, round(audio / 57600 * 100, 6) AS coverage_percent,
      round(elapsed / audio * 16, 6) AS day_hours, CASE WHEN elapsed / audio * 16 <= 24 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN elapsed / audio * 16 <= 24 THEN 0 ELSE 6 END AS exit_code FROM t""",
    "llm_report": f"""WITH {_LINES}, t AS (SELECT count(*) AS sessions, sum(el) AS elapsed, CAST(sum(ck) AS BIGINT) AS chunks FROM l WHERE ev = 'llm_completed' AND ck > 0)
      SELECT sessions, round(elapsed, 6) AS elapsed, chunks, round(elapsed / chunks, 6) AS per_chunk, round(elapsed / chunks * 18 / 60, 6) AS day_minutes, CASE WHEN elapsed / chunks * 18 / 60 <= 30 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM t""",
    "space_check": """WITH x AS (SELECT l_orderkey, CAST(greatest(0.0, CASE WHEN l_linenumber <> 3 THEN l_quantity - 5 ELSE 30.0 END) * 32000 AS BIGINT) AS e, CAST(trunc(l_extendedprice) AS BIGINT) AS p FROM lineitem),
      r AS (SELECT *, CASE WHEN p * 20 < CAST(trunc(e * 1.5 + 100000) AS BIGINT) THEN 'f' WHEN p + e > 1500000 THEN 'c' END AS why FROM x)
      SELECT l_orderkey, CAST(sum(e) AS BIGINT) AS expected, count(CASE WHEN why IS NULL THEN 1 END) AS n_ok, count(CASE WHEN why = 'f' THEN 1 END) AS n_free, count(CASE WHEN why = 'c' THEN 1 END) AS n_cap FROM r GROUP BY 1""",
    "backoff_clamp": "SELECT l_orderkey, l_linenumber, CAST([3, 10, 30][least(greatest(l_linenumber - 2, 1), 3)] AS INTEGER) AS wait, least(greatest(l_quantity, 10.0), 40.0) AS timeout FROM lineitem",
    "median_latency": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events)
      SELECT event_type, max(CASE WHEN r = 1 THEN value END) AS cold, median(CASE WHEN r > 1 THEN value END) AS warm FROM f GROUP BY 1""",
    "speech_metrics": """WITH c AS (SELECT conv_id, count(*) AS n, sum(greatest(0.0, CAST(length(text) % 40 - 5 AS DOUBLE))) AS sp, arg_max(text, turn) AS t FROM conversations GROUP BY 1),
      d AS (SELECT *, conv_id % 100 + 0.25 AS el, CASE WHEN conv_id % 9 <> 0 AND conv_id % 10 <> 0 THEN n * 32.0::DOUBLE END AS total FROM c)
      SELECT conv_id, round(CAST(el AS DOUBLE), 1) AS elapsed_s, CAST(length(t) AS INTEGER) AS chars, round(CAST(el AS DOUBLE) / total, 3) AS rtf, round(sp / total, 3) AS speech_ratio FROM d""",
}
