"""Requests and their results as two streams: completed, refused, or timed out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.sources import load
from logloom.streaming.runs import fed


def outcomes(requests: DataFrame, results: DataFrame, timeout_s: int) -> DataFrame:
    """``request_id``, its ``requested_at`` and ``outcome``: that of its result if it comes within ``timeout_s`` seconds, else
    timed_out. Results without a request, and those that come later, have no row.

    ``requests`` has request_id and requested_at, ``results`` request_id, outcome and answered_at, both with a watermark
    on their time. Spark keeps a request until the watermark says that no result can come in time any more, and a result
    until no request can: the state is that of the last ``timeout_s`` seconds and not of all requests.
    """
    r = results.withColumnRenamed("request_id", "_id")
    in_time = F.expr(f"_id = request_id AND answered_at >= requested_at AND answered_at <= requested_at + INTERVAL {timeout_s} SECONDS")
    return requests.join(r, in_time, "leftOuter").select("request_id", "requested_at", F.coalesce("outcome", F.lit("timed_out")).alias("outcome"))


# -- query ------------------------------------------------------------------------------------------------------------

TIMEOUT, WAVES = 3600, 4
_ANSWER = "event_id * 37 % 7200"


def q_request_outcomes(spark, sf_dir):
    """Views and clicks as requests, of which two of three are answered, some too late; fed in the order of time, and at last a
    tick of the clock, by which everything is decided."""
    e = load(spark, sf_dir, "events").filter("event_type IN ('view', 'click')").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    asked = e.select(F.lit("request").alias("kind"), F.col("event_id").alias("request_id"), F.lit(None).cast("string").alias("outcome"), F.col("ts").alias("at"))
    told = e.filter("event_id % 3 <> 0").select(
        F.lit("result").alias("kind"), F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 5 == 0, "refused").otherwise("completed").alias("outcome"),
        (F.col("ts") + F.make_dt_interval(secs=F.expr(f"CAST({_ANSWER} AS DECIMAL(18, 6))"))).alias("at"),
    )
    rows = asked.unionByName(told)
    first, last = rows.agg(F.min(F.unix_seconds("at")), F.max(F.unix_seconds("at"))).first()
    ticks = rows.agg(F.max("at").alias("at")).filter("at IS NOT NULL").select(F.explode(F.array(F.lit("request"), F.lit("result"))).alias("kind"), F.lit(-1).cast("bigint").alias("request_id"), F.lit(None).cast("string").alias("outcome"), (F.col("at") + F.expr(f"INTERVAL {4 * TIMEOUT} SECONDS")).alias("at"))
    wave = F.when(F.col("request_id") < 0, WAVES).otherwise(F.least(F.floor((F.unix_seconds("at") - (first or 0)) * WAVES / max(1, (last or 0) - (first or 0))), F.lit(WAVES - 1)))

    def build(s: DataFrame) -> DataFrame:
        requests = s.filter("kind = 'request'").select("request_id", F.col("at").alias("requested_at")).withWatermark("requested_at", "5 minutes")
        results = s.filter("kind = 'result'").select("request_id", "outcome", F.col("at").alias("answered_at")).withWatermark("answered_at", "5 minutes")
        return outcomes(requests, results, TIMEOUT)

    out = fed(rows.unionByName(ticks), wave, WAVES + 1, build, "outcomes")
    return out.filter("request_id >= 0").select("request_id", F.col("requested_at").cast("timestamp_ntz").alias("requested_at"), "outcome")


QUERIES = {"stream_request_outcomes": q_request_outcomes}
ORACLES = {
    "stream_request_outcomes": f"""SELECT event_id AS request_id, ts AS requested_at, CASE WHEN event_id % 3 = 0 OR {_ANSWER} > {TIMEOUT} THEN 'timed_out' WHEN event_id % 5 = 0 THEN 'refused' ELSE 'completed' END AS outcome
      FROM events WHERE event_type IN ('view', 'click')""",
}
