"""Gap-and-island blocks over intervals whose ends may be unknown."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.plans import Scratch
from logloom.sources import load


def gap_blocks(df: DataFrame, key: str, start: str, end: str, gap_s: int, tie: str, bucket: Column | None = None) -> DataFrame:
    """Adds ``block`` (1-based per key): a part opens a block if the part before it has no known end, or if it
    starts strictly more than ``gap_s`` seconds after the running maximum of the ends before it.

    An unknown end counts as its start in the running maximum, and the maximum restarts behind it. ``start`` is never null.
    Windows are by key and ``bucket`` of the start (its day, unless given; it must not decrease along the start), so a key with a
    third of all parts is many windows. A bucket is summed up in one row: the latest end behind its last unknown one, and
    whether it has an unknown one; these sums compose along the buckets of a key, and say which end each bucket starts from. So do
    the blocks opened in the buckets before. One exchange of the parts, and one written table.
    """
    tables = Scratch(df.sparkSession, "gap-blocks")
    at = F.coalesce(F.col(end), F.col(start))
    # Keys are structs, as structs of nulls are equal in joins.
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.struct(key).alias("_k"), F.struct((F.to_date(start) if bucket is None else bucket).alias("b")).alias("_b"),
        F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(tie).alias("t")).alias("_o"), F.col(start).alias("_start"), at.alias("_at"), F.col(end).isNull().alias("_unknown"),
    )
    order = [F.col("_o.s").asc(), F.col("_o.e").asc_nulls_first(), F.col("_o.t").asc()]
    w = Window.partitionBy("_k", "_b").orderBy(*order)
    seg = F.coalesce(F.count_if("_unknown").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("_k", "_b", "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_seg", seg).withColumn("_reach", F.max("_at").over(within)).withColumn("_last", F.lead(F.lit(True)).over(w).isNull())
    # The end that a bucket leaves to the next: null behind an unknown one.
    left = F.when(~F.col("_unknown"), F.greatest("_reach", "_at"))
    along = Window.partitionBy("_k").orderBy("_b")
    ends = rows.filter("_last").select("_k", "_b", left.alias("_left"), ((F.col("_seg") > 0) | F.col("_unknown")).cast("int").alias("_cut"))
    ends = ends.withColumn("_run", F.sum("_cut").over(along))
    ends = ends.withColumn("_until", F.max("_left").over(Window.partitionBy("_k", "_run").orderBy("_b")))
    ends = ends.select("_k", "_b", F.lag("_until").over(along).alias("_carried"))
    both = rows.join(ends, ["_k", "_b"])
    running = F.when(F.col("_seg") == 0, F.greatest("_reach", "_carried")).otherwise(F.col("_reach"))
    opens = running.isNull() | (_seconds("_start") - _seconds_of(running) > gap_s)
    both = both.withColumn("_opens", opens.cast("int")).withColumn("_here", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = tables.written(both.select("_row", "_k", "_b", "_here"), "opened")
    opened = both.groupBy("_k", "_b").agg(F.max("_here").alias("_n"))
    opened = opened.select("_k", "_b", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return both.join(opened, ["_k", "_b"]).select("_row.*", (F.col("_here") + F.col("_before")).cast("bigint").alias("block"))


def _seconds_of(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def _seconds(name: str) -> Column:
    return _seconds_of(F.col(name))


def _event_parts(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(
        "user_id", "event_id", F.col("ts").alias("started_at"),
        F.when(F.col("event_type") != "error", (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.pmod("event_id", F.lit(7200)).cast("decimal(18,6)"))).cast("timestamp_ntz")).alias("ended_at"),
    )


def q_gap_blocks(spark, sf_dir):
    parts = gap_blocks(_event_parts(spark, sf_dir), "user_id", "started_at", "ended_at", 21600, "event_id")
    return parts.groupBy("user_id", "block").agg(
        F.count("*").alias("n_parts"),
        F.min("started_at").alias("first_start"),
        F.max(F.coalesce("ended_at", "started_at")).alias("last_end"),
    )


QUERIES = {"gap_blocks": q_gap_blocks}
ORACLES = {
    "gap_blocks": """
WITH p AS (SELECT user_id, event_id, ts AS started_at,
        CASE WHEN event_type <> 'error' THEN ts + to_seconds(event_id % 7200) END AS ended_at FROM events),
 s AS (SELECT *, COALESCE(SUM(CASE WHEN ended_at IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
        ORDER BY started_at, ended_at NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM p),
 m AS (SELECT *, MAX(COALESCE(ended_at, started_at)) OVER (PARTITION BY user_id, seg
        ORDER BY started_at, ended_at NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM s),
 b AS (SELECT *, SUM(CASE WHEN run IS NULL OR started_at > run + INTERVAL 21600 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
        ORDER BY started_at, ended_at NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS block FROM m)
SELECT user_id, CAST(block AS BIGINT) AS block, COUNT(*) AS n_parts, MIN(started_at) AS first_start,
       MAX(COALESCE(ended_at, started_at)) AS last_end
FROM b GROUP BY user_id, block"""
}
