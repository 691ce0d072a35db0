"""State and results kept as versions in a folder: a state folded from what a log has gained, and results computed anew only
where a fingerprint has changed."""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.state import ORDER, current_state
from logloom.plans import shared_path
from logloom.plans.shared import shuffles_freed
from logloom.sources import load

#: Folders that the keys of a result table are dealt to.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Into a place that must be free: of two writers of one version, the second fails."""
    (a, fs), (b, _) = _fs(spark, old), _fs(spark, new)
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(f"{new} was committed by another writer")


# -- state by high-water mark -----------------------------------------------------------------------------------------


def latest_state(spark: SparkSession, path: str) -> tuple[int, int | None, str | None]:
    """Version, high-water mark and folder of the state; 0 and nothing before the first."""
    found = [tuple(map(int, n.split("-")[1:])) for n in _names(spark, path) if n.startswith("state-")]
    if not found:
        return 0, None, None
    version, high = max(found)
    return version, high, f"{path}/state-{version}-{high}"


def advance(spark: SparkSession, path: str, log: DataFrame, seq: str, key: str, status: str, order: list[str]) -> DataFrame:
    """The current state (as operators.state.current_state gives it) of all events of ``log``, as the next version in ``path``: the
    version before, merged with what is above its high-water mark. ``seq`` numbers appends, so a log that is partitioned
    by it is read only in its tail. Nothing new, no new version; events that are appended below the mark are not seen.

    The folder's name holds version and mark, and is renamed into place, so both are committed at once: a run that is lost
    leaves the version before, and repeating it gives the same state.
    """
    version, high, folder = latest_state(spark, path)
    tail = log if high is None else log.filter(F.col(seq) > high)
    top = tail.agg(F.max(seq)).first()[0]
    if top is not None:
        new = current_state(tail, key, status, order)
        if folder is not None:
            last = F.struct(*[f"last_{c}" for c in order])
            both = spark.read.schema(new.schema).parquet(folder).unionByName(new)
            both = both.groupBy(key).agg(F.max_by("status", last).alias("status"), F.max(last).alias("_l"), F.sum("n_events").alias("n_events"))
            new = both.select(key, "status", *[F.col(f"_l.last_{c}").alias(f"last_{c}") for c in order], "n_events")
        made = shared_path(spark, "state")
        with shuffles_freed(spark):
            new.write.parquet(f"{made}/state")
        parent, fs = _fs(spark, path)
        fs.mkdirs(parent)
        folder = f"{path}/state-{version + 1}-{int(top)}"
        _rename(spark, f"{made}/state", folder)
    if folder is None:
        return current_state(log, key, status, order)
    return spark.read.parquet(folder)


# -- results by fingerprint -------------------------------------------------------------------------------------------


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Version, and the folder of each bucket."""
    version = max([int(n[1:-5]) for n in _names(spark, path) if n.startswith("v") and n.endswith(".json")], default=0)
    if not version:
        return 0, {}
    return version, json.loads(spark.read.option("wholetext", True).text(f"{path}/v{version}.json").first()[0])


def stored_results(spark: SparkSession, path: str) -> DataFrame | None:
    """All results of the latest version; None before the first."""
    folders = sorted(set(_manifest(spark, path)[1].values()))
    return spark.read.parquet(*[f"{path}/{f}" for f in folders]).drop("_bucket") if folders else None


def upsert(wanted: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """Results of all rows of ``wanted`` (key, fingerprint, and whatever ``compute`` reads), as the next version in ``path``: where
    a stored result has the same fingerprint it stays, the others are computed (``compute`` keeps key and fingerprint), and keys that are no longer
    wanted go. Returns all results.

    Keys are dealt to ``buckets`` folders. A bucket in which something has changed is written anew, the others keep their
    files; a manifest of at most ``buckets`` entries says which folder holds a bucket, and is renamed into place. Keys are
    unique and not null in ``wanted``.
    """
    spark = wanted.sparkSession
    version, folders = _manifest(spark, path)
    dealt = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = wanted.withColumn("_bucket", dealt)
    old = stored_results(spark, path)
    if old is None:
        changed, touched, kept = rows, [r[0] for r in rows.select("_bucket").distinct().collect()], None
    else:
        had = old.select(key, F.col("fingerprint").alias("_had"))
        both = rows.select(key, "fingerprint").join(had, key, "full")
        differs = both.filter(~F.col("fingerprint").eqNullSafe(F.col("_had")))
        touched = [r[0] for r in differs.select(dealt.alias("b")).distinct().collect()]
        changed = rows.join(had.withColumnRenamed("_had", "fingerprint"), [key, "fingerprint"], "left_anti")
        own = [folders[str(b)] for b in touched if str(b) in folders]
        kept = spark.read.parquet(*[f"{path}/{f}" for f in sorted(set(own))]).join(rows.select(key, "fingerprint"), [key, "fingerprint"], "left_semi") if own else None
    if not touched:
        return old if old is not None else compute(rows.drop("_bucket"))
    new = compute(changed.drop("_bucket")).withColumn("_bucket", dealt)
    if kept is not None:
        new = new.unionByName(kept.withColumn("_bucket", dealt))
    made = f"data-{version + 1}"
    with shuffles_freed(spark):
        new.write.partitionBy("_bucket").parquet(f"{path}/{made}")
    here = {n.split("=")[1] for n in _names(spark, f"{path}/{made}") if n.startswith("_bucket=")}
    after = {b: f for b, f in folders.items() if int(b) not in touched} | {b: f"{made}/_bucket={b}" for b in here}
    temp, _ = _fs(spark, f"{path}/.v{version + 1}.json")
    fs = _fs(spark, path)[1]
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(after, sort_keys=True).encode()))
    out.close()
    _rename(spark, f"{path}/.v{version + 1}.json", f"{path}/v{version + 1}.json")
    found = stored_results(spark, path)
    return compute(rows.drop("_bucket").limit(0)) if found is None else found


# -- queries ----------------------------------------------------------------------------------------------------------

APPENDS = 4


def q_state_incremental(spark, sf_dir):
    """The state of users after the events have come in four appends, each folded into the version before."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.pmod("event_id", F.lit(APPENDS)).alias("append"))
    log, path = shared_path(spark, "event-log"), shared_path(spark, "user-state")
    e.write.partitionBy("append").parquet(log)
    read = spark.read.schema(e.schema).parquet(log)
    for k in range(APPENDS):
        out = advance(spark, path, read.filter(F.col("append") <= k), "append", "user_id", "event_type", ORDER)
    return out


def _summaries(round_: int):
    return lambda rows: rows.select("conv_id", "fingerprint", F.md5(F.concat("said", F.lit("!"))).alias("summary"), F.lit(round_).alias("computed_in"))


def q_results_upsert(spark, sf_dir):
    """Summaries of conversations, and again after one in five has changed, one in seven is gone and one in eleven is new."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))
    said = c.select("conv_id", F.concat_ws("-", "n", "longest").alias("said"))
    changed = F.when(F.col("conv_id") % 5 == 0, F.concat("said", F.lit("+"))).otherwise(F.col("said"))
    path = shared_path(spark, "summaries")
    for k, rows in enumerate((said.filter("conv_id % 11 <> 0"), said.filter("conv_id % 7 <> 0").withColumn("said", changed)), 1):
        out = upsert(rows.withColumn("fingerprint", F.sha2("said", 256)), path, "conv_id", _summaries(k))
    return out


QUERIES = {"state_incremental": q_state_incremental, "results_upsert": q_results_upsert}
ORACLES = {
    "state_incremental": """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_ts, arg_max(event_id, (ts, event_id)) AS last_event_id, CAST(count(*) AS BIGINT) AS n_events FROM events GROUP BY user_id""",
    "results_upsert": """WITH s AS (SELECT conv_id, count(*) || '-' || max(length(text)) || CASE WHEN conv_id % 5 = 0 THEN '+' ELSE '' END AS said FROM conversations WHERE conv_id % 7 <> 0 GROUP BY conv_id)
      SELECT conv_id, sha256(said) AS fingerprint, md5(said || '!') AS summary, CAST(CASE WHEN conv_id % 5 = 0 OR conv_id % 11 = 0 THEN 2 ELSE 1 END AS INTEGER) AS computed_in FROM s""",
}
