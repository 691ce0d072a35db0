"""The store's point and list queries, attribute folds, claims, request checks and health, as plans over tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import dims, keys
from logloom.operators.quality import first_failure, run_rules
from logloom.operators.state import streaks
from logloom.sources import load
from logloom.sources.files import FOLDER, RECORDING


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the filter reaches the scan, where row-group statistics skip what can't hold it."""
    return rows.filter(F.col(key) == value)


def with_status(rows: DataFrame, status: str, wanted: list[str]) -> DataFrame:
    """Rows in some states; whoever reads them in order sorts them (as for the lists below)."""
    return rows.filter(F.col(status).isin(*wanted))


def pending(rows: DataFrame, status: str) -> DataFrame:
    """Work list: everything not in a terminal state (null is not)."""
    return rows.filter(F.coalesce(~F.col(status).isin(*dims.PART_TERMINAL), F.lit(True)))


def ungrouped(rows: DataFrame, session: str) -> DataFrame:
    return rows.filter(F.col(session).isNull())


def history(log: DataFrame, entity: str, key: str, entity_value: str, key_value) -> DataFrame:
    return log.filter((F.col(entity) == entity_value) & (F.col(key) == key_value))


def members(parts: DataFrame, sessions: DataFrame, session: str) -> DataFrame:
    """The parts of some sessions."""
    return parts.join(sessions.select(session), session, "left_semi")


def facts(rows: DataFrame, key: str, value) -> DataFrame:
    """Status, retry count and error of one entity."""
    return by_key(rows, key, value).select("status", "retry_count", "error_code")


def both_entities(parts: DataFrame, sessions: DataFrame, part_key: str, session_key: str, status: str, wanted: list[str]) -> DataFrame:
    """Key, retry count and error of parts and sessions in some states, under one schema."""
    pick = lambda df, k, e: df.filter(F.col(status).isin(*wanted)).select(F.lit(e).alias("entity"), F.col(k).cast("string").alias("key"), "retry_count", "error_code")
    return pick(parts, part_key, "part").unionByName(pick(sessions, session_key, "session"))


def births(new: DataFrame, key: str, status: str, at: Column) -> DataFrame:
    """The first event of each new row, to be appended with it."""
    return new.select(F.col(key).alias("key"), F.lit(None).cast("string").alias("from_status"), F.lit(status).alias("to_status"), at.alias("at"))


def attributes(changes: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Current attributes of each entity: for each column the last value that was set (null leaves it as it is)."""
    o = F.struct(*order)
    return changes.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in columns])


def claims(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Paths that more than one key claims, with the first and how many."""
    return rows.filter(F.col(path).isNotNull()).groupBy(path).agg(F.min(key).alias("first_key"), F.countDistinct(key).alias("n_keys")).filter("n_keys > 1")


def missing_keys(example: DataFrame, configured: DataFrame, key: str) -> DataFrame:
    """Keys of an example configuration that a configuration lacks."""
    return example.select(key).exceptAll(configured.select(key).distinct()).distinct()


def stable_files(samples: DataFrame, key: str, order: list[str], needed: int, old: Column, bucket: Column) -> DataFrame:
    """Samples of file size and mtime: ``passes`` once both were equal ``needed`` times in a row, or the file is old."""
    s = streaks(samples, key, F.struct("size", "mtime"), order, needed, bucket)
    return s.withColumn("passes", F.col("stable") | F.coalesce(old, F.lit(False)))


def request_verdict(requests: DataFrame, files: DataFrame, devices: DataFrame, processed: DataFrame, tolerance_s: int = 2) -> DataFrame:
    """What an executor would make of each delete request: ``reason`` is the first check that fails, null if none;
    ``wait`` where the device is absent (the request stays). Requests: request_id, device_id, partkey, relpath, size,
    mtime; files: device_id, relpath, have_size, have_mtime, symlink."""
    c = F.col
    r = requests.join(processed.select("request_id", F.lit(True).alias("_done")).distinct(), "request_id", "left")
    r = r.join(devices.select("device_id", F.lit(True).alias("_here")).distinct(), "device_id", "left").join(files, ["device_id", "relpath"], "left")
    name, folder = F.substring_index("relpath", "/", -1), F.element_at(F.reverse(F.split("relpath", "/")), F.when(F.size(F.split("relpath", "/")) > 1, 2).otherwise(1))
    filled = (F.length("device_id") > 0) & (F.length("relpath") > 0) & c("size").isNotNull() & c("mtime").isNotNull()
    checks = [
        ("no_request_id", F.length("request_id") > 0), ("request_id_unsafe", c("request_id").rlike(r"^[A-Za-z0-9_-]+$")), ("replayed", c("_done").isNull()), ("malformed_request", filled),
        ("partkey_mismatch", F.concat_ws("/", "device_id", "relpath") == c("partkey")), ("device_absent", c("_here").isNotNull()), ("relpath_unsafe", keys.safe_relpath(c("relpath"))),
        ("target_is_symlink", ~F.coalesce(c("symlink"), F.lit(False))), ("target_missing", c("have_size").isNotNull()), ("filename_rule", name.rlike(RECORDING)), ("folder_rule", folder.rlike(FOLDER)),
        ("size_mismatch", c("have_size") == c("size")), ("mtime_mismatch", F.abs(F.floor("have_mtime") - F.floor("mtime")) < tolerance_s),
    ]
    return r.withColumn("reason", first_failure(checks)).withColumn("wait", F.coalesce(c("reason") == "device_absent", F.lit(False))).drop("_done", "_here")


def health(facts: DataFrame, by: list[str], max_age_s: int) -> DataFrame:
    """The nine health rules over one row of facts an instance; none keeps another from running."""
    c = F.col
    return run_rules(facts, by, [
        ("H-1", F.lit(True), F.lit("process")), ("H-2", c("schema_version").isNotNull(), c("schema_version")), ("H-3", c("data_writable"), F.lit("data")), ("H-4", c("vault_writable") & c("vault_marker"), F.lit("vault")),
        ("H-5", c("recogniser_executable"), F.lit("recogniser")), ("H-6", c("model_present"), F.lit("model")), ("H-7", c("endpoint_set") & c("model_set"), F.lit("endpoint")),
        ("H-8", (c("heartbeat_age_s") <= max_age_s) & (F.coalesce(c("config_error"), F.lit("")) == ""), c("heartbeat_age_s")), ("H-9", c("inbox_writable") & c("queue_writable"), F.lit("queues")),
    ])


# -- queries ----------------------------------------------------------------------------------------------------------


def q_pending_parts(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "TRANSCRIBED").otherwise("SKIPPED").alias("status"))
    return pending(o, "status")


def q_attribute_fold(spark, sf_dir):
    """Last error value, last purchase value and last event of each user, as columns that different events set."""
    e = load(spark, sf_dir, "events")
    ch = e.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", F.col("value")).alias("error_value"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase_value"), F.col("event_type").alias("last_type"))
    return attributes(ch, "user_id", ["error_value", "purchase_value", "last_type"], ["ts", "event_id"])


def q_path_claims(spark, sf_dir):
    return claims(load(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.col("n_chars").cast("string")).alias("path")), "path", "doc_id")


def q_missing_keys(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return missing_keys(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), s, "k")


def q_failed_entities(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 4).alias("retry_count"), F.col("o_orderpriority").alias("error_code"))
    c = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "F").otherwise("O").alias("status"), (F.col("c_custkey") % 4).alias("retry_count"), F.col("c_mktsegment").alias("error_code"))
    return both_entities(o, c, "o_orderkey", "c_custkey", "status", ["F"])


def q_stable_files(spark, sf_dir):
    """Consecutive events of a user as samples of one file: its size is the type's length, its time the hour of day."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.length("event_type").alias("size"), F.floor(F.hour("ts") / 12).alias("mtime"))
    return stable_files(e, "user_id", ["ts", "event_id"], 2, F.col("event_id") % 50 == 0, F.to_date("ts")).select("event_id", "streak", "passes")


def q_request_verdict(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")
    k = F.col("l_partkey") + F.col("l_linenumber")
    name = F.concat(F.lit("TX_MIC001_20240101_000000/TX01_MIC001_20240101_"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 6, "0"), F.when(k % 7 == 0, ".mp3").otherwise("_orig.wav"))
    dev = F.concat(F.lit("d"), (F.col("l_suppkey") % 10).cast("string"))
    rid = F.concat(F.lit("r"), F.when(k % 11 == 0, F.lit("!")).otherwise(F.lit("-")), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    req = li.select("l_orderkey", "l_linenumber", rid.alias("request_id"), dev.alias("device_id"), F.concat(dev, F.lit("/"), name).alias("partkey"), name.alias("relpath"), F.when(k % 13 != 0, F.col("l_quantity").cast("bigint") % 5).alias("size"), F.lit(10.9).alias("mtime"), "l_tax")
    number = F.regexp_extract("relpath", "_([0-9]{6})[._][^_]*$", 1).cast("int")
    files = req.select("device_id", "relpath").distinct().filter(number >= 100).select("device_id", "relpath", F.lit(2).cast("bigint").alias("have_size"), F.lit(11.2).alias("have_mtime"), F.lit(False).alias("symlink"))
    devices = spark.createDataFrame([(f"d{i}",) for i in range(8)], "device_id string")
    done = req.filter("l_tax > 0.065").select("request_id")
    v = request_verdict(req, files, devices, done)
    return v.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason"), "wait").agg(F.count("*").alias("n"))


def _parts(spark, sf_dir):
    """Orders as parts of sessions (customers), with the state they are in."""
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "TRANSCRIBED").otherwise("RAW_SAVED")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("session"), status.alias("status"), (F.col("o_orderkey") % 4).alias("retry_count"), F.when(status == "FAILED", F.col("o_orderpriority")).alias("error_code"), "o_orderdate"
    )


def q_part_lookup(spark, sf_dir):
    """Status, retry count and error of one part; the key reaches the scan."""
    return facts(_parts(spark, sf_dir), "o_orderkey", 7)


def q_session_lookup(spark, sf_dir):
    return by_key(load(spark, sf_dir, "customer"), "c_custkey", 12).select("c_custkey", "c_name")


def q_ungrouped(spark, sf_dir):
    return ungrouped(_parts(spark, sf_dir), "session").select("o_orderkey", "o_orderdate")


def q_session_members(spark, sf_dir):
    """Parts of the sessions of one market segment."""
    some = load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("session"))
    return members(_parts(spark, sf_dir), some, "session").select("session", "o_orderkey", "o_orderdate")


def q_with_status(spark, sf_dir):
    return with_status(_parts(spark, sf_dir), "status", ["TRANSCRIBED", "FAILED"]).select("o_orderkey", "status")


def q_history(spark, sf_dir):
    """The log of one user, as an entity of the kind user."""
    log = load(spark, sf_dir, "events").select(F.lit("user").alias("entity"), "user_id", "event_id", "ts", "event_type")
    return history(log, "entity", "user_id", "user", 3).select("event_id", "ts", "event_type")


def q_births(spark, sf_dir):
    """First events of parts that have a label and that no earlier one had."""
    new = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return births(new, "doc_id", "DISCOVERED", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def q_schema_version(spark, sf_dir):
    """Schema versions as the log records them: the current one, and how many were applied."""
    v = load(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("version"))
    return v.agg(F.max("version").alias("current"), F.count("*").alias("applied"))


def q_schema_drift(spark, sf_dir):
    """How the orders table differs from a schema that has another type, a column more and one fewer."""
    from logloom.operators.quality import drift

    found = drift(load(spark, sf_dir, "orders"), "o_orderkey bigint, o_custkey int, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_comment string")
    return spark.createDataFrame([(x,) for x in found], "difference string")


def q_migration(spark, sf_dir):
    """Orders taken through the steps that are newer than their schema version, after a snapshot of the table."""
    from logloom.sources.sinks import migrate

    steps = {2: lambda df: df.withColumn("year", F.year("o_orderdate")), 3: lambda df: df.withColumnRenamed("o_orderstatus", "status"), 1: lambda df: df.drop("o_orderkey")}
    kept, now, version = migrate(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), 1, steps, "orders")
    old = kept.groupBy("o_orderstatus").agg(F.count("*").alias("n_before"))
    new = now.groupBy(F.col("status").alias("o_orderstatus")).agg(F.count("*").alias("n"), F.max("year").alias("last_year"))
    return new.join(old, "o_orderstatus").withColumn("version", F.lit(version))


def q_path_roots(spark, sf_dir):
    """Paths of pages against the root that they must stay below."""
    k = F.col("page_id")
    path = F.concat(F.when(k % 5 == 0, "/data/../").when(k % 5 == 1, "/database/").when(k % 5 == 2, "").otherwise("/data/"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("p"), k.cast("string"))))
    return load(spark, sf_dir, "pages").select("page_id", keys.under_root("/data", F.when(k % 11 != 0, path)).alias("inside"))


def q_health(spark, sf_dir):
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    facts = s.select(
        "s_suppkey", F.when(k % 5 != 0, 3).alias("schema_version"), (k % 2 == 0).alias("data_writable"), F.when(k % 3 != 0, True).alias("vault_writable"), F.lit(True).alias("vault_marker"), (k % 7 != 0).alias("recogniser_executable"),
        F.lit(True).alias("model_present"), (k % 11 != 0).alias("endpoint_set"), F.lit(True).alias("model_set"), F.when(k % 13 != 0, k % 4 * 30).alias("heartbeat_age_s"), F.when(k % 17 == 0, "bad").alias("config_error"), F.lit(True).alias("inbox_writable"), F.lit(None).cast("boolean").alias("queue_writable"),
    )
    return health(facts, ["s_suppkey"], 60).select("s_suppkey", "rule", "ok")


QUERIES = {
    "pending_parts": q_pending_parts,
    "attribute_fold": q_attribute_fold,
    "path_claims": q_path_claims,
    "missing_config_keys": q_missing_keys,
    "failed_entities": q_failed_entities,
    "stable_files": q_stable_files,
    "request_verdict": q_request_verdict,
    "health_rules": q_health,
    "part_lookup": q_part_lookup,
    "session_lookup": q_session_lookup,
    "ungrouped_parts": q_ungrouped,
    "session_members": q_session_members,
    "parts_with_status": q_with_status,
    "entity_history": q_history,
    "births": q_births,
    "schema_version": q_schema_version,
    "schema_drift": q_schema_drift,
    "migration": q_migration,
    "path_roots": q_path_roots,
}
_P = "CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'TRANSCRIBED' ELSE 'RAW_SAVED' END"
ORACLES = {
    "pending_parts": "SELECT o_orderkey, o_orderdate, 'TRANSCRIBED' AS status FROM orders WHERE o_orderstatus = 'P'",
    "attribute_fold": """SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN value END, (ts, event_id)) FILTER (event_type = 'error') AS error_value,
      arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS purchase_value, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1""",
    "path_claims": "SELECT lang || '/' || source || '/' || n_chars AS path, min(doc_id) AS first_key, count(DISTINCT doc_id) AS n_keys FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
    "missing_config_keys": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier",
    "failed_entities": """SELECT 'part' AS entity, CAST(o_orderkey AS VARCHAR) AS key, o_orderkey % 4 AS retry_count, o_orderpriority AS error_code FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT 'session', CAST(c_custkey AS VARCHAR), c_custkey % 4, c_mktsegment FROM customer WHERE c_acctbal < 0""",
    "stable_files": """WITH s AS (SELECT event_id, ts, user_id, (length(event_type), hour(ts) // 12) AS v FROM events), c AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS ch FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c), k AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM r)
      SELECT event_id, streak, streak >= 2 OR event_id % 50 = 0 AS passes FROM k""",
    "request_verdict": """WITH l AS (SELECT *, l_partkey + l_linenumber AS k, l_suppkey % 10 AS d, l_partkey % 1000 AS p,
        bool_or(l_tax > 0.065::DOUBLE) OVER (PARTITION BY l_orderkey, l_linenumber, (l_partkey + l_linenumber) % 11 = 0) AS done FROM lineitem),
      v AS (SELECT CASE WHEN k % 11 = 0 THEN 'request_id_unsafe' WHEN done THEN 'replayed' WHEN k % 13 = 0 THEN 'malformed_request' WHEN d >= 8 THEN 'device_absent'
        WHEN p < 100 THEN 'target_missing' WHEN k % 7 = 0 THEN 'filename_rule' WHEN CAST(trunc(l_quantity) AS BIGINT) % 5 <> 2 THEN 'size_mismatch' ELSE 'ok' END AS reason FROM l)
      SELECT reason, reason = 'device_absent' AS wait, count(*) AS n FROM v GROUP BY 1, 2""",
    "health_rules": """WITH s AS (SELECT s_suppkey, s_suppkey AS k FROM supplier) SELECT s_suppkey, unnest(['H-1','H-2','H-3','H-4','H-5','H-6','H-7','H-8','H-9']) AS rule,
      unnest([true, k % 5 <> 0, k % 2 = 0, k % 3 <> 0, k % 7 <> 0, true, k % 11 <> 0, k % 13 <> 0 AND k % 4 * 30 <= 60 AND k % 17 <> 0, false]) AS ok FROM s""",
    "part_lookup": f"SELECT {_P} AS status, o_orderkey % 4 AS retry_count, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS error_code FROM orders WHERE o_orderkey = 7",
    "session_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 12",
    "ungrouped_parts": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 7 = 0",
    "session_members": "SELECT o_custkey AS session, o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "parts_with_status": f"SELECT o_orderkey, {_P} AS status FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "entity_history": "SELECT event_id, ts, event_type FROM events WHERE user_id = 3",
    "births": "SELECT doc_id AS key, CAST(NULL AS VARCHAR) AS from_status, 'DISCOVERED' AS to_status, TIMESTAMP '2024-01-01' AS \"at\" FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "schema_version": "SELECT max(r_regionkey + 1) AS current, count(*) AS applied FROM region",
    "schema_drift": "SELECT unnest(['extra o_orderpriority', 'missing o_comment', 'o_custkey is bigint, not int']) AS difference",
    "migration": "SELECT o_orderstatus, count(*) AS n, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year, count(*) AS n_before, 3::INTEGER AS version FROM orders GROUP BY 1",
    "path_roots": "SELECT page_id, page_id % 11 <> 0 AND page_id % 5 IN (3, 4) AND page_id % 7 <> 0 AS inside FROM pages",
}
