"""State from an append-only transition log: folds, legality, recovery, conflicts, streaks and edges."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.functions import dims, keys
from logloom.plans import splittable
from logloom.sources import load


def current_state(log: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Last status of each entity, its count of events and the order of the last: one aggregation, combined map-side."""
    o = F.struct(*order)
    return log.groupBy(key).agg(F.max_by(status, o).alias("status"), F.max(o).alias("last"), F.count("*").alias("n_events")).select(
        key, "status", *[F.col(f"last.{c}").alias(f"last_{c}") for c in order], "n_events"
    )


def last_failure_origin(log: DataFrame, key: str, origin: str, target: str, order: list[str], failed: str, allowed: list[str] | None) -> DataFrame:
    """Where each entity came from when it last failed; ``allowed`` marks the origins that work can resume from."""
    f = log.filter(F.col(target) == failed).groupBy(key).agg(F.max_by(origin, F.struct(*order)).alias("origin"))
    resumable = F.coalesce(F.col("origin").isin(allowed), F.lit(False)) if allowed is not None else F.col("origin").isNotNull()
    return f.withColumn("resumable", resumable)


def retry_count(log: DataFrame, key: str, status: str, order: list[str], failed: str, resets: list[str]) -> DataFrame:
    """Failures of each entity since its last reset, as two map-side aggregations and no window over its history."""
    o = F.struct(*order)
    last = splittable(log.groupBy(key).agg(F.max(F.when(F.col(status).isin(resets), o)).alias("_reset")), "resets")
    fails = log.filter(F.col(status) == failed).join(last, key).filter(F.col("_reset").isNull() | (o > F.col("_reset")))
    n = fails.groupBy(key).agg(F.count("*").alias("retry_count"))
    return last.select(key).join(n, key, "left").select(key, F.coalesce("retry_count", F.lit(0)).cast("bigint").alias("retry_count"))


def with_previous(log: DataFrame, key: str, order: list[str], bucket: Column, name: str, *columns: str) -> DataFrame:
    """Adds ``name``, a struct of ``columns`` of the row before in the same entity (null for the first row).

    Windows are by entity and ``bucket`` (a day, for example; it must not decrease along ``order``), so an entity with a
    third of all rows is many windows. The first row of a bucket takes the last values of the bucket before it, one row an entity
    and bucket, which come from the same sorted rows: one scan and one exchange of the log.
    """
    # The key is a struct, as structs of nulls are equal in joins.
    rows = log.select(F.struct(*[F.col(f"`{c}`") for c in log.columns]).alias("_row"), F.struct(key).alias("_k"), F.struct(bucket.alias("b")).alias("_b"), F.struct(*order).alias("_o"), F.struct(*columns).alias("_v"))
    w = Window.partitionBy("_k", "_b").orderBy(F.col("_o").asc_nulls_first())
    rows = rows.select("_row", "_k", "_b", "_v", F.lag("_v").over(w).alias("_prev"), F.lead(F.lit(True)).over(w).isNull().alias("_last"))
    ends = rows.filter("_last").select("_k", F.lead("_b").over(Window.partitionBy("_k").orderBy("_b")).alias("_b"), F.col("_v").alias("_carried")).filter("_b IS NOT NULL")
    both = rows.join(ends, ["_k", "_b"], "left")
    return both.select("_row.*", F.coalesce("_prev", "_carried").alias(name))


def with_origin(log: DataFrame, key: str, status: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds ``from_status``, the status before each event (null for the first)."""
    found = with_previous(log, key, order, bucket, "_before", status)
    return found.withColumn("from_status", F.col(f"_before.{status}")).drop("_before")


def illegal_transitions(log: DataFrame, legal: DataFrame) -> DataFrame:
    """Events whose (from_status, to_status) is not in ``legal``; births (no from_status) are legal."""
    return log.filter("from_status IS NOT NULL").join(legal, ["from_status", "to_status"], "left_anti")


def conflicts(current: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Compare-and-set: transitions of ``wanted`` (key, from_status, to_status) that don't find the status they expect;
    ``found`` is null for an unknown entity."""
    both = wanted.join(current.select(key, F.col("status").alias("found")), key, "left")
    return both.filter(~F.col("from_status").eqNullSafe(F.col("found")))


def streaks(samples: DataFrame, key: str, value: Column, order: list[str], needed: int, bucket: Column) -> DataFrame:
    """Runs of equal values: ``streak`` counts equal samples in a row, ``stable`` from ``needed`` on.

    Windows are by entity and ``bucket``, as in with_previous; the length of the run that a bucket starts in comes from
    the counts of the buckets before it, one row an entity and bucket.
    """
    found = with_previous(samples.withColumn("_value", value), key, order, bucket, "_before", "_value")
    change = F.col("_before").isNull() | ~F.col("_value").eqNullSafe(F.col("_before._value"))
    rows = found.select(F.struct(*[F.col(f"`{c}`") for c in samples.columns]).alias("_row"), F.col(key).alias("_k"), bucket.alias("_b"), F.struct(*order).alias("_o"), change.alias("_c"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    w = Window.partitionBy("_k", "_b").orderBy(F.col("_o").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.max(F.when(F.col("_c"), F.col("_n"))).over(w)).drop("_c")
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_k", "_b").agg(F.max("_n").alias("_n"), F.max("_at").alias("_at")).withColumn("_total", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ends = ends.withColumn("_carry", F.col("_total") - F.max(F.col("_total") + F.col("_at")).over(before) + 1).filter("_carry IS NOT NULL")
    none = F.lit(None).cast("bigint")
    marks = ends.select(F.lit(None).cast(kinds["_row"]).alias("_row"), "_k", "_b", F.lit(None).cast(kinds["_o"]).alias("_o"), none.alias("_n"), none.alias("_at"), "_carry")
    both = rows.withColumn("_carry", none).unionByName(marks).withColumn("_carry", F.first("_carry").over(w)).filter("_row IS NOT NULL")
    streak = F.when(F.col("_at").isNotNull(), F.col("_n") - F.col("_at") + 1).otherwise(F.col("_n") + F.coalesce("_carry", F.lit(0)))
    return both.select("_row.*", streak.alias("streak")).withColumn("stable", F.col("streak") >= needed)


def rising_edges(snapshots: DataFrame, key: str, size: str, order: list[str], bucket: Column) -> DataFrame:
    """Snapshots that are non-empty after one that was empty, unknown, or none (the start fires always)."""
    found = with_previous(snapshots, key, order, bucket, "_before", size)
    fires = F.col("_before").isNull() | ((F.coalesce(F.col(f"_before.{size}"), F.lit(0)) == 0) & (F.coalesce(F.col(size), F.lit(0)) > 0))
    return found.withColumn("fires", fires).drop("_before")


def first_owners(rows: DataFrame, content: Column, order: list[str], id_col: str) -> DataFrame:
    """For each row the first row of equal content; a null content owns itself. A min-aggregation and a join, so copies
    in any number never meet in one window."""
    keyed = rows.withColumn("_c", content)
    owner = keyed.filter("_c IS NOT NULL").groupBy("_c").agg(F.min_by(id_col, F.struct(*order)).alias("owner"), F.count("*").alias("n_copies"))
    owner = splittable(owner.filter("n_copies > 1"), "owners")
    return keyed.join(owner, "_c", "left").withColumn("owner", F.coalesce("owner", F.col(id_col))).withColumn("n_copies", F.coalesce("n_copies", F.lit(1)))


# -- queries over the driver's tables ---------------------------------------------------------------------------------


def _log(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


ORDER = ["ts", "event_id"]


def q_current_state(spark, sf_dir):
    return current_state(_log(spark, sf_dir), "user_id", "event_type", ORDER)


def q_last_failure_origin(spark, sf_dir):
    log = with_origin(_log(spark, sf_dir), "user_id", "event_type", ORDER, F.to_date("ts"))
    return last_failure_origin(log, "user_id", "from_status", "event_type", ORDER, "error", ["view", "click"])


def q_retry_counter(spark, sf_dir):
    return retry_count(_log(spark, sf_dir), "user_id", "event_type", ORDER, "error", ["purchase"])


_LEGAL = [("signup", "view"), ("signup", "click"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("error", "view")]


def q_illegal_transitions(spark, sf_dir):
    log = with_origin(_log(spark, sf_dir), "user_id", "event_type", ORDER, F.to_date("ts")).withColumnRenamed("event_type", "to_status")
    legal = spark.createDataFrame(_LEGAL, "from_status string, to_status string")
    return illegal_transitions(log, legal).groupBy("from_status", "to_status").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def q_transition_legality(spark, sf_dir):
    """Consecutive order states of customers, read as part states, against the table of legal part transitions."""
    names = {"O": "RAW_SAVED", "P": "SOURCE_DELETING", "F": "COMPLETED"}
    to = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("o_orderstatus")]
    log = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", to.alias("to_status"))
    log = with_origin(log, "o_custkey", "to_status", ["o_orderdate", "o_orderkey"], F.year("o_orderdate"))
    legal = dims.transition_table(spark).filter("entity = 'part'").select("from_status", "to_status")
    return illegal_transitions(log, legal).groupBy("from_status", "to_status").agg(F.count("*").alias("n"))


def q_transition_conflicts(spark, sf_dir):
    now = current_state(_log(spark, sf_dir), "user_id", "event_type", ORDER)
    wanted = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("view").alias("from_status"), F.lit("click").alias("to_status"))
    return conflicts(now, wanted, "user_id")


def q_recovery(spark, sf_dir):
    log = _log(spark, sf_dir)
    names = {"click": "NORMALIZING", "view": "TRANSCRIBING", "signup": "DISCOVERED", "error": "FAILED", "purchase": "RAW_WRITING"}
    status = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    now = current_state(log.withColumn("status", status), "user_id", "status", ORDER)
    return now.select("user_id", "status", dims.recovered("part", F.col("status")).alias("recovered"))


def q_stability_streak(spark, sf_dir):
    found = streaks(_log(spark, sf_dir), "user_id", F.col("event_type"), ORDER, 2, F.to_date("ts"))
    return found.select("event_id", "user_id", "streak", "stable")


def q_rising_edge(spark, sf_dir):
    day = F.to_date("ts")
    snaps = _log(spark, sf_dir).groupBy("user_id", day.alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return rising_edges(snaps, "user_id", "n", ["day"], F.trunc("day", "month")).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "fires")


def q_content_duplicates(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    found = first_owners(docs, F.col("h"), ["doc_id"], "doc_id")
    return found.select("doc_id", "owner", "n_copies", F.when(F.col("owner") != F.col("doc_id"), "DUPLICATE_CONTENT").alias("skip_reason"))


def q_key_slugs(spark, sf_dir):
    """Part keys of pages (host as device, path below it), guarded, with slugs."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    rest = F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1)
    p = load(spark, sf_dir, "pages").select("page_id", "url", keys.part_key(host, rest).alias("part_key"))
    return p.select("page_id", "part_key", keys.slug(F.col("part_key")).alias("slug"), keys.device_of_part(F.col("part_key")).alias("device_id"), keys.relpath_of_part(F.col("part_key")).alias("relpath"))


_WINDOW = "PARTITION BY user_id ORDER BY ts, event_id"
_LAST = f"(SELECT *, lag(event_type) OVER ({_WINDOW}) AS from_status FROM events)"

QUERIES = {
    "current_state": q_current_state,
    "last_failure_origin": q_last_failure_origin,
    "retry_counter": q_retry_counter,
    "illegal_transitions": q_illegal_transitions,
    "transition_legality": q_transition_legality,
    "transition_conflicts": q_transition_conflicts,
    "recovery": q_recovery,
    "stability_streak": q_stability_streak,
    "rising_edge": q_rising_edge,
    "content_duplicates": q_content_duplicates,
    "key_slugs": q_key_slugs,
}
ORACLES = {
    "current_state": """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_ts,
        arg_max(event_id, (ts, event_id)) AS last_event_id, count(*) AS n_events FROM events GROUP BY user_id""",
    "last_failure_origin": f"""SELECT user_id, origin, coalesce(origin IN ('view', 'click'), false) AS resumable FROM
        (SELECT user_id, from_status AS origin, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
         FROM {_LAST} WHERE event_type = 'error') WHERE r = 1""",
    "retry_counter": """WITH last AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN (ts, event_id) END) AS t FROM events GROUP BY user_id)
        SELECT user_id, CAST(count(CASE WHEN event_type = 'error' AND (t IS NULL OR (ts, event_id) > t) THEN 1 END) AS BIGINT) AS retry_count
        FROM events JOIN last USING (user_id) GROUP BY user_id""",
    "illegal_transitions": "SELECT from_status, event_type AS to_status, count(*) AS n, min(event_id) AS first_event FROM "
    + _LAST
    + " WHERE from_status IS NOT NULL AND (from_status, event_type) NOT IN ("
    + ", ".join(f"('{a}', '{b}')" for a, b in _LEGAL)
    + ") GROUP BY ALL",
    "transition_legality": """WITH l AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'RAW_SAVED' WHEN 'P' THEN 'SOURCE_DELETING' ELSE 'COMPLETED' END AS s, o_orderdate, o_orderkey FROM orders),
        t AS (SELECT s AS to_status, lag(s) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_status FROM l)
        SELECT from_status, to_status, count(*) AS n FROM t WHERE from_status IS NOT NULL AND (from_status, to_status) NOT IN
        (('RAW_SAVED','SOURCE_DELETING'),('RAW_SAVED','COMPLETED'),('SOURCE_DELETING','COMPLETED'),('COMPLETED','SOURCE_DELETING')) GROUP BY ALL""",
    "transition_conflicts": """WITH n AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS found FROM events GROUP BY user_id)
        SELECT c_custkey AS user_id, 'view' AS from_status, 'click' AS to_status, found FROM customer LEFT JOIN n ON user_id = c_custkey WHERE found IS DISTINCT FROM 'view'""",
    "recovery": """WITH n AS (SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'click' THEN 'NORMALIZING' WHEN 'view' THEN 'TRANSCRIBING'
        WHEN 'signup' THEN 'DISCOVERED' WHEN 'error' THEN 'FAILED' ELSE 'RAW_WRITING' END AS status FROM events GROUP BY user_id)
        SELECT user_id, status, CASE status WHEN 'NORMALIZING' THEN 'DISCOVERED' WHEN 'TRANSCRIBING' THEN 'NORMALIZED' WHEN 'RAW_WRITING' THEN 'TRANSCRIBED' ELSE status END AS recovered FROM n""",
    "stability_streak": f"""WITH c AS (SELECT event_id, ts, user_id, event_type, CASE WHEN lag(event_type) OVER ({_WINDOW}) = event_type THEN 0 ELSE 1 END AS ch FROM events),
        r AS (SELECT *, sum(ch) OVER ({_WINDOW} ROWS UNBOUNDED PRECEDING) AS run FROM c)
        SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak,
        row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) >= 2 AS stable FROM r""",
    "rising_edge": """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, count(CASE WHEN event_type = 'error' THEN 1 END) AS n FROM events GROUP BY ALL),
        w AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY d) AS b, row_number() OVER (PARTITION BY user_id ORDER BY d) AS r FROM s)
        SELECT user_id, strftime(d, '%Y-%m-%d') AS day, n, r = 1 OR (coalesce(b, 0) = 0 AND n > 0) AS fires FROM w""",
    "content_duplicates": """SELECT doc_id, owner, n_copies, CASE WHEN owner <> doc_id THEN 'DUPLICATE_CONTENT' END AS skip_reason FROM
        (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS owner, count(*) OVER (PARTITION BY sha256(text)) AS n_copies FROM documents)""",
    "key_slugs": """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS d, regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS r FROM pages),
        k AS (SELECT page_id, CASE WHEN d <> '' AND d NOT LIKE '.%' AND r <> '' AND len(list_filter(string_split(r, '/'), lambda x: x = '' OR x LIKE '.%')) = 0
          AND NOT regexp_matches(r, '[\\x00-\\x1f\\x7f]') THEN d || '/' || r END AS part_key, d, r FROM p)
        SELECT page_id, part_key, substring(sha256(part_key), 1, 16) AS slug, CASE WHEN part_key IS NOT NULL THEN d END AS device_id, CASE WHEN part_key IS NOT NULL THEN r END AS relpath FROM k""",
}
