"""Decision tables: what may be deleted and why not, what a delete result means, which locks hold. Decisions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import dims, keys
from logloom.sources import load


def sure(c: Column) -> Column:
    """A tri-state condition as a plain one: unknown is false."""
    return F.coalesce(c, F.lit(False))


def locks(config: Column, helper: Column, reaper: Column, readonly: Column) -> Column:
    """Struct of lock1, enabled, and the mount as text: all locks must be known to be open."""
    lock1 = sure(config) & sure(helper)
    mount = F.when(readonly.isNull(), "unknown").when(readonly, "readOnly").otherwise("writable")
    return F.struct(lock1.alias("lock1"), (lock1 & sure(reaper) & sure(~readonly)).alias("enabled"), mount.alias("mount"))


def newer(generated_at: Column, completed_at: Column) -> Column:
    """Whether an inventory is newer than a result; unknown if either is."""
    return generated_at > completed_at


def stale(age: Column, most: int) -> Column:
    return F.coalesce(age > most, F.lit(True))


def preserved(parts: DataFrame) -> Column:
    """Text kept in note and transcript. Columns: raw_output_path, note_ok, in_note, status, transcript_path, transcript_ok."""
    c = F.col
    return sure(
        c("raw_output_path").isNotNull() & sure(c("note_ok")) & sure(c("in_note")) & c("status").isin(*dims.PART_DELETABLE) & c("transcript_path").isNotNull() & sure(c("transcript_ok"))
    )


def deletable(parts: DataFrame, inventory: DataFrame, readonly: Column, delete_source: bool, delete_skipped: bool) -> DataFrame:
    """``parts`` with ``eligible`` and ``reason``, the first condition that fails (null if eligible).

    Parts (joined with their sessions): partkey, device_id, source_path, source_size, source_mtime, session_key,
    own_session_key, status, error_code, duplicate_of, transcript_path, transcript_ok, raw_output_path, note_ok, in_note.
    ``inventory`` holds (device_id, relpath) of files on connected devices. The twin of a duplicate is the part that it
    names, must be another, linked to its session, and preserved itself. The plain conditions come first and are
    filters on columns; the inventory and twin lookups are equi-joins.
    """
    c = F.col
    here = inventory.select("device_id", F.col("relpath").alias("source_path"), F.lit(True).alias("_listed")).distinct()
    p = parts.withColumn("_kept", preserved(parts))
    twins = p.filter(c("session_key") == c("own_session_key")).select(F.col("partkey").alias("duplicate_of"), F.col("_kept").alias("_twin_kept"))
    p = p.join(here, ["device_id", "source_path"], "left").join(twins, "duplicate_of", "left")
    backed = (
        F.when(c("error_code") == "NO_SPEECH_DETECTED", sure(c("transcript_ok")))
        .when(c("error_code") == "DUPLICATE_CONTENT", sure(c("_twin_kept")) & sure(c("duplicate_of") != c("partkey"))).otherwise(False)
    )
    nothing = F.lit(delete_skipped) & sure(c("status") == "SKIPPED") & sure(c("error_code").isin(*dims.DELETABLE_SKIP_REASONS)) & backed
    reason = (
        F.when(F.lit(not delete_source), "deletion is off").when(~sure(~readonly), "mount is not known to be writable").when(~sure(c("session_key") == c("own_session_key")), "not of this session")
        .when(F.coalesce(c("source_path"), F.lit("")) == "", "no source path").when(~keys.safe_relpath(c("source_path")), "unsafe path")
        .when(~sure(keys.part_key(c("device_id"), c("source_path")) == c("partkey")), "key does not match path").when(c("_listed").isNull(), "not on a connected device")
        .when(c("source_size").isNull() | c("source_mtime").isNull(), "size or time unknown")
        .when(~(c("_kept") | nothing), F.when(sure(c("status") == "SKIPPED"), "skip reason is not backed").otherwise("text is not preserved"))
    )
    return p.withColumn("reason", reason).withColumn("eligible", c("reason").isNull()).drop("_kept", "_listed", "_twin_kept")


def missing_sources(parts: DataFrame, inventory: DataFrame, known: Column) -> DataFrame:
    """Parts whose source an inventory lacks; none if there is no inventory (``known`` is false)."""
    listed = inventory.select("device_id", F.col("relpath").alias("source_path"))
    has_path = F.coalesce(F.col("source_path"), F.lit("")) != ""
    return parts.filter(has_path & sure(known)).join(listed, ["device_id", "source_path"], "left_anti")


def result_outcomes(results: DataFrame, parts: DataFrame, listed: DataFrame, generated_at: Column) -> DataFrame:
    """What to do with each delete result: keep, discard, wait, pending or completed, first rule that holds. ``listed``
    has the part keys still on devices; a null ``generated_at`` means that the inventory can't be read."""
    p = parts.select("partkey", F.col("status").alias("part_status"), "delete_request_id", F.lit(True).alias("_known"))
    j = results.join(p, "partkey", "left").join(listed.select("partkey", F.lit(True).alias("_there")).distinct(), "partkey", "left")
    waits = F.col("delete_request_id").isNotNull() & F.col("part_status").isin("SOURCE_DELETING", "SKIPPED")
    deleted = F.col("status") == "DELETED"
    outcome = (
        F.when(F.col("_known").isNull(), "keep: unknown part").when(~sure(waits), "discard: not waiting").when(F.col("delete_request_id") != F.col("request_id"), "discard: another request")
        .when(sure(deleted) & sure(~newer(generated_at, F.col("completed_at"))), "wait: inventory is older").when(~sure(deleted), "pending: not deleted")
        .when(generated_at.isNull() | F.col("_there").isNotNull(), "pending: still listed").otherwise("completed")
    )
    return j.withColumn("outcome", outcome).drop("_known", "_there")


def delete_plan(sessions: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Sessions with how many parts could go, and why the others can't: ``parts`` has eligible and reason."""
    return sessions.join(parts.groupBy(key).agg(F.count_if("eligible").alias("n_eligible"), F.count_if(~F.col("eligible")).alias("n_skipped"), F.min("reason").alias("first_reason")), key)


def request_id(key: Column, now: Column) -> Column:
    """Time, slug of the key and six digits of a hash of both: the same request again has the same id."""
    stamp = F.date_format(now, "yyyyMMdd'T'HHmmss")
    return F.concat_ws("-", stamp, keys.slug(key), F.substring(F.sha2(F.concat(stamp, key), 256), 1, 6))


def valid_request_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]+$"), F.lit(False))


def timed_out(requested_at: Column, now: Column, limit_s: int) -> Column:
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(requested_at) > limit_s, F.lit(False))


def requeueable(code: Column, origin: Column, entity: str) -> Column:
    """A failed entity goes back to where it failed, if its error may be retried and work can resume there."""
    return F.when(dims.retryable(code) & sure(origin.isin(*dims.RETRYABLE_ORIGINS[entity])), origin)


#: Stages that read what the helper reports; all others go on without it.
HELPER_STAGES = ("find_parts", "decide_deletions", "settle_skips", "retry_failed")
STAGES = ("find_parts", "close_sessions", "transcribe_parts", "index_notes", "analyze_sessions", "decide_deletions", "settle_skips", "retry_failed")


def gated_stages(helpers: DataFrame, age: str, most: int) -> DataFrame:
    """``helpers`` times the stages in order, with ``runs``: a stale or unknown heartbeat stops only what depends on it."""
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("stage"), (~stale(F.col(age), most) | F.lit(s not in HELPER_STAGES)).alias("runs")) for i, s in enumerate(STAGES)])
    return helpers.select("*", F.inline(each))


# -- queries ----------------------------------------------------------------------------------------------------------

_STATES = ["RAW_SAVED", "COMPLETED", "SKIPPED", "FAILED", "SOURCE_DELETING"]
_CODES = ["NO_SPEECH_DETECTED", "DUPLICATE_CONTENT", "SOURCE_MISSING"]


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _order_parts(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    status = _pick(_STATES, k % 5)
    dev = F.concat(F.lit("dev"), (F.col("o_custkey") % 50).cast("string"))
    path = F.when(k % 53 == 0, F.lit(None)).when(k % 59 == 0, F.concat(F.lit("../"), k.cast("string"))).otherwise(F.concat(F.lit("f/"), k.cast("string"), F.lit(".wav")))
    return o.select(
        F.when(k % 61 == 0, F.concat(F.lit("x/"), k.cast("string"))).otherwise(F.concat(dev, F.lit("/f/"), k.cast("string"), F.lit(".wav"))).alias("partkey"), dev.alias("device_id"), path.alias("source_path"),
        F.when(k % 67 != 0, F.floor("o_totalprice").cast("bigint")).alias("source_size"), F.lit(1.0).alias("source_mtime"), F.concat(dev, F.lit(":s")).alias("session_key"),
        F.when(k % 71 != 0, F.concat(dev, F.lit(":s"))).alias("own_session_key"), status.alias("status"), F.when(status == "SKIPPED", _pick(_CODES, F.floor(k / 5) % 3)).alias("error_code"),
        F.when((status == "SKIPPED") & (F.floor(k / 5) % 3 == 1), F.concat(F.lit("dev"), ((F.col("o_custkey")) % 50).cast("string"), F.lit("/f/"), (k - 2).cast("string"), F.lit(".wav"))).alias("duplicate_of"),
        F.when(k % 11 != 0, F.lit("t")).alias("transcript_path"), F.when(k % 13 != 0, k % 17 != 0).alias("transcript_ok"), F.lit("n").alias("raw_output_path"), F.when(k % 19 != 0, F.lit(True)).alias("note_ok"), (k % 23 != 0).alias("in_note"),
        k.alias("o_orderkey"),
    )


def q_eligibility_matrix(spark, sf_dir):
    p = _order_parts(spark, sf_dir)
    listed = load(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").select(F.concat(F.lit("dev"), (F.col("o_custkey") % 50).cast("string")).alias("device_id"), F.concat(F.lit("f/"), F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("relpath"))
    return deletable(p, listed, F.lit(False), True, True).select("o_orderkey", "eligible", "reason")


def q_lock_states(spark, sf_dir):
    """All combinations of four tri-state inputs, counted over lineitem so that each occurs."""
    t = lambda n: F.when(F.col("k") / n % 3 < 1, True).when(F.col("k") / n % 3 < 2, False)
    k = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 81).alias("k"))
    x = k.select(locks(t(1), t(3), t(9), t(27)).alias("l"))
    return x.groupBy("l.lock1", "l.enabled", "l.mount").agg(F.count("*").alias("n"))


def q_result_outcomes(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    key = F.concat(F.lit("u/"), F.col("user_id").cast("string"))
    results = e.filter("event_type = 'purchase'").select("event_id", key.alias("partkey"), F.concat(F.lit("r"), (F.col("event_id") % 2).cast("string")).alias("request_id"), F.when(F.col("event_id") % 3 == 0, "REJECTED").otherwise("DELETED").alias("status"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("completed_at"))
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"), "quality")
    users = load(spark, sf_dir, "events").select("user_id").distinct().join(labels.select("user_id"), "user_id", "left_semi")
    parts = users.select(key.alias("partkey"), F.when(F.col("user_id") % 4 == 0, "RAW_SAVED").otherwise("SOURCE_DELETING").alias("status"), F.when(F.col("user_id") % 7 != 0, F.lit("r1")).alias("delete_request_id"))
    listed = users.join(labels.filter("quality = 1"), "user_id", "left_semi").select(key.alias("partkey"))
    return result_outcomes(results, parts, listed, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id", "outcome")


def q_missing_sources(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.lit("d").alias("device_id"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("source_path"))
    inv = load(spark, sf_dir, "labels").select(F.lit("d").alias("device_id"), F.col("doc_id").cast("string").alias("relpath"))
    return missing_sources(d, inv, F.lit(True)).select("doc_id")


def q_delete_plan(spark, sf_dir):
    p = _order_parts(spark, sf_dir)
    d = deletable(p, p.select("device_id", F.col("source_path").alias("relpath")).filter("relpath IS NOT NULL"), F.lit(False), True, False)
    s = p.select("session_key").distinct()
    return delete_plan(s, d.select("session_key", "eligible", "reason"), "session_key")


def q_retry_policy(spark, sf_dir):
    """Errors of failed events against the policy table: retryable, counted, and where work resumes."""
    codes = [e[1] for e in dims.errors()] + ["NO_SUCH_CODE"]
    e = load(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", _pick(codes, F.col("event_id") % len(codes)).alias("error_code"), _pick(["NORMALIZING", "DISCOVERED", "RAW_WRITING", "SAVED"], F.col("event_id") % 4).alias("origin"))
    t = F.broadcast(dims.error_table(spark))
    e = e.withColumn("to_status", requeueable(F.col("error_code"), F.col("origin"), "part")).withColumn("counts", dims.counts_against_attempts(F.col("error_code")))
    return e.join(t, "error_code", "left").select("event_id", "error_code", F.coalesce("retry", F.lit("none")).alias("retry"), "counts", "to_status")


def q_source_gating(spark, sf_dir):
    """Helpers by supplier with an age of zero to nine minutes, or none."""
    k = F.col("s_suppkey")
    helpers = load(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 7 != 0, k % 10 * 60).alias("age_s"))
    return gated_stages(helpers, "age_s", 300).select("s_suppkey", "stage", "runs")


def q_staleness(spark, sf_dir):
    """Inventories against results, ages against a limit, and requests against their time-out."""
    e = load(spark, sf_dir, "events")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    at = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    return e.select("event_id", newer(now, at).alias("newer"), stale(F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 100), 60).alias("stale"), timed_out(at.cast("timestamp"), now.cast("timestamp"), 86400).alias("timed_out"))


def q_request_ids(spark, sf_dir):
    """Ids of delete requests, that they are valid, and what of them is a hash."""
    o = load(spark, sf_dir, "orders")
    key = F.concat(F.lit("dev/"), F.col("o_orderkey").cast("string"), F.lit(".wav"))
    rid = request_id(key, F.col("o_orderdate"))
    return o.select("o_orderkey", rid.alias("request_id"), valid_request_id(rid).alias("valid"))


def q_redacted(spark, sf_dir):
    """Log values of events: secret ones by length, long ones cut."""
    from logloom.functions import text

    e = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "token").otherwise("text").alias("key"), "text")
    return e.select("doc_id", "key", F.md5(text.redact(F.col("key"), F.col("text"), ["token", "password"])).alias("shown_md5"))


def q_state_flags(spark, sf_dir):
    """Order parts by the sets that their state is in. They are counted by state first: the table of the states has no known
    size, so a join of the parts with it would send all parts of a state to one task."""
    n = _order_parts(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    flags = ["terminal", "deletable", "awaiting_deletion", "staging_disposable", "note_member", "retry_reset", "in_progress"]
    return n.join(F.broadcast(dims.state_table(spark, "part")), "status").select("status", *flags, "n")


_PARTS = """p AS (SELECT o_orderkey AS k, 'dev' || (o_custkey % 50) AS dev, ['RAW_SAVED','COMPLETED','SKIPPED','FAILED','SOURCE_DELETING'][o_orderkey % 5 + 1] AS status,
   ['NO_SPEECH_DETECTED','DUPLICATE_CONTENT','SOURCE_MISSING'][o_orderkey // 5 % 3 + 1] AS code, o_custkey, o_orderpriority AS pr FROM orders),
 q AS (SELECT *, CASE WHEN k % 53 = 0 THEN NULL WHEN k % 59 = 0 THEN '../' || k ELSE 'f/' || k || '.wav' END AS path, CASE WHEN k % 61 = 0 THEN 'x/' || k ELSE dev || '/f/' || k || '.wav' END AS key,
   k % 19 <> 0 AND k % 23 <> 0 AND status IN ('RAW_SAVED','COMPLETED','SOURCE_DELETING') AND k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AS kept, k % 13 <> 0 AND k % 17 <> 0 AS heard FROM p),
 r AS (SELECT q.*, coalesce(t.kept AND t.k % 71 <> 0, false) AS twin FROM q LEFT JOIN q t ON q.status = 'SKIPPED' AND q.code = 'DUPLICATE_CONTENT' AND t.key = q.dev || '/f/' || (q.k - 2) || '.wav')"""
_REASON = """CASE WHEN k % 71 = 0 THEN 'not of this session' WHEN path IS NULL THEN 'no source path' WHEN path LIKE '../%' THEN 'unsafe path' WHEN key <> dev || '/' || path THEN 'key does not match path'
   WHEN {absent} THEN 'not on a connected device' WHEN k % 67 = 0 THEN 'size or time unknown'
   WHEN NOT (kept OR ({skipped} AND status = 'SKIPPED' AND ((code = 'NO_SPEECH_DETECTED' AND heard) OR (code = 'DUPLICATE_CONTENT' AND twin)))) THEN CASE status WHEN 'SKIPPED' THEN 'skip reason is not backed' ELSE 'text is not preserved' END END"""

QUERIES = {
    "eligibility_matrix": q_eligibility_matrix,
    "lock_states": q_lock_states,
    "result_outcomes": q_result_outcomes,
    "missing_sources": q_missing_sources,
    "delete_plan": q_delete_plan,
    "retry_policy": q_retry_policy,
    "source_gating": q_source_gating,
    "staleness": q_staleness,
    "request_ids": q_request_ids,
    "redacted_values": q_redacted,
    "state_flags": q_state_flags,
}
ORACLES = {
    "eligibility_matrix": f"WITH {_PARTS}, d AS (SELECT k, {_REASON.format(absent="pr = '5-LOW'", skipped='true')} AS reason FROM r) SELECT k AS o_orderkey, reason IS NULL AS eligible, reason FROM d",
    "delete_plan": f"""WITH {_PARTS}, d AS (SELECT dev || ':s' AS session_key, {_REASON.format(absent='false', skipped='false')} AS reason FROM r)
      SELECT session_key, count(CASE WHEN reason IS NULL THEN 1 END) AS n_eligible, count(reason) AS n_skipped, min(reason) AS first_reason FROM d GROUP BY 1""",
    "lock_states": """WITH t AS (SELECT l_orderkey % 81 AS k FROM lineitem), x AS (SELECT [true, false, NULL][k % 3 + 1] AS a, [true, false, NULL][k // 3 % 3 + 1] AS b, [true, false, NULL][k // 9 % 3 + 1] AS c, [true, false, NULL][k // 27 % 3 + 1] AS d FROM t)
      SELECT coalesce(a AND b, false) AS lock1, coalesce(a AND b AND c AND NOT d, false) AS enabled, CASE WHEN d IS NULL THEN 'unknown' WHEN d THEN 'readOnly' ELSE 'writable' END AS mount, count(*) AS n FROM x GROUP BY 1, 2, 3""",
    "result_outcomes": """WITH r AS (SELECT event_id, user_id, 'r' || (event_id % 2) AS q, event_id % 3 <> 0 AS deleted, CASE WHEN event_id % 11 <> 0 THEN ts END AS c FROM events WHERE event_type = 'purchase')
      SELECT event_id, CASE WHEN user_id NOT IN (SELECT doc_id FROM labels) THEN 'keep: unknown part' WHEN user_id % 7 = 0 OR user_id % 4 = 0 THEN 'discard: not waiting' WHEN q <> 'r1' THEN 'discard: another request'
      WHEN deleted AND coalesce(NOT (TIMESTAMP '2024-01-20' > c), false) THEN 'wait: inventory is older' WHEN NOT deleted THEN 'pending: not deleted' WHEN user_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'pending: still listed' ELSE 'completed' END AS outcome FROM r""",
    "missing_sources": "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "retry_policy": "WITH e(i, error_code, retry) AS (VALUES "
    + ", ".join(f"({e[0]}, '{e[1]}', '{e[3]}')" for e in dims.errors())
    + ", (35, 'NO_SUCH_CODE', 'none')) SELECT event_id, error_code, retry, retry = 'attempts' AS counts, CASE WHEN retry <> 'none' AND event_id % 4 IN (0, 2) THEN ['NORMALIZING', NULL, 'RAW_WRITING'][event_id % 4 + 1] END AS to_status FROM events JOIN e ON i = event_id % 36 WHERE event_type = 'error'",
    "source_gating": """WITH s AS (SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 10 * 60 END > 300, true) AS stale FROM supplier),
      g(stage, helper) AS (VALUES ('find_parts', true), ('close_sessions', false), ('transcribe_parts', false), ('index_notes', false), ('analyze_sessions', false), ('decide_deletions', true), ('settle_skips', true), ('retry_failed', true))
      SELECT s_suppkey, stage, NOT stale OR NOT helper AS runs FROM s, g""",
    "staleness": """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN TIMESTAMP '2024-01-20' > ts END AS newer, event_id % 5 = 0 OR event_id % 100 > 60 AS stale,
      event_id % 7 <> 0 AND epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) > 86400 AS timed_out FROM events""",
    "request_ids": """WITH o AS (SELECT o_orderkey, 'dev/' || o_orderkey || '.wav' AS k, strftime(o_orderdate, '%Y%m%dT%H%M%S') AS s FROM orders)
      SELECT o_orderkey, s || '-' || substring(sha256(k), 1, 16) || '-' || substring(sha256(s || k), 1, 6) AS request_id, true AS valid FROM o""",
    "redacted_values": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'token' ELSE 'text' END AS key, md5(CASE WHEN doc_id % 3 = 0 THEN '<' || length(text) || ' chars>' WHEN length(text) > 200 THEN substring(text, 1, 199) || '…' ELSE text END) AS shown_md5 FROM documents""",
    "state_flags": """WITH f(status, terminal, deletable, awaiting_deletion, staging_disposable, note_member, retry_reset, in_progress) AS (VALUES
        ('RAW_SAVED', true, true, true, true, true, true, false), ('COMPLETED', true, true, false, true, true, false, false), ('SKIPPED', true, false, false, true, false, false, false),
        ('FAILED', true, false, false, false, false, false, false), ('SOURCE_DELETING', true, true, true, true, true, false, true)),
      p AS (SELECT ['RAW_SAVED','COMPLETED','SKIPPED','FAILED','SOURCE_DELETING'][o_orderkey % 5 + 1] AS status FROM orders) SELECT f.*, count(*) AS n FROM p JOIN f USING (status) GROUP BY ALL""",
}
