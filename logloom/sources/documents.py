"""Queries of the readers and writers, over documents and listings made of the driver's tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.plans import once, shared_path
from logloom.sources import files, sinks
from logloom.sources.tables import load


def _str(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _events(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", "event_type", "value", F.col("event_id").alias("k"))


def _listing(spark, sf_dir) -> DataFrame:
    """Recordings and manifests of events: odd names, missing recordings, broken, unsafe and incomplete manifests."""
    e, k = _events(spark, sf_dir), F.col("k")
    name = F.concat(F.lit("TX01_MIC001_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.when(k % 5 == 0, "").otherwise("_orig"), F.when(k % 11 == 0, ".mp3").otherwise(".wav"))
    e = e.select("k", F.concat(F.lit("d"), _str(k % 7)).alias("device_id"), F.concat_ws("/", F.concat(F.lit("f"), _str("k")), name).alias("relpath"))
    path = F.when(k % 13 == 0, F.concat(F.lit("../"), F.col("relpath"))).when(k % 17 == 0, "").otherwise(F.col("relpath"))
    meta = F.to_json(F.struct(F.lit(1).alias("schema"), "device_id", path.alias("relpath"), F.when(k % 19 != 0, k % 1000).alias("size"), F.lit(1.5).alias("mtime"), F.md5(_str("k")).alias("sha256")))
    content = F.when(k % 23 == 0, "{broken").otherwise(meta)
    wavs = e.filter(k % 29 != 0).select("device_id", "relpath", (k % 1000).alias("size"), F.lit(None).cast("string").alias("content"))
    metas = e.select("device_id", F.concat("relpath", F.lit(files.META)).alias("relpath"), F.length(content).cast("bigint").alias("size"), content.alias("content"))
    return wavs.unionByName(metas).withColumn("name", F.substring_index("relpath", "/", -1))


def q_inbox_scan(spark, sf_dir):
    p = files.inbox_parts(_listing(spark, sf_dir))
    return p.select(F.regexp_extract("relpath", "^f([0-9]+)/", 1).cast("bigint").alias("event_id"), "event", "reason", "partkey", "mic_index", "started_at", "source_size", F.col("sha256_helper").alias("sha"))


def q_device_scan(spark, sf_dir):
    """Recordings by device: how many, and how many are to be fetched after those of the first half were."""
    found = _listing(spark, sf_dir).filter(~F.col("name").endswith(files.META))
    number = F.regexp_extract("relpath", "^f([0-9]+)/", 1).cast("bigint")
    d = files.device_files(found, found.filter(number % 2 == 0).select("device_id", "relpath"), 2)
    return d.groupBy("device_id").agg(F.count("*").alias("n"), F.count_if("candidate").alias("candidates"))


def q_volume_check(spark, sf_dir):
    k = F.col("s_suppkey")
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.when(k % 3 == 0, "REC_").otherwise("REC-"), _str(k % 10), F.when(k % 7 == 0, "X").otherwise("")).alias("name"))
    reason = files.volume_reason(F.col("name"), k % 11 == 0, F.when(k % 5 != 0, True), k % 4, ["REC_*", "REC-?", "REC-?X"], ["*9*", "REC-8?"])
    return s.select("s_suppkey", "name", reason.alias("reason"))


def _inventories(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    each = load(spark, sf_dir, "supplier").withColumn("inv", F.floor(k / 8))
    devices = F.map_from_entries(F.array_sort(F.collect_list(F.struct("s_name", F.when(k % 5 != 0, F.array(F.lit("a/1.wav"), F.when(k % 3 == 0, F.lit("b/2.wav")))).alias("v")))))
    free = F.map_from_entries(F.array_sort(F.collect_list(F.struct("s_name", F.when(k % 4 != 0, F.floor("s_acctbal")).alias("v")))))
    g = each.groupBy("inv").agg(devices.alias("d"), free.alias("f"))
    body = F.to_json(F.struct(F.when(F.col("inv") % 3 != 0, "2024-01-01T00:00:00Z").alias("generated_at"), F.when(F.col("inv") % 2 == 0, F.lit(False)).alias("mount_readonly"), F.col("d").alias("devices"), F.col("f").alias("device_free_bytes"), F.lit(1).alias("more")), {"ignoreNullFields": "false"})
    return g.select("inv", F.when(F.col("inv") % 6 == 5, "[1]").otherwise(body).alias("content"))


def q_inventory_read(spark, sf_dir):
    i = _inventories(spark, sf_dir).select("inv", files.inventory(F.col("content")).alias("i"))
    return i.select("inv", F.col("i.generated_at").isNotNull().alias("dated"), F.col("i.mount_readonly").alias("readonly"), F.coalesce(F.size("i.devices"), F.lit(-1)).alias("n_devices"), F.aggregate(F.map_values("i.free_bytes"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("free"))


def q_inventory_paths(spark, sf_dir):
    i = _inventories(spark, sf_dir).select(files.inventory(F.col("content")).alias("i"))
    return files.inventory_paths(i, "i")


def q_inventory_write(spark, sf_dir):
    """Devices of an inventory document, from paths that occur more than once."""
    paths = q_inventory_paths(spark, sf_dir)
    free = load(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("device_id"), F.floor("s_acctbal").alias("free"))
    d = files.inventory_document(paths.unionByName(paths), free)
    return d.select("device_id", F.array_join("paths", ",").alias("paths"), "free")


def q_heartbeat(spark, sf_dir):
    """Heartbeats written and read back, some without a time, some broken."""
    k = F.col("c_custkey")
    c = load(spark, sf_dir, "customer").select(
        "c_custkey", F.lit(1).alias("schema"), F.when(k % 5 != 0, F.concat(F.lit("2024-01-01T00:0"), _str(k % 10), F.lit(":00Z"))).alias("updated_at"), F.lit("1.0").alias("helper_version"), F.when(k % 3 == 0, "ro").alias("mount_mode"),
        F.when(k % 4 != 0, k % 4 == 1).alias("mount_readonly"), (k % 2 == 0).alias("delete_source_audio"), F.lit(True).alias("reaper_installed"), F.array(F.lit("REC*")).alias("include_volumes"), F.array().cast("array<string>").alias("exclude_volumes"), F.lit(None).cast("string").alias("config_error"),
    )
    c = c.select("c_custkey", F.when(k % 11 == 0, "no json").otherwise(files.heartbeat_document(c)).alias("content"))
    b = c.select("c_custkey", files.heartbeat(F.col("content"), F.lit("2024-01-01T00:10:00Z").cast("timestamp"), 300).alias("h"))
    return b.select("c_custkey", "h.age_s", "h.stale", F.col("h.beat.mount_mode").alias("mount_mode"), F.col("h.beat.mount_readonly").alias("mount_readonly"), F.col("h.beat.delete_source_audio").alias("deletes"))


def q_transcript_read(spark, sf_dir):
    """Stored transcripts of turns; every seventh lacks its text, every fifth has a segment without an end."""
    k = F.col("conv_id") + F.col("turn")
    segment = F.struct(F.lit(0.0).alias("start"), F.when(k % 5 != 0, 1.5).alias("end"), F.md5("text").alias("text"))
    doc = F.struct(F.lit("p").alias("partkey"), F.lit("ja").alias("language"), F.when(k % 2 == 0, 1.5).alias("duration_seconds"), F.lit("t").alias("started_at"), F.when(k % 7 != 0, F.md5("text")).alias("text"), F.array(segment).alias("segments"))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", files.transcript(F.to_json(doc, {"ignoreNullFields": "false"})).alias("t"))
    return c.select("conv_id", "turn", F.col("t.text").alias("text"), F.col("t.duration_seconds").alias("seconds"), F.get("t.segments", F.lit(0))["end"].alias("end_s"))


def q_asr_read(spark, sf_dir):
    """Recogniser output of turns: three entries, of which the second may lack its end and the third be blank."""
    k = F.col("conv_id") + F.col("turn")

    def entry(low, high, said):
        return F.struct(F.struct(F.lit(low).alias("from"), high.cast("double").alias("to")).alias("offsets"), said.alias("text"))

    entries = F.array(entry(0.0, F.lit(3200), F.lit(" a ")), entry(3200.0, F.when(k % 3 != 0, F.lit(4000.4)), F.lit("b")), entry(5000.0, F.lit(6000), F.when(k % 2 == 0, F.lit(" ")).otherwise(F.lit("c"))))
    doc = F.to_json(F.struct(F.struct(F.when(k % 5 == 0, "").otherwise("en").alias("language")).alias("result"), entries.alias("transcription")))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", files.asr_segments(doc, "ja").alias("s"))
    return c.select("conv_id", "turn", "s.language", "s.text", F.size("s.segments").alias("n"), F.element_at("s.segments", -1)["end"].alias("last_end"))


def q_delete_results(spark, sf_dir):
    e, k = _events(spark, sf_dir), F.col("k")
    doc = F.to_json(F.struct(F.when(k % 5 != 0, F.concat(F.lit("r"), _str("k"))).otherwise("").alias("request_id"), F.concat(F.lit("u/"), _str("user_id")).alias("partkey"), F.when(k % 3 != 0, "DELETED").alias("status"), F.when(k % 4 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("completed_at")))
    content = F.when(k % 7 == 0, F.left(doc, F.length(doc) - 1)).otherwise(doc)
    found = files.delete_results(e.select(F.concat(F.lit("n"), _str("k"), F.when(k % 11 == 0, ".tmp").otherwise(".json")).alias("name"), content.alias("content")))
    return found.select("name", "request_id", "status", "detail", F.col("completed_at").cast("timestamp_ntz").alias("completed_at"))


def q_vault_names(spark, sf_dir):
    p = load(spark, sf_dir, "pages").filter("url IS NOT NULL")
    rel = F.concat(F.when(F.col("page_id") % 5 == 0, "tpl/").otherwise("notes/"), F.regexp_extract("url", "/([^/]*)$", 1), F.when(F.col("page_id") % 7 == 0, ".txt").otherwise(".md"))
    return files.vault_names(p.select(rel.alias("relpath")), ["tpl"]).select("name")


def q_audio_probe(spark, sf_dir):
    """Probe output of order lines: numbers as text, some of them negative, no number, or without a stream."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    stream = F.struct(F.when(k % 3 == 0, "N/A").otherwise("48000").alias("sample_rate"), F.lit("1").alias("channels"), F.when(k % 4 == 0, "").otherwise("s16").alias("sample_fmt"), F.lit("pcm").alias("codec_name"))
    doc = F.to_json(F.struct(F.when(k % 7 == 0, F.array().cast("array<struct<sample_rate:string,channels:string,sample_fmt:string,codec_name:string>>")).otherwise(F.array(stream)).alias("streams"), F.struct(_str(F.col("l_quantity") - 3).alias("duration")).alias("format")))
    li = once(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), files.probed(doc), "d")
    li = li.select("l_orderkey", "l_linenumber", files.audio_format(F.col("d")).alias("p"))
    return li.select("l_orderkey", "l_linenumber", "p.duration_seconds", "p.sample_rate", "p.channels", "p.sample_fmt")


def q_folder_scan(spark, sf_dir):
    """Properties of events as files of seven device folders, and the folders listed again: files and bytes of each."""
    e = load(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("user_id") % 7).alias("device"), "props")
    path = shared_path(spark, "devices")
    e.repartition("device").write.partitionBy("device").text(path)
    found = files.listing(spark, path)
    return found.filter(F.endswith("name", F.lit(".txt"))).groupBy(F.substring_index("device_id", "=", -1).alias("device")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def q_listing_totals(spark, sf_dir):
    found = _listing(spark, sf_dir).filter(~F.col("name").endswith(files.META))
    number = F.regexp_extract("relpath", "^f([0-9]+)/", 1).cast("bigint")
    return files.bytes_below(found.withColumn("size", F.when(number % 3 != 0, F.col("size"))), ["device_id"])


def q_queue_counts(spark, sf_dir):
    e, k = _events(spark, sf_dir), F.col("k")
    name = F.concat(_str("k"), F.when(k % 5 == 0, ".tmp").otherwise(".json"))
    return files.queue_counts(e.select(F.concat_ws("/", F.when(k % 3 == 0, "delete").when(k % 3 == 1, "result").otherwise("done"), name).alias("relpath"), name.alias("name")))


def q_notes_write(spark, sf_dir):
    """Notes stored with their hashes and read back: notes and characters by folder, and how many failed the check."""
    d = load(spark, sf_dir, "documents").select("lang", F.concat(_str("doc_id"), F.lit(".md")).alias("name"), "text")
    path = shared_path(spark, "notes")
    bad = sinks.write_notes(d, path, "lang", "name", "text").groupBy("folder").agg(F.count("*").alias("n_bad"))
    stored = spark.read.parquet(path).groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    return stored.join(bad, "folder", "left").select("folder", "n", "chars", F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def q_sidecars(spark, sf_dir):
    """Sidecars of orders by slug, and the one folder that a slug of a given first digit is in."""
    o = load(spark, sf_dir, "orders").select(F.substring(F.sha2(_str("o_orderkey"), 256), 1, 16).alias("slug"), "o_orderkey", "o_orderstatus")
    path = shared_path(spark, "sidecars")
    sinks.write_sidecars(o, path, "slug")
    return sinks.read_sidecar(spark, path, "slug string, o_orderkey bigint, o_orderstatus string", "a")


def q_request_queue(spark, sf_dir):
    """Delete requests of finished orders, queued and read back."""
    o = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    key = F.concat(F.lit("dev/"), _str("o_orderkey"))
    rows = o.select(F.lit("dev").alias("device_id"), key.alias("partkey"), F.lit("dev:s").alias("session_key"), F.concat(_str("o_orderkey"), F.lit(".wav")).alias("source_path"), F.floor("o_totalprice").alias("source_size"), F.lit(1.5).alias("source_mtime"))
    path = shared_path(spark, "queue")
    sinks.queue_requests(rows, path, F.concat(F.lit("r-"), F.md5("partkey")), F.lit("2024-01-01T00:00:00+00:00"))
    back = spark.read.schema("schema int, request_id string, partkey string, targets array<struct<relpath:string,size:bigint,mtime:double>>").json(path)
    return back.select("schema", "request_id", "partkey", F.get("targets", F.lit(0))["relpath"].alias("relpath"), F.get("targets", F.lit(0))["size"].alias("size"))


def q_log_write(spark, sf_dir):
    """Log lines of events as text, with the properties kept secret and a null field left out."""
    e = load(spark, sf_dir, "events").select(F.lit("2024-01-01T00:00:00").alias("at"), F.lit("INFO").alias("level"), "event_type", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id"), "props")
    return sinks.log_lines(e, "at", "level", "event_type", ["event_id", "user_id", "props"], ["props"], False)


_OK = "TX01_MIC001_"
_L = f"""l AS (SELECT event_id AS k, 'd' || (event_id % 7) AS d, date_trunc('second', ts) AS began, 'f' || event_id || '/{_OK}' || strftime(ts, '%Y%m%d_%H%M%S') || CASE WHEN event_id % 5 = 0 THEN '' ELSE '_orig' END || CASE WHEN event_id % 11 = 0 THEN '.mp3' ELSE '.wav' END AS rel FROM events)"""
_I = """i AS (SELECT s_suppkey // 8 AS inv, s_suppkey AS k, s_name, s_acctbal FROM supplier)"""

QUERIES = {
    "inbox_scan": q_inbox_scan, "device_scan": q_device_scan, "volume_check": q_volume_check, "inventory_read": q_inventory_read, "inventory_paths": q_inventory_paths, "inventory_write": q_inventory_write,
    "heartbeat_read": q_heartbeat, "transcript_read": q_transcript_read, "asr_read": q_asr_read, "delete_results_read": q_delete_results, "vault_names": q_vault_names, "audio_probe": q_audio_probe,
    "listing_totals": q_listing_totals, "folder_scan": q_folder_scan, "queue_counts": q_queue_counts, "notes_write": q_notes_write, "sidecars": q_sidecars, "request_queue": q_request_queue, "log_write": q_log_write,
}
ORACLES = {
    "folder_scan": "SELECT 'd' || user_id % 7 AS device, 1::BIGINT AS files, CAST(sum(strlen(props) + 1) AS BIGINT) AS bytes FROM events GROUP BY 1",
    "inbox_scan": f"""WITH {_L}, r AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'filename' WHEN k % 5 = 0 THEN 'variant_not_orig' WHEN k % 23 = 0 THEN 'meta_unreadable' WHEN k % 13 = 0 THEN 'meta_unsafe_relpath?' WHEN k % 17 = 0 THEN 'meta_missing_relpath' WHEN k % 19 = 0 THEN 'meta_missing_stat' END AS why FROM l
        WHERE k % 11 = 0 OR k % 5 = 0 OR k % 29 <> 0),
      s AS (SELECT *, CASE WHEN why = 'meta_unsafe_relpath?' THEN CASE WHEN k % 19 = 0 THEN 'meta_missing_stat' ELSE 'meta_unsafe_relpath' END ELSE why END AS reason FROM r)
      SELECT k AS event_id, CASE WHEN reason = 'filename' THEN 'unparsable_filename' WHEN reason IS NOT NULL THEN 'part_skipped' ELSE 'part' END AS event, reason,
      CASE WHEN reason IS NULL THEN d || '/' || rel END AS partkey, CASE WHEN reason IS NULL THEN 1::INTEGER END AS mic_index, CASE WHEN reason IS NULL THEN began END AS started_at, CASE WHEN reason IS NULL THEN k % 1000 END AS source_size, CASE WHEN reason IS NULL THEN md5(CAST(k AS VARCHAR)) END AS sha FROM s""",
    "device_scan": f"WITH {_L} SELECT d AS device_id, count(*) AS n, count(CASE WHEN k % 5 <> 0 AND k % 2 <> 0 THEN 1 END) AS candidates FROM l WHERE k % 29 <> 0 AND k % 11 <> 0 GROUP BY 1",
    "volume_check": """WITH s AS (SELECT s_suppkey, s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'REC_' ELSE 'REC-' END || (s_suppkey % 10) || CASE WHEN s_suppkey % 7 = 0 THEN 'X' ELSE '' END AS name FROM supplier)
      SELECT s_suppkey, name, CASE WHEN name LIKE '%9%' OR name LIKE 'REC-8_' THEN 'in EXCLUDE_VOLUMES' WHEN k % 11 = 0 THEN 'symlink' WHEN k % 5 = 0 THEN 'not a readable directory' WHEN k % 4 = 0 THEN 'no recordings' END AS reason FROM s""",
    "inventory_read": f"""WITH {_I} SELECT inv, inv % 6 <> 5 AND inv % 3 <> 0 AS dated, CASE WHEN inv % 6 <> 5 AND inv % 2 = 0 THEN false END AS readonly, CASE WHEN inv % 6 = 5 THEN -1 ELSE CAST(count(CASE WHEN k % 5 <> 0 THEN 1 END) AS INTEGER) END AS n_devices,
      CASE WHEN inv % 6 <> 5 THEN CAST(coalesce(sum(CASE WHEN k % 4 <> 0 THEN floor(s_acctbal) END), 0) AS BIGINT) END AS free FROM i GROUP BY inv""",
    "inventory_paths": f"WITH {_I} SELECT s_name AS device_id, unnest(CASE WHEN k % 3 = 0 THEN ['a/1.wav', 'b/2.wav'] ELSE ['a/1.wav'] END) AS relpath FROM i WHERE inv % 6 <> 5 AND k % 5 <> 0",
    "inventory_write": f"WITH {_I} SELECT s_name AS device_id, CASE WHEN k % 3 = 0 THEN 'a/1.wav,b/2.wav' ELSE 'a/1.wav' END AS paths, CASE WHEN k % 2 = 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS free FROM i WHERE inv % 6 <> 5 AND k % 5 <> 0",
    "heartbeat_read": """SELECT c_custkey, CASE WHEN k % 11 <> 0 AND k % 5 <> 0 THEN (10 - k % 10) * 60 END AS age_s, coalesce(k % 11 = 0 OR k % 5 = 0 OR (10 - k % 10) * 60 > 300, true) AS stale, CASE WHEN k % 11 <> 0 AND k % 3 = 0 THEN 'ro' END AS mount_mode,
      CASE WHEN k % 11 <> 0 AND k % 4 <> 0 THEN k % 4 = 1 END AS mount_readonly, CASE WHEN k % 11 <> 0 THEN k % 2 = 0 END AS deletes FROM (SELECT c_custkey, c_custkey AS k FROM customer)""",
    "transcript_read": """SELECT conv_id, turn, CASE WHEN ok THEN md5(text) END AS text, CASE WHEN ok AND k % 2 = 0 THEN 1.5::DOUBLE END AS seconds, CASE WHEN ok THEN 1.5::DOUBLE END AS end_s
      FROM (SELECT *, conv_id + turn AS k, (conv_id + turn) % 7 <> 0 AND (conv_id + turn) % 5 <> 0 AS ok FROM conversations)""",
    "asr_read": """SELECT conv_id, turn, CASE WHEN k % 5 = 0 THEN 'ja' ELSE 'en' END AS language, 'a' || CASE WHEN k % 3 <> 0 THEN 'b' ELSE '' END || CASE WHEN k % 2 <> 0 THEN 'c' ELSE '' END AS text,
      CAST(1 + CAST(k % 3 <> 0 AS INTEGER) + CAST(k % 2 <> 0 AS INTEGER) AS INTEGER) AS n, CASE WHEN k % 2 <> 0 THEN 6.0::DOUBLE WHEN k % 3 <> 0 THEN 4.0::DOUBLE ELSE 3.2::DOUBLE END AS last_end FROM (SELECT conv_id, turn, conv_id + turn AS k FROM conversations)""",
    "delete_results_read": """SELECT 'n' || event_id || '.json' AS name, 'r' || event_id AS request_id, CASE WHEN event_id % 3 <> 0 THEN 'DELETED' ELSE '' END AS status, '' AS detail, CASE WHEN event_id % 4 <> 0 THEN date_trunc('second', ts) END AS completed_at
      FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0""",
    "vault_names": "SELECT DISTINCT regexp_extract(url, '/([^/]*)$', 1) AS name FROM pages WHERE url IS NOT NULL AND page_id % 5 <> 0 AND page_id % 7 <> 0",
    "audio_probe": """SELECT l_orderkey, l_linenumber, CASE WHEN k % 7 <> 0 AND l_quantity >= 3 THEN l_quantity - 3 END AS duration_seconds, CASE WHEN k % 7 <> 0 AND k % 3 <> 0 THEN 48000::INTEGER END AS sample_rate, CASE WHEN k % 7 <> 0 THEN 1::INTEGER END AS channels,
      CASE WHEN k % 7 <> 0 AND k % 4 <> 0 THEN 's16' END AS sample_fmt FROM (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem)""",
    "listing_totals": f"WITH {_L} SELECT d AS device_id, CAST(coalesce(sum(CASE WHEN k % 3 <> 0 THEN k % 1000 END), 0) AS BIGINT) AS bytes, count(*) AS files FROM l WHERE k % 29 <> 0 GROUP BY 1",
    "queue_counts": "SELECT count(CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN 1 END) AS requested, count(CASE WHEN event_id % 3 = 1 AND event_id % 5 <> 0 THEN 1 END) AS awaiting FROM events",
    "notes_write": "SELECT lang AS folder, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, 0::BIGINT AS n_bad FROM documents GROUP BY 1",
    "sidecars": "SELECT substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS slug, o_orderkey, o_orderstatus FROM orders WHERE sha256(CAST(o_orderkey AS VARCHAR)) LIKE 'a%'",
    "request_queue": "SELECT 1::INTEGER AS schema, 'r-' || md5('dev/' || o_orderkey) AS request_id, 'dev/' || o_orderkey AS partkey, o_orderkey || '.wav' AS relpath, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderstatus = 'F'",
    "log_write": "SELECT '2024-01-01T00:00:00 INFO ' || event_type || ' event_id=' || event_id || CASE WHEN event_id % 3 <> 0 THEN ' user_id=' || user_id ELSE '' END || CASE WHEN props IS NULL THEN '' ELSE ' props=<' || length(props) || ' chars>' END AS line FROM events",
}
