"""Readers of recorder folders and operational JSON, lenient where one broken file must not stop the rest.

A listing has one row per file: device_id, relpath (below the device), name, size and, for JSON, its content. Listings
come from Spark's binaryFile source or from any table of that shape, so each reader is a plan over DataFrames.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import keys

# Names of recordings and of their folders.
RECORDING = r"^(TX[0-9]{2})_MIC([0-9]{3})_([0-9]{8})_([0-9]{6})(_orig)?\.(wav|WAV)$"
FOLDER = r"^TX_MIC([0-9]{3})_([0-9]{8})_([0-9]{6})$"
META = ".meta.json"

INVENTORY = "generated_at string, mount_readonly boolean, device_free_bytes map<string,bigint>, devices map<string,array<string>>"
HEARTBEAT = (
    "schema int, updated_at string, helper_version string, mount_mode string, mount_readonly boolean, delete_source_audio boolean, "
    "reaper_installed boolean, include_volumes array<string>, exclude_volumes array<string>, config_error string"
)
MANIFEST = "schema int, device_id string, relpath string, size double, mtime double, sha256 string, copied_at string, helper_version string"
RESULT = "request_id string, partkey string, status string, detail string, completed_at string"
ASR = "result struct<language:string>, transcription array<struct<offsets:struct<from:double,to:double>,text:string>>"
TRANSCRIPT = "partkey string, language string, duration_seconds double, started_at string, text string, segments array<struct<start:double,end:double,text:string>>"


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files below ``root`` as device_id, relpath, name, size, modified; hidden names and folders are left out. Content
    is only read where asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + "\\Q" + root.rstrip("/") + "\\E/", "")
    cols = [F.substring_index(rel, "/", 1).alias("device_id"), F.regexp_replace(rel, "^[^/]*/", "").alias("relpath"), F.substring_index(rel, "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if content:
        cols.append(F.col("content").cast("string").alias("content"))
    return df.select(*cols).filter(~F.exists(F.split("relpath", "/"), lambda s: s.startswith(".")) & ~F.col("device_id").startswith("."))


def recording_name(name: Column) -> Column:
    """Struct of transmitter_id, mic_index, started_at (local time) and variant; null if the name is none or its date not
    in the calendar. Digits are ASCII."""

    def g(i):
        return F.regexp_extract(name, RECORDING, i)

    at = F.try_to_timestamp(F.concat(g(3), g(4)), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    variant = F.when(g(5) == "_orig", "orig").otherwise("denoised")
    return F.when(name.rlike(RECORDING) & at.isNotNull(), F.struct(g(1).alias("transmitter_id"), g(2).cast("int").alias("mic_index"), at.alias("started_at"), variant.alias("variant")))


def json_or_null(content: Column, schema: str) -> Column:
    """The document, or null if it is no JSON object. Unknown keys are ignored, values of a wrong type become null."""
    return F.when(F.trim(content).startswith("{") & F.json_object_keys(content).isNotNull(), F.from_json(content, schema, {"mode": "PERMISSIVE"}))


def inbox_parts(files: DataFrame) -> DataFrame:
    """What each manifest of ``files`` (device_id, relpath, name, content) stands for: ``event`` part, part_skipped or
    unparsable_filename, with its reason and, for parts, the columns of a part. Manifests whose recording is not there
    yet have no row. The listing of recordings is joined by key; contents of recordings are never read."""
    metas = files.filter(F.col("name").endswith(META)).withColumn("wav", F.expr(f"left(relpath, length(relpath) - {len(META)})"))
    wavs = files.filter(~F.col("name").endswith(META)).select("device_id", F.col("relpath").alias("wav"))
    found = metas.withColumn("n", recording_name(F.substring_index("wav", "/", -1))).withColumn("m", json_or_null(F.col("content"), MANIFEST))
    # Names and variants are judged before anything else is looked up, as the manifests of those are never acted on.
    early = F.when(F.col("n").isNull(), "filename").when(F.col("n.variant") != "orig", "variant_not_orig")
    found = found.withColumn("early", early)
    here = wavs.distinct().withColumn("here", F.lit(True))
    found = found.join(here, ["device_id", "wav"], "left").filter("early IS NOT NULL OR here")
    key = keys.part_key(F.col("device_id"), F.col("m.relpath"))
    late = (
        F.when(F.col("m").isNull(), "meta_unreadable").when(F.coalesce(F.col("m.relpath"), F.lit("")) == "", "meta_missing_relpath")
        .when(F.col("m.size").isNull() | F.col("m.mtime").isNull(), "meta_missing_stat").when(key.isNull(), "meta_unsafe_relpath")
    )
    both = found.withColumn("reason", F.coalesce("early", late))
    event = F.when(F.col("reason") == "filename", "unparsable_filename").when(F.col("reason").isNotNull(), "part_skipped").otherwise("part")
    good = F.col("reason").isNull()
    return both.select(
        "device_id", F.col("wav").alias("relpath"), event.alias("event"), "reason", F.when(good, key).alias("partkey"), F.when(good, F.col("n.transmitter_id")).alias("transmitter_id"),
        F.when(good, F.col("n.mic_index")).alias("mic_index"), F.when(good, F.col("n.started_at")).alias("started_at"), F.when(good, F.col("m.relpath")).alias("source_path"),
        F.when(good, F.col("m.size").cast("bigint")).alias("source_size"), F.when(good, F.col("m.mtime")).alias("source_mtime"), F.when(good, F.coalesce(F.col("m.sha256"), F.lit(""))).alias("sha256_helper"),
    )


def device_files(files: DataFrame, tombstones: DataFrame, depth: int) -> DataFrame:
    """Recordings on devices down to ``depth`` folders: all for the inventory; ``candidate`` if original and without a
    tombstone (device_id, relpath). The anti-join comes before anything reads contents."""
    recs = files.filter((F.size(F.split("relpath", "/")) <= depth) & F.col("name").rlike(RECORDING.replace("^(TX", "^(?:TX")))
    taken = tombstones.select("device_id", "relpath").distinct().withColumn("_taken", F.lit(True))
    return recs.join(taken, ["device_id", "relpath"], "left").withColumn("candidate", F.col("name").rlike(r"_orig\.(wav|WAV)$") & F.col("_taken").isNull()).drop("_taken")


def glob_match(name: Column, patterns: list[str]) -> Column:
    """Whether any shell pattern (*, ?) matches the whole name."""
    import re

    def rx(p):
        return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$"

    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike("(?s)" + rx(p))
    return out


def volume_reason(name: Column, symlink: Column, readable: Column, recordings: Column, include: list[str], exclude: list[str]) -> Column:
    """Why a volume is passed over (first rule that holds), or null for a device."""
    listed = glob_match(name, include) if include else F.lit(True)
    barred = glob_match(name, exclude) if exclude else F.lit(False)
    return (
        F.when(~listed, "not in INCLUDE_VOLUMES").when(barred, "in EXCLUDE_VOLUMES").when(symlink, "symlink").when(~F.coalesce(readable, F.lit(False)), "not a readable directory")
        .when(F.coalesce(recordings, F.lit(0)) == 0, "no recordings")
    )


def inventory(content: Column) -> Column:
    """Inventory document: unknown stays null, entries that are no names are dropped."""
    doc = json_or_null(content, INVENTORY)
    devices = F.transform_values(F.map_filter(doc["devices"], lambda k, v: v.isNotNull()), lambda k, v: F.filter(v, lambda x: x.isNotNull()))
    free = F.map_filter(doc["device_free_bytes"], lambda k, v: v.isNotNull())
    at = F.try_to_timestamp(doc["generated_at"])
    return F.when(doc.isNotNull(), F.struct(at.alias("generated_at"), doc["mount_readonly"].alias("mount_readonly"), devices.alias("devices"), free.alias("free_bytes")))


def inventory_paths(inventories: DataFrame, column: str) -> DataFrame:
    """One row for each file of each device."""
    each = inventories.select(F.explode(F.col(f"{column}.devices")).alias("device_id", "paths"))
    return each.select("device_id", F.explode("paths").alias("relpath"))


def inventory_document(files: DataFrame, free: DataFrame) -> DataFrame:
    """Devices with their sorted paths and free bytes: what an inventory writer stores. A device holds a bounded number
    of recordings."""
    per = files.groupBy("device_id").agg(F.sort_array(F.collect_set("relpath")).alias("paths"))
    return per.join(free, "device_id", "left")


def heartbeat_document(facts: DataFrame) -> Column:
    """JSON of a heartbeat from columns named as in HEARTBEAT; unknown ones are null in it, not left out."""
    return F.to_json(F.struct(*[F.col(x.split(" ")[0]) for x in HEARTBEAT.split(", ")]), {"ignoreNullFields": "false"})


def heartbeat(content: Column, now: Column, max_age_s: int) -> Column:
    """Heartbeat with age in seconds and staleness; an unknown age is stale, and so is none."""
    doc = json_or_null(content, HEARTBEAT)
    age = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(doc["updated_at"]))
    return F.struct(doc.alias("beat"), age.alias("age_s"), F.coalesce(age > max_age_s, F.lit(True)).alias("stale"))


def transcript(content: Column) -> Column:
    """A stored transcript, or null as a whole if a required value is missing or a segment broken."""
    doc = json_or_null(content, TRANSCRIPT)
    whole = doc["text"].isNotNull() & doc["started_at"].isNotNull() & doc["language"].isNotNull() & doc["segments"].isNotNull() & content.contains('"duration_seconds"')
    sound = F.forall(doc["segments"], lambda s: s.isNotNull() & s["start"].isNotNull() & s["end"].isNotNull() & s["text"].isNotNull())
    return F.when(whole & F.coalesce(sound, F.lit(False)), doc)


def asr_segments(content: Column, fallback_language: str) -> Column:
    """Raw recogniser output: language, joined text and segments in seconds (from milliseconds, three decimals); broken
    or blank segments are dropped one by one."""
    doc = json_or_null(content, ASR)
    entries = F.coalesce(doc["transcription"], F.array().cast("array<struct<offsets:struct<from:double,to:double>,text:string>>"))
    good = F.filter(entries, lambda s: s.isNotNull() & s["offsets"]["from"].isNotNull() & s["offsets"]["to"].isNotNull() & (F.length(F.trim(F.coalesce(s["text"], F.lit("")))) > 0))
    segs = F.transform(good, lambda s: F.struct(F.round(s["offsets"]["from"] / 1000, 3).alias("start"), F.round(s["offsets"]["to"] / 1000, 3).alias("end"), F.trim(s["text"]).alias("text")))
    lang = F.when(F.length(doc["result"]["language"]) > 0, doc["result"]["language"]).otherwise(fallback_language)
    return F.struct(lang.alias("language"), F.array_join(F.transform(segs, lambda s: s["text"]), "").alias("text"), segs.alias("segments"))


def probed(content: Column) -> Column:
    """The document of a probe; of many, pass it through plans.once before audio_format, which reads it for each field."""
    return json_or_null(content, "streams array<struct<sample_rate:string,channels:string,sample_fmt:string,codec_name:string>>, format struct<duration:string>")


def audio_format(doc: Column) -> Column:
    """Format of the first stream of a probe, whose numbers are strings: unparsable or negative becomes null; null
    as a whole without a stream."""
    number = lambda c: F.when(c.try_cast("double") >= 0, c.try_cast("double"))
    said = lambda c: F.when(c != "", c)
    s = F.get(doc["streams"], F.lit(0))
    return F.when(s.isNotNull(), F.struct(
        number(doc["format"]["duration"]).alias("duration_seconds"), number(s["sample_rate"]).cast("int").alias("sample_rate"), number(s["channels"]).cast("int").alias("channels"),
        said(s["sample_fmt"]).alias("sample_fmt"), said(s["codec_name"]).alias("codec_name"),
    ))


def audio_probe(content: Column) -> Column:
    """audio_format of a probe's JSON."""
    return audio_format(probed(content))


def with_end(parts: DataFrame, start: str, seconds: str) -> DataFrame:
    """Adds ended_at; unknown without a duration."""
    end = F.col(start).cast("timestamp") + F.make_dt_interval(secs=F.col(seconds).cast("decimal(18,6)"))
    return parts.withColumn("ended_at", end.cast(dict(parts.dtypes)[start]))


def bytes_below(files: DataFrame, by: list[str]) -> DataFrame:
    """Bytes and files of a listing; unknown sizes count nothing."""
    return files.groupBy(*by).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def queue_counts(files: DataFrame) -> DataFrame:
    """Requests and results that wait, as JSON files in delete/ and result/."""
    json = F.col("name").endswith(".json")
    return files.agg(F.count_if(json & F.col("relpath").startswith("delete/")).alias("requested"), F.count_if(json & F.col("relpath").startswith("result/")).alias("awaiting"))


def delete_results(files: DataFrame) -> DataFrame:
    """Results of a queue folder (name, content): broken files and those without ids are ignored."""
    doc = json_or_null(F.col("content"), RESULT)
    good = files.filter(F.col("name").endswith(".json")).select("name", doc.alias("d")).filter("d IS NOT NULL AND length(d.partkey) > 0 AND length(d.request_id) > 0")
    return good.select("name", "d.request_id", "d.partkey", F.coalesce("d.status", F.lit("")).alias("status"), F.coalesce("d.detail", F.lit("")).alias("detail"), F.try_to_timestamp("d.completed_at").alias("completed_at"))


def front_matter(text: Column, list_field: str, key_field: str) -> Column:
    """Of a note: whether it has front matter, its session key, the recording keys it lists, and the body."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)^---[^\S\n]*$".replace("(?s)", "(?sm)"), 1)
    has = text.rlike(r"(?sm)\A---\n.*?^---[^\S\n]*$")
    key = F.regexp_extract(head, rf'(?m)^{key_field}: "?([^"\n]*)"?$', 1)
    block = F.regexp_extract(head, rf"(?m)^{list_field}:\n((?:  - .*\n?)*)", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit(r'(?m)^  - "?([^"\n]*)"?$'), F.lit(1)), lambda x: x)
    body = F.regexp_replace(text, r"(?sm)\A---\n.*?^---[^\S\n]*$", "")
    return F.struct(has.alias("has"), F.when(has & (key != ""), key).alias("session_key"), F.when(has, items).otherwise(F.array().cast("array<string>")).alias("keys"), body.alias("body"))


def vault_names(files: DataFrame, excluded: list[str]) -> DataFrame:
    """Base names of Markdown notes outside excluded folders, once each."""
    from logloom.functions.text import nfc_fold

    notes = files.filter(F.col("relpath").endswith(".md"))
    for prefix in excluded:
        notes = notes.filter(~F.col("relpath").startswith(prefix.rstrip("/") + "/"))
    base = F.regexp_replace(F.substring_index("relpath", "/", -1), r"\.md$", "")
    return notes.select(base.alias("name")).distinct().withColumn("folded", nfc_fold(F.col("name")))


# -- queries ----------------------------------------------------------------------------------------------------------


def q_filename_parse(spark, sf_dir):
    """Names made of event times, some with impossible dates or the wrong shape, parsed back."""
    from logloom.sources.tables import load

    e = load(spark, sf_dir, "events").select("event_id", "ts")
    k = F.col("event_id")
    day = F.when(k % 11 == 0, "20240230").otherwise(F.date_format("ts", "yyyyMMdd"))
    mic = F.concat(F.lit("MIC"), F.lpad((k % 1000).cast("string"), 3, "0"))
    name = F.concat(F.lit("TX0"), (k % 10).cast("string"), F.lit("_"), mic, F.lit("_"), day, F.lit("_"), F.date_format("ts", "HHmmss"), F.when(k % 3 == 0, "_orig").otherwise(""), F.when(k % 7 == 0, ".mp3").otherwise(".wav"))
    n = e.select("event_id", recording_name(name).alias("n"))
    return n.select("event_id", "n.transmitter_id", "n.mic_index", "n.started_at", "n.variant")


def q_with_end(spark, sf_dir):
    from logloom.sources.tables import load

    e = load(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 600).alias("s"))
    return with_end(e, "ts", "s").select("event_id", "ended_at")


QUERIES = {"filename_parse": q_filename_parse, "part_projection": q_with_end}
ORACLES = {
    "filename_parse": """SELECT event_id, CASE WHEN ok THEN 'TX0' || (event_id % 10) END AS transmitter_id, CASE WHEN ok THEN CAST(event_id % 1000 AS INTEGER) END AS mic_index,
      CASE WHEN ok THEN date_trunc('second', ts) END AS started_at, CASE WHEN ok THEN CASE WHEN event_id % 3 = 0 THEN 'orig' ELSE 'denoised' END END AS variant
      FROM (SELECT *, event_id % 11 <> 0 AND event_id % 7 <> 0 AS ok FROM events)""",
    "part_projection": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN ts + to_seconds(event_id % 600) END AS ended_at FROM events",
}
