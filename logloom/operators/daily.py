"""The daily note: what one device-day session leaves for its reader, rendered as Markdown in one expression."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import dims, text
from logloom.sources import load

# Words of the note.
FAILED_LINE = ("> ⚠ この日の録音のうち ", " 本が処理できませんでした。次にデバイスを接続したときに自動で再試行されます。")
SKIPPED_LINE = ("この日の録音のうち ", " 本を除外しました（", "）。自動では再試行されません。")
RETRY_ACTION = "デバイスから採り直してください。"
UNKNOWN_REASON = "理由不明"
REASONS = {"DUPLICATE_CONTENT": "重複", "SOURCE_MISSING": "元ファイルが見つかりません", "NORMALIZED_MISSING": "元ファイルが見つかりません", "NO_SPEECH_DETECTED": "無音"}

#: Sections in order with their headings, as a configuration would give them.
SECTIONS = {"summary": "## Summary", "key_points": "## Key points", "tasks": "## Tasks", "decisions": "## Decisions", "ideas": "## Ideas", "timeline": "## Timeline"}


def _bullets(items: Column) -> Column:
    return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x))


def _section(heading: Column | str, lines: Column) -> Column:
    """Heading, blank line, lines and blank line; nothing at all without lines."""
    head = F.lit(heading) if isinstance(heading, str) else heading
    return F.when(F.size(lines) > 0, F.concat(F.array(head, F.lit("")), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def skip_labels(codes: Column) -> Column:
    """Labels of distinct error codes in the order in which errors are declared, unknown ones last and as they are."""
    known = [e[1] for e in dims.errors()]
    seen = F.array_distinct(F.transform(codes, lambda c: F.coalesce(c, F.lit(""))))
    first = F.filter(F.array(*map(F.lit, known)), lambda c: F.array_contains(seen, c))
    others = F.array_sort(F.filter(seen, lambda c: ~c.isin(known)))
    labels = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.array_join(F.transform(F.concat(first, others), lambda c: F.coalesce(labels[c], F.when(c == "", F.lit(UNKNOWN_REASON)).otherwise(c))), "・")


def warnings(excluded: Column) -> Column:
    """At most two lines on parts left out of the note: failed ones come back by themselves, skipped ones don't, and ask
    for action unless all their reasons are benign. ``excluded``: array of partkey, status, error_code."""
    failed = F.filter(excluded, lambda p: p["status"] == "FAILED")
    skipped = F.filter(excluded, lambda p: p["status"] != "FAILED")
    codes = F.transform(skipped, lambda p: p["error_code"])
    act = F.exists(codes, lambda c: ~F.coalesce(c, F.lit("")).isin(*dims.BENIGN_SKIP_REASONS))
    one = F.concat(F.lit(FAILED_LINE[0]), F.size(failed).cast("string"), F.lit(FAILED_LINE[1]))
    two = F.concat(
        F.lit("> "), F.when(act, F.lit("⚠ ")).otherwise(""), F.lit(SKIPPED_LINE[0]), F.size(skipped).cast("string"), F.lit(SKIPPED_LINE[1]), skip_labels(codes), F.lit(SKIPPED_LINE[2]), F.when(act, F.lit(RETRY_ACTION)).otherwise("")
    )
    return F.array_compact(F.array(F.when(F.size(failed) > 0, one), F.when(F.size(skipped) > 0, two)))


def timeline_lines(blocks: Column) -> Column:
    """Lines of blocks (start_at, end_at, lines): a heading with both times, then what was said."""
    hm = lambda c: F.date_format(c, "HH:mm")
    return F.flatten(F.transform(blocks, lambda b: F.concat(F.array(F.concat(F.lit("### "), hm(b["start_at"]), F.lit("–"), hm(b["end_at"])), F.lit("")), _bullets(b["lines"]), F.array(F.lit("")))))


def daily_note(sessions: DataFrame, default_tags: list[str], sections: dict[str, str] = SECTIONS, keep: str = "session_key", prefix: str = "voice", names: dict[str, str] | None = None) -> DataFrame:
    """``keep`` and ``note`` of each session. Columns: session_key, day, recording_keys, excluded, recorded_seconds, blocks,
    analysis (title, summary, key_points, tasks of text and due, decisions, ideas, tags), timeline, links (raw, daily, adjacent, tags).

    Front matter, title (the day if there is none), warnings, the sections in their order, sources and links; what is
    empty has no heading. ``prefix`` begins the type, ``names`` renames fields of the front matter. One projection: tags are folded in batches, all else stays in the JVM.
    """
    a, none = F.col("analysis"), F.array().cast("array<string>")
    tags = F.concat(F.array(*map(F.lit, default_tags)).cast("array<string>"), F.coalesce(a["tags"], none))
    rows = sessions.withColumn("_tags", F.filter(F.transform(tags, lambda t: text.clean_tag(t)), lambda t: t != ""))
    rows = rows.withColumn("_folds", text.folds("_tags"))
    rows = rows.withColumn("_tags", text.stable_distinct(F.col("_tags"), F.col("_folds")))
    excluded = F.coalesce("excluded", F.array().cast("array<struct<partkey:string,status:string,error_code:string>>"))
    part_keys = lambda failed: F.transform(F.filter(excluded, lambda p: (p["status"] == "FAILED") == F.lit(failed)), lambda p: p["partkey"])
    day = F.date_format("day", "yyyy-MM-dd")
    fields = {
        "type": text.yaml_quote(F.lit(f"{prefix}-daily")), "session_key": text.yaml_quote(F.col("session_key")), "recording_keys": text.yaml_list(F.col("recording_keys")), "failed_parts": text.yaml_list(part_keys(True)),
        "skipped_parts": text.yaml_list(part_keys(False)), "date": text.yaml_quote(day), "recorded": text.yaml_quote(text.clock(F.col("recorded_seconds"))), "parts": F.size("recording_keys").cast("string"),
        "blocks": F.col("blocks").cast("string"), "status": text.yaml_quote(F.lit("processed")), "tags": text.yaml_list(F.col("_tags")),
    }
    head = text.front_matter(**{(names or {}).get(k, k): v for k, v in fields.items()})

    def lines(name: str) -> Column:
        if name == "timeline":
            return timeline_lines(F.coalesce("timeline", F.array().cast("array<struct<start_at:timestamp,end_at:timestamp,lines:array<string>>>")))
        if name == "summary":
            said = F.trim(F.regexp_replace(F.coalesce(a["summary"], F.lit("")), r"^\s+|\s+$", ""))
            return F.when(said != "", F.array(said)).otherwise(none)
        if name == "tasks":
            return F.transform(F.coalesce(a["tasks"], F.array().cast("array<struct<text:string,due:string>>")), lambda t: text.task_line(t["text"], t["due"]))
        return _bullets(a[name])

    def section(name: str, heading: str) -> Column:
        found = lines(name)
        # Blocks of the timeline end in a blank line of their own.
        return F.when(F.size(found) > 0, F.concat(F.array(F.lit(heading), F.lit("")), found)).otherwise(none) if name == "timeline" else _section(heading, found)

    title = F.when(F.coalesce(a["title"], F.lit("")) != "", a["title"]).otherwise(day)
    links = F.col("links")
    linked = F.concat(F.filter(F.concat(F.array(links["daily"]), F.coalesce(links["adjacent"], none)), lambda x: F.coalesce(x, F.lit("")) != ""), F.filter(F.coalesce(links["tags"], none), lambda x: x.startswith("[[")))
    body = F.concat(
        F.array(F.lit(""), F.concat(F.lit("# "), title), F.lit("")), F.flatten(F.transform(warnings(excluded), lambda w: F.array(w, F.lit("")))),
        *[section(n, h) for n, h in sections.items()], _section("## Sources", _bullets(links["raw"])), _section("## Links", _bullets(linked)),
    )
    whole = F.concat(F.regexp_replace(F.array_join(body, "\n"), r"\n+\z", ""), F.lit("\n"))
    return rows.select(keep, F.concat(head, text.escape_rules(whole)).alias("note"))


# -- queries ----------------------------------------------------------------------------------------------------------


def q_render_daily(spark, sf_dir):
    """Days of users as sessions: purchases are tasks, errors are parts left out, and the rest of a day its timeline."""
    e = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("k", F.col("event_id"))
    code = F.element_at(F.array(*[F.lit(x) for x in ("NO_SPEECH_DETECTED", "DUPLICATE_CONTENT", "SOURCE_MISSING", "ODD_CODE", None)]), (F.col("k") % 5 + 1).cast("int"))
    part = F.struct(F.concat(F.lit("p/"), F.col("k").cast("string")).alias("partkey"), F.when(F.col("k") % 2 == 0, "FAILED").otherwise("SKIPPED").alias("status"), code.alias("error_code"))
    at = F.struct("ts", "event_id")

    def listed(condition, item):
        return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct(at.alias("o"), item.alias("x"))))), lambda y: y["x"])

    kind = F.col("event_type")
    days = e.groupBy("user_id", "day").agg(
        listed(kind == "view", F.concat(F.lit("r/"), F.col("k").cast("string"))).alias("recording_keys"), listed(kind == "error", part).alias("excluded"),
        F.sum(F.when(kind == "view", F.floor("value"))).cast("double").alias("recorded_seconds"), F.count_if(kind == "click").alias("blocks"),
        listed(kind == "purchase", F.struct(F.concat(F.lit("buy "), F.col("k").cast("string")).alias("text"), F.when(F.col("k") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("due"))).alias("tasks"),
        listed(kind == "click", F.struct(F.col("ts").alias("start_at"), F.col("ts").alias("end_at"), F.array(F.concat(F.lit("click "), F.col("k").cast("string"))).alias("lines"))).alias("timeline"),
    )
    u = F.col("user_id")
    points = F.when(u % 3 == 0, F.array(F.lit("one"), F.lit("--- two"))).otherwise(F.array().cast("array<string>"))
    analysis = F.struct(
        F.when(u % 2 == 0, F.concat(F.lit("Day of "), u.cast("string"))).alias("title"), F.when(u % 4 != 0, F.lit(" A short day. ")).alias("summary"), points.alias("key_points"), F.col("tasks"),
        F.array().cast("array<string>").alias("decisions"), F.lit(None).cast("array<string>").alias("ideas"), F.array(F.lit("Voice"), F.lit("my tag"), F.concat(F.lit("u"), u.cast("string"))).alias("tags"),
    )
    links = F.struct(
        F.when(u % 5 != 0, F.array(F.concat(F.lit("[[raw "), u.cast("string"), F.lit("]]")))).alias("raw"), F.when(u % 2 == 1, F.lit("[[daily]]")).alias("daily"), F.array(F.lit("[[next]]"), F.lit("")).alias("adjacent"),
        F.array(F.lit("#plain"), F.lit("[[tag]]")).alias("tags"),
    )
    s = days.withColumn("analysis", analysis).withColumn("links", links).withColumn("session_key", F.concat(F.lit("d"), u.cast("string"), F.lit(":"), F.date_format("day", "yyyyMMdd")))
    return daily_note(s, ["voice"])


def _sql() -> str:
    def yaml(items: str) -> str:
        return f"CASE WHEN len({items}) > 0 THEN array_to_string(list_transform({items}, lambda x: nl || '  - \"' || x || '\"'), '') ELSE ' []' END"

    return f"""
WITH e AS (SELECT *, CAST(ts AS DATE) AS day, ['NO_SPEECH_DETECTED', 'DUPLICATE_CONTENT', 'SOURCE_MISSING', 'ODD_CODE', ''][event_id % 5 + 1] AS code FROM events),
 s AS (SELECT user_id AS u, day, chr(10) AS nl,
   coalesce(list('r/' || event_id ORDER BY ts, event_id) FILTER (event_type = 'view'), []) AS r,
   coalesce(list('p/' || event_id ORDER BY ts, event_id) FILTER (event_type = 'error' AND event_id % 2 = 0), []) AS f,
   coalesce(list('p/' || event_id ORDER BY ts, event_id) FILTER (event_type = 'error' AND event_id % 2 = 1), []) AS k,
   coalesce(list(DISTINCT code) FILTER (event_type = 'error' AND event_id % 2 = 1), []) AS c,
   coalesce(list('- [ ] buy ' || event_id || CASE WHEN event_id % 2 = 0 THEN ' 📅 ' || strftime(ts, '%Y-%m-%d') ELSE '' END ORDER BY ts, event_id) FILTER (event_type = 'purchase'), []) AS t,
   coalesce(list('### ' || strftime(ts, '%H:%M') || '–' || strftime(ts, '%H:%M') || chr(10) || chr(10) || '- click ' || event_id || chr(10) ORDER BY ts, event_id) FILTER (event_type = 'click'), []) AS l,
   CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN floor(value) END), 0) AS BIGINT) AS sec FROM e GROUP BY user_id, day),
 p AS (SELECT *, strftime(day, '%Y-%m-%d') AS d, list_filter([CASE WHEN list_contains(c, 'DUPLICATE_CONTENT') THEN '重複' END, CASE WHEN list_contains(c, 'SOURCE_MISSING') THEN '元ファイルが見つかりません' END,
   CASE WHEN list_contains(c, 'NO_SPEECH_DETECTED') THEN '無音' END, CASE WHEN list_contains(c, '') THEN '理由不明' END, CASE WHEN list_contains(c, 'ODD_CODE') THEN 'ODD_CODE' END], lambda x: x IS NOT NULL) AS why,
   list_contains(c, '') OR list_contains(c, 'ODD_CODE') OR list_contains(c, 'SOURCE_MISSING') AS act FROM s),
 b AS (SELECT *, list_filter([
   nl || '# ' || CASE WHEN u % 2 = 0 THEN 'Day of ' || u ELSE d END || nl,
   CASE WHEN len(f) > 0 THEN '> ⚠ この日の録音のうち ' || len(f) || ' 本が処理できませんでした。次にデバイスを接続したときに自動で再試行されます。' || nl END,
   CASE WHEN len(k) > 0 THEN '> ' || CASE WHEN act THEN '⚠ ' ELSE '' END || 'この日の録音のうち ' || len(k) || ' 本を除外しました（' || array_to_string(why, '・') || '）。自動では再試行されません。' || CASE WHEN act THEN 'デバイスから採り直してください。' ELSE '' END || nl END,
   CASE WHEN u % 4 <> 0 THEN '## Summary' || nl || nl || 'A short day.' || nl END,
   CASE WHEN u % 3 = 0 THEN '## Key points' || nl || nl || '- one' || nl || '- --- two' || nl END,
   CASE WHEN len(t) > 0 THEN '## Tasks' || nl || nl || array_to_string(t, chr(10)) || nl END,
   CASE WHEN len(l) > 0 THEN '## Timeline' || nl || nl || array_to_string(l, chr(10)) END,
   CASE WHEN u % 5 <> 0 THEN '## Sources' || nl || nl || '- [[raw ' || u || ']]' || nl END,
   '## Links' || nl || nl || CASE WHEN u % 2 = 1 THEN '- [[daily]]' || nl ELSE '' END || '- [[next]]' || nl || '- [[tag]]'], lambda x: x IS NOT NULL) AS parts FROM p)
SELECT 'd' || u || ':' || strftime(day, '%Y%m%d') AS session_key, '---' || nl || 'type: "voice-daily"' || nl || 'session_key: "d' || u || ':' || strftime(day, '%Y%m%d') || '"' || nl
  || 'recording_keys:' || {yaml("r")} || nl || 'failed_parts:' || {yaml("f")} || nl || 'skipped_parts:' || {yaml("k")} || nl || 'date: "' || d || '"' || nl
  || 'recorded: "' || lpad(CAST(sec // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') || '"' || nl
  || 'parts: ' || len(r) || nl || 'blocks: ' || len(l) || nl || 'status: "processed"' || nl || 'tags:' || nl || '  - "voice"' || nl || '  - "my-tag"' || nl || '  - "u' || u || '"' || nl || '---' || nl
  || array_to_string(parts, chr(10)) || nl AS note FROM b"""


QUERIES = {"render_daily": q_render_daily}
ORACLES = {"render_daily": _sql()}
