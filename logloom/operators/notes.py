"""Notes and keys in text: names, JSON cascades, links, rendering, fingerprints."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.functions import keys, text
from logloom.plans import splittable
from logloom.sources import load

#: Parts that the candidates of a note are dealt to.
SALTS = 32
# Characters that break a note link.
UNLINKABLE = r"[\[\]|#^]"


def linkable(name: Column) -> Column:
    return (F.length(F.trim(name)) > 0) & ~name.rlike(UNLINKABLE)


def link(name: Column) -> Column:
    return F.concat(F.lit("[["), name, F.lit("]]"))


def link_plan(candidates: DataFrame, by: list[str], place: str, kind: str, name: str, existing: DataFrame, budget: int, own: str | None = None, only_existing: bool = True) -> DataFrame:
    """Candidates of each note in order (daily, adjacent, then tags by ``place``) with ``rendered`` and ``dropped``.

    A candidate that is unlinkable or the note itself is dropped. Daily and adjacent ones always want a link, tags want
    one if they exist (``existing`` has folded names; small, so broadcast below Spark's size threshold). Links go out in
    order (``place`` is unique in a note) while the budget lasts: up to the last want that it holds, which is found among
    the first wants of SALTS parts of each note, so a note with a third of all candidates is not one window. A tag beyond
    it becomes a plain tag and is noted as dropped; a tag that wants none is a plain tag; a daily or adjacent one beyond it
    is only dropped. A note that is null has no links.
    """
    c = candidates.withColumn("_folded", text.nfc_fold(F.col(name)))
    known = existing.select(F.col("folded").alias("_folded"), F.lit(True).alias("_known")).distinct()
    c = c.join(known, "_folded", "left").withColumn("_usable", linkable(F.col(name)) & ((F.col(name) != F.col(own)) if own else F.lit(True)))
    tag = F.col(kind) == "tag"
    wants = F.col("_usable") & (~tag | (F.coalesce(F.col("_known"), F.lit(False)) | F.lit(not only_existing)))
    c = c.withColumn("_wants", wants).withColumn("_o", F.struct(F.when(F.col(kind) == "daily", 0).when(F.col(kind) == "adjacent", 1).otherwise(2).alias("kind"), F.col(place).alias("place")))
    part = Window.partitionBy(*by, "_part").orderBy("_o")
    first = c.filter("_wants").select(*by, "_o", F.pmod(F.xxhash64("_o"), F.lit(SALTS)).alias("_part")).withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= budget)
    held = first.groupBy(*by).agg(F.array_max(F.slice(F.array_sort(F.collect_list("_o")), 1, max(1, budget))).alias("_last"))
    c = c.join(splittable(held, "link-budgets"), by, "left")
    linked = F.col("_wants") & F.coalesce(F.col("_o") <= F.col("_last"), F.lit(False)) & F.lit(budget > 0)
    rendered = F.when(linked, link(F.col(name))).when(F.col("_usable") & tag, F.concat(F.lit("#"), F.col(name)))
    return c.withColumn("rendered", rendered).withColumn("dropped", ~F.col("_usable") | (F.col("_wants") & ~linked)).drop("_folded", "_known", "_usable", "_wants", "_o", "_last")


#: Files that share a name, at most.
NUMBERED = 99


def numbered_names(notes: DataFrame, folder: str, name: str, key: str, order: list[str]) -> DataFrame:
    """File names without collisions: in a folder the first owner of a name keeps it, later keys get (2) to (99);
    beyond that the row's ``file`` is null. Notes of one key share one file."""
    first = notes.groupBy(folder, name, key).agg(F.min(F.struct(*order)).alias("_first"))
    # A name with any number of keys is many parts; the first keys of each are all that the first of the name can be.
    part = Window.partitionBy(folder, name, "_part").orderBy("_first", key)
    few = first.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(SALTS))).withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= NUMBERED)
    named = few.withColumn("_n", F.row_number().over(Window.partitionBy(folder, name).orderBy("_first", key))).filter(F.col("_n") <= NUMBERED)
    file = F.when(F.col("_n") == 1, F.concat(F.col(name), F.lit(".md"))).otherwise(F.format_string("%s (%d).md", F.col(name), F.col("_n")))
    return notes.join(named.select(folder, name, key, file.alias("file")), [folder, name, key], "left")


def fingerprints(segments: DataFrame, by: list[str], order: list[str], at: str, end_at: str, said: str) -> DataFrame:
    """SHA-256 over the canonical JSON of each session's ordered segments; equal content, equal fingerprint."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(stamp(at).alias("at"), stamp(end_at).alias("end_at"), F.col(said).alias("text")).alias("s"))
    g = segments.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("segments"))
    return g.select(*by, F.sha2(F.to_json(F.struct("segments")), 256).alias("fingerprint"))


def reusable(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Whether stored work may be reused: fingerprints equal; missing or unknown means work again."""
    s = stored.select(key, F.col("fingerprint").alias("_old"))
    return wanted.join(s, key, "left").withColumn("reuse", F.coalesce(F.col("fingerprint") == F.col("_old"), F.lit(False))).drop("_old")


def raw_note(segments: DataFrame, by: list[str], order: list[str], seconds: str, said: str, interval: float, title: Column) -> DataFrame:
    """Markdown of each session: front matter, then the ordered lines under clock headings at each mark."""
    from logloom.operators.chunks import gathered, mark_flags

    g = gathered(segments, by, order, t=F.col(seconds).cast("double"), said=F.col(said))
    flags = mark_flags(F.transform("items", lambda x: x["t"]), interval)
    z = F.arrays_zip(F.col("items").alias("i"), flags.alias("m"))
    lines = F.transform(z, lambda x: F.concat(F.when(x["m"], F.concat(F.lit("\n## "), text.clock(x["i"]["t"]), F.lit("\n\n"))).otherwise(""), x["i"]["said"]))
    head = text.front_matter(type=text.yaml_quote(F.lit("voice-raw")), session_key=text.yaml_quote(title), parts=F.size("items").cast("string"))
    return g.select(*by, F.concat(head, text.escape_rules(F.concat(F.array_join(lines, "\n"), F.lit("\n")))).alias("note"))


# -- queries ----------------------------------------------------------------------------------------------------------


def q_sanitize_names(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", text.file_name(F.col("url"), 40).alias("file_name"))


def q_truncate_text(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.short(F.col("text"))).alias("short_md5"), F.length(text.short(F.col("text"))).alias("n"))


def q_json_cascade(spark, sf_dir):
    """Event properties wrapped as a model would: thoughts, fences, prose, strings with braces, or nothing."""
    e = load(spark, sf_dir, "events").select("event_id", "props")
    k = F.pmod("event_id", F.lit(5))
    odd = F.concat(F.lit('{"s": "}{", "p": '), "props", F.lit("}"))
    answer = (
        F.when(k == 0, F.concat(F.lit('<think>{"no": 1}</think> '), "props")).when(k == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone")))
        .when(k == 2, F.concat(F.lit("It is "), odd, F.lit(" as asked"))).when(k == 3, F.lit("<think>never closed {}")).otherwise(F.col("props"))
    )
    return e.select("event_id", text.extract_object(answer).alias("object"))


def q_dedupe_stable(spark, sf_dir):
    """Words of each turn, first of equal folds kept, in order."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split(F.regexp_replace("text", r"[^A-Za-z]+", " "), " "), lambda w: w != "").alias("words"))
    c = c.withColumn("folded", text.nfkc_folds("words"))
    kept = text.stable_distinct(F.col("words"), F.col("folded"))
    return c.select("conv_id", "turn", F.size(kept).alias("n_kept"), F.md5(F.array_join(kept, " ")).alias("kept_md5"))


def q_tags(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.array(F.lit("voice memo"), F.concat(F.lit(" Voice Memo "), "source"), F.concat(F.lit("VOICE MEMO "), "source"), "lang", F.upper("lang"), F.lit(" ")).alias("t"))
    clean = F.filter(F.transform("t", lambda x: text.clean_tag(x)), lambda x: x != "")
    d = d.select("doc_id", clean.alias("clean")).withColumn("folded", text.folds("clean"))
    kept = text.stable_distinct(F.col("clean"), F.col("folded"))
    return d.select("doc_id", F.array_join(kept, ",").alias("tags"))


def q_link_plan(spark, sf_dir):
    p = load(spark, sf_dir, "pages").filter("url IS NOT NULL")
    site, tail = F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_extract("url", "/([^/]*)$", 1)
    c = p.select(site.alias("site"), "page_id", F.when(F.col("page_id") % 7 == 0, "daily").when(F.col("page_id") % 7 == 1, "adjacent").otherwise("tag").alias("kind"), tail.alias("name"))
    existing = p.filter(F.col("url").startswith("https")).select(text.nfc_fold(tail).alias("folded")).distinct()
    plan = link_plan(c, ["site"], "page_id", "kind", "name", existing, 2)
    return plan.select("site", "page_id", "kind", "rendered", "dropped")


def q_numbered_names(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("n"), F.floor(F.length("text") / 100).cast("string")).alias("name"), F.col("source").alias("k"))
    return numbered_names(d, "lang", "name", "k", ["doc_id"]).select("doc_id", "file")


def q_reuse(spark, sf_dir):
    """Fingerprints of conversations against those stored when each fifth was another and each seventh unknown."""
    now = q_fingerprint(spark, sf_dir)
    k = F.col("conv_id")
    stored = now.filter(k % 7 != 0).select("conv_id", F.when(k % 5 == 0, F.reverse("fingerprint")).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return reusable(now, stored, "conv_id").select("conv_id", "reuse")


def q_fingerprint(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    at = lambda s: (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=s.cast("decimal(18,6)"))).cast("timestamp_ntz")
    s = c.select("conv_id", "turn", at(F.col("turn") * 30).alias("at"), at(F.col("turn") * 30 + 10).alias("end_at"), F.md5("text").alias("text"))
    return fingerprints(s, ["conv_id"], ["turn"], "at", "end_at", "text")


def q_render_raw_note(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 30).alias("s"), F.concat(F.lit("--- "), F.md5("text")).alias("t"))
    n = raw_note(c, ["conv_id"], ["turn"], "s", "t", 60.0, F.concat(F.lit('dev"'), F.col("conv_id").cast("string")))
    return n.select("conv_id", "note")


def q_clock(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.clock(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") - 5000)).alias("clock"))


def q_session_keys(spark, sf_dir):
    """Keys composed and parsed back, with the day taken in another zone than UTC."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    day = keys.day_of(F.col("ts").cast("timestamp"), "Asia/Tokyo")
    k = keys.session_key(F.concat(F.lit("dev#"), F.col("user_id").cast("string")), day, F.col("event_id") % 3)
    e = e.withColumn("session_key", k).withColumn("p", keys.session_parts(F.col("session_key")))
    return e.select("event_id", "session_key", F.col("p.device_id").alias("device_id"), F.date_format("p.day", "yyyy-MM-dd").alias("day"), F.col("p.overflow").alias("overflow"))


_WORDS = "list_filter(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), lambda w: w <> '')"

QUERIES = {
    "sanitize_names": q_sanitize_names,
    "truncate_text": q_truncate_text,
    "json_extract_cascade": q_json_cascade,
    "dedupe_stable": q_dedupe_stable,
    "tag_cleanup": q_tags,
    "link_plan": q_link_plan,
    "numbered_names": q_numbered_names,
    "fingerprint": q_fingerprint,
    "fingerprint_reuse": q_reuse,
    "render_raw_note": q_render_raw_note,
    "clock_format": q_clock,
    "session_keys": q_session_keys,
}
ORACLES = {
    "sanitize_names": """WITH a AS (SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(url), '[/\\\\:*?"<>|]', '-', 'g'), '[#^\\[\\]]', '', 'g'), '\\s+', ' ', 'g')), '^\\.+|\\.+$', '', 'g') AS t FROM pages),
      b AS (SELECT page_id, t, list_max(list_filter(range(0, length(t) + 1), lambda n: strlen(substring(t, 1, n)) <= 40)) AS n FROM a)
      SELECT page_id, CASE WHEN t IS NULL THEN NULL WHEN substring(t, 1, n) = '' THEN 'Untitled' ELSE substring(t, 1, n) END AS file_name FROM b""",
    "truncate_text": "SELECT doc_id, md5(s) AS short_md5, CAST(length(s) AS INTEGER) AS n FROM (SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 199) || '…' ELSE text END AS s FROM documents)",
    "json_extract_cascade": """SELECT event_id, CASE event_id % 5 WHEN 2 THEN '{"s": "}{", "p": ' || props || '}' WHEN 3 THEN NULL ELSE props END AS object FROM events""",
    "dedupe_stable": f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w, list_transform({_WORDS}, lambda x: lower(x)) AS l FROM conversations),
      k AS (SELECT conv_id, turn, [w[i] FOR i IN range(1, len(w) + 1) IF list_position(l, l[i]) = i] AS k FROM w)
      SELECT conv_id, turn, CAST(len(k) AS INTEGER) AS n_kept, md5(array_to_string(k, ' ')) AS kept_md5 FROM k""",
    "tag_cleanup": "SELECT doc_id, 'voice-memo,Voice-Memo-' || source || ',' || lang AS tags FROM documents",
    "link_plan": """WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS site, regexp_extract(url, '/([^/]*)$', 1) AS name,
        CASE page_id % 7 WHEN 0 THEN 'daily' WHEN 1 THEN 'adjacent' ELSE 'tag' END AS kind FROM pages WHERE url IS NOT NULL),
      u AS (SELECT *, trim(name) <> '' AND NOT regexp_matches(name, '[\\[\\]|#^]') AS usable, lower(name) IN (SELECT lower(name) FROM p WHERE url LIKE 'https%') AS known FROM p),
      w AS (SELECT *, usable AND (kind <> 'tag' OR known) AS wants FROM u),
      n AS (SELECT *, sum(CAST(wants AS INTEGER)) OVER (PARTITION BY site ORDER BY CASE kind WHEN 'daily' THEN 0 WHEN 'adjacent' THEN 1 ELSE 2 END, page_id ROWS UNBOUNDED PRECEDING) AS c FROM w)
      SELECT site, page_id, kind, CASE WHEN wants AND c <= 2 THEN '[[' || name || ']]' WHEN usable AND kind = 'tag' THEN '#' || name END AS rendered, NOT usable OR (wants AND c > 2) AS dropped FROM n""",
    "numbered_names": """WITH f AS (SELECT lang, 'n' || (length(text) // 100) AS name, source AS k, min(doc_id) AS f FROM documents GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (PARTITION BY lang, name ORDER BY f, k) AS n FROM f)
      SELECT doc_id, CASE WHEN n = 1 THEN name || '.md' WHEN n <= 99 THEN name || ' (' || n || ').md' END AS file FROM documents d JOIN n ON n.lang = d.lang AND n.name = 'n' || (length(text) // 100) AND k = source""",
    "fingerprint_reuse": "SELECT conv_id, conv_id % 5 <> 0 AND conv_id % 7 <> 0 AS reuse FROM conversations GROUP BY conv_id",
    "fingerprint": """SELECT conv_id, sha256('{"segments":[' || string_agg('{"at":"' || strftime(TIMESTAMP '2024-01-01' + to_seconds(turn * 30), '%Y-%m-%dT%H:%M:%S') || '","end_at":"' ||
      strftime(TIMESTAMP '2024-01-01' + to_seconds(turn * 30 + 10), '%Y-%m-%dT%H:%M:%S') || '","text":"' || md5(text) || '"}', ',' ORDER BY turn) || ']}') AS fingerprint FROM conversations GROUP BY conv_id""",
    "render_raw_note": """WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN chr(10) || '## ' || strftime(TIMESTAMP '2024-01-01' + to_seconds(turn * 30), '%H:%M:%S') || chr(10) || chr(10) ELSE '' END || '\\--- ' || md5(text) AS x FROM conversations)
      SELECT conv_id, '---' || chr(10) || 'type: "voice-raw"' || chr(10) || 'session_key: "dev\\"' || conv_id || '"' || chr(10) || 'parts: ' || count(*) || chr(10) || '---' || chr(10) || string_agg(x, chr(10) ORDER BY turn) || chr(10) AS note FROM l GROUP BY conv_id""",
    "clock_format": """WITH s AS (SELECT o_orderkey, CAST(floor(greatest(coalesce(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice - 5000 END, 0), 0)) AS BIGINT) AS s FROM orders)
      SELECT o_orderkey, CASE WHEN s // 3600 < 100 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') ELSE CAST(s // 3600 AS VARCHAR) END || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM s""",
    "session_keys": """WITH d AS (SELECT event_id, 'dev#' || user_id AS dev, ts + INTERVAL 9 HOUR AS l, event_id % 3 AS o FROM events)
      SELECT event_id, CASE WHEN o >= 1 THEN dev || ':' || strftime(l, '%Y%m%d') || CASE WHEN o > 1 THEN '#' || o ELSE '' END END AS session_key, CASE WHEN o >= 1 THEN dev END AS device_id,
      CASE WHEN o >= 1 THEN strftime(l, '%Y-%m-%d') END AS day, CASE WHEN o >= 1 THEN CAST(o AS INTEGER) END AS overflow FROM d""",
}
