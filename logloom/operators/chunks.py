"""Greedy folds over ordered items of one session: chunks with overlap, bundles, marks, and the hierarchical reduce.

The items of a session are a bounded list (a day of one device, one conversation), never all that a device has ever
recorded; each fold is one higher-order function over prefix sums, so it runs in the JVM next to the aggregation that
gathers the list. A fold copies the list it builds at each step, which only such bounded lists allow.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators import cuts
from logloom.sources import load


def gathered(rows: DataFrame, by: list[str], order: list[str], **columns: Column) -> DataFrame:
    """``items``: array of structs of ``order`` and ``columns``, sorted by ``order``."""
    item = F.struct(*[F.col(c) for c in order], *[c.alias(n) for n, c in columns.items()])
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))


def prefix_sums(items: Column, size: str) -> Column:
    """sums[i]: total size of the first i items; n + 1 entries."""
    zero = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(items, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x[size].cast("bigint"))))


def chunk_bounds(items: Column, sums: Column, max_chars: int, max_seconds: float, overlap_chars: int) -> Column:
    """Array of [start, stop) item ranges. Before item i joins, a chunk is cut if its characters would exceed
    ``max_chars`` or its time from the first start to i's end would exceed ``max_seconds``. A cut by characters carries
    over the longest tail of whole items within ``overlap_chars`` (one at least, never the whole chunk); a cut by time
    carries nothing. Fields of items: start, stop (seconds), size."""
    n = F.size(items)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        first = F.get(items, acc["at"])
        over_time = F.get(items, i)["stop"] - first["start"] > max_seconds
        over_chars = F.get(sums, i + 1) - F.get(sums, acc["at"]) > max_chars
        within = F.filter(F.sequence(acc["at"], i - 1), lambda j: F.get(sums, i) - F.get(sums, j) <= overlap_chars)
        tail = F.greatest(F.coalesce(F.array_min(within), i - 1), acc["at"] + 1) if overlap_chars > 0 else i
        cut = (i > acc["at"]) & (over_time | over_chars)
        closed = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), i.alias("stop"))))
        return F.struct(F.when(cut & over_time, i).when(cut, tail).otherwise(acc["at"]).alias("at"), F.when(cut, closed).otherwise(acc["out"]).alias("out"))

    last = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), n.alias("stop"))))
    return F.aggregate(F.sequence(F.lit(0), n - 1), begin, step, last)


def without_repeated_tail(values: Column, bounds: Column) -> Column:
    """``bounds`` without a last chunk whose values all occur in the chunk before (equal segments, told twice)."""
    n = F.size(bounds)
    part = lambda b: F.slice(values, b["start"] + 1, b["stop"] - b["start"])
    last, before = F.get(bounds, n - 1), F.get(bounds, n - 2)
    return F.when((n >= 2) & (F.size(F.array_except(part(last), part(before))) == 0), F.slice(bounds, F.lit(1), n - 1)).otherwise(bounds)


def bundle_bounds(items: Column, sums: Column, limit: int, per_item: int = 1, frame: int = 1) -> Column:
    """Array of [start, stop): items are packed in order while the length of their JSON array (sizes, a separator of
    ``per_item`` after each, ``frame`` once) stays within ``limit``; a larger item is a bundle of its own."""
    n = F.size(items)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        cut = (i > acc["at"]) & (F.get(sums, i + 1) - F.get(sums, acc["at"]) + (i + 1 - acc["at"]) * per_item + frame > limit)
        closed = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), i.alias("stop"))))
        return F.struct(F.when(cut, i).otherwise(acc["at"]).alias("at"), F.when(cut, closed).otherwise(acc["out"]).alias("out"))

    last = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), n.alias("stop"))))
    return F.aggregate(F.sequence(F.lit(0), n - 1), begin, step, last)


def mark_flags(times: Column, interval: float) -> Column:
    """One boolean per time: true at the first and wherever ``interval`` has passed since the last mark's own time."""
    begin = F.struct(F.lit(None).cast("double").alias("t"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        m = (acc["t"].isNull() | (t >= acc["t"] + interval)) if interval > 0 else F.lit(False)
        return F.struct(F.when(m, t).otherwise(acc["t"]).alias("t"), F.concat(acc["out"], F.array(m)).alias("out"))

    return F.aggregate(times, begin, step, lambda a: a["out"])


def hierarchical_reduce(items: DataFrame, by: list[str], place: str, size: str, limit: int, fold, max_depth: int = 3) -> DataFrame:
    """Folds the items of each session until their JSON fits ``limit`` or one is left: ``by``, ``n_items``, ``size``,
    ``depth`` and ``error`` (too deep). ``fold`` maps bundles (by, place, sizes array) to the size of a folded item, as a
    model's summary would; each level is one grouped pass, and sessions that are done take no part in the next."""
    done, level = None, items.select(*by, place, size)
    for depth in range(1, max_depth + 1):
        g = gathered(level, by, [place], size=F.col(size).cast("bigint"))
        g = g.withColumn("sums", prefix_sums(F.col("items"), "size"))
        total = F.element_at("sums", -1) + F.size("items") + 1
        ends = (total <= limit) | (F.size("items") <= 1) | F.lit(depth == max_depth)
        fits = (total <= limit) | (F.size("items") <= 1)
        out = g.filter(ends).select(*by, F.size("items").cast("bigint").alias("n_items"), total.cast("bigint").alias("size"), F.lit(depth).alias("depth"), F.when(~fits, "too deep").alias("error"))
        done = out if done is None else done.unionByName(out)
        if depth == max_depth:
            break
        cut = g.filter(~ends).withColumn("b", bundle_bounds(F.col("items"), F.col("sums"), limit))
        each = cut.select(*by, "items", F.posexplode("b").alias(place, "b"))
        sizes = F.transform(F.slice("items", F.col("b.start") + 1, F.col("b.stop") - F.col("b.start")), lambda x: x["size"])
        level = each.select(*by, F.col(place).cast("bigint").alias(place), fold(sizes).cast("bigint").alias(size))
    return done


def timeline(chunks: DataFrame, partials: DataFrame, by: list[str], place: str) -> DataFrame:
    """Chunk times with the key points of the partial result at the same place, else the sentences of its summary;
    chunks without either have no line. Positions pair up; what one side has more is left out."""
    lines = F.when(F.size("key_points") > 0, F.col("key_points")).otherwise(sentences(F.col("summary")))
    return chunks.join(partials, [*by, place]).withColumn("lines", lines).filter(F.size("lines") > 0)


def sentences(text: Column) -> Column:
    """Pieces after each ideographic full stop and line break, trimmed, without empty ones."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "。", "。\n"), r"\R")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


# -- queries ----------------------------------------------------------------------------------------------------------

CHARS, SECONDS, OVERLAP, BUNDLE, FOLD_LIMIT, INTERVAL = 2000, 90.0, 700, 3000, 1500, 14400.0


def _turns(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    start = (F.col("turn") * 30).cast("double")
    return gathered(c, ["conv_id"], ["turn"], start=start, stop=start + F.length("text") % 40, size=F.length("text").cast("bigint"))


def q_chunk_segments(spark, sf_dir):
    g = _turns(spark, sf_dir).withColumn("sums", prefix_sums(F.col("items"), "size"))
    c = g.select("conv_id", "items", "sums", F.posexplode(chunk_bounds(F.col("items"), F.col("sums"), CHARS, SECONDS, OVERLAP)).alias("chunk", "b"))
    part = F.slice("items", F.col("b.start") + 1, F.col("b.stop") - F.col("b.start"))
    return c.select(
        "conv_id", "chunk", F.get("items", F.col("b.start"))["turn"].alias("first_turn"), F.get("items", F.col("b.stop") - 1)["turn"].alias("last_turn"),
        (F.get("sums", F.col("b.stop")) - F.get("sums", F.col("b.start"))).alias("chars"), F.array_max(F.transform(part, lambda x: x["stop"])).alias("end_s"),
    )


def q_chunk_tails(spark, sf_dir):
    """Chunks of turns whose texts are told by role: a last chunk that only repeats roles of the one before goes."""
    c = load(spark, sf_dir, "conversations")
    start = (F.col("turn") * 30).cast("double")
    g = gathered(c, ["conv_id"], ["turn"], start=start, stop=start + F.length("text") % 40, size=F.length("text").cast("bigint"), role=F.col("role")).withColumn("sums", prefix_sums(F.col("items"), "size"))
    g = g.withColumn("bounds", chunk_bounds(F.col("items"), F.col("sums"), CHARS, SECONDS, OVERLAP))
    told = without_repeated_tail(F.transform("items", lambda x: x["role"]), F.col("bounds"))
    return g.select("conv_id", F.size("bounds").alias("n_chunks"), F.size(told).alias("n_told"))


def q_bundle_greedy(spark, sf_dir):
    """Short conversations are one list each; of longer ones no list is made."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))
    short, long = cuts.split_by_length(c, "conv_id")
    g = gathered(short, ["conv_id"], ["turn"], size=F.col("size")).withColumn("sums", prefix_sums(F.col("items"), "size"))
    b = g.select("conv_id", "sums", F.posexplode(bundle_bounds(F.col("items"), F.col("sums"), BUNDLE)).alias("bundle", "b"))
    near = b.select("conv_id", "bundle", (F.col("b.stop") - F.col("b.start")).alias("n_items"), (F.get("sums", F.col("b.stop")) - F.get("sums", F.col("b.start"))).alias("chars"))
    if long is None:
        return near
    far = cuts.bundles(long, "conv_id", ["turn"], F.floor(F.col("turn") / 1000), "size", BUNDLE)
    return near.unionByName(far.groupBy("conv_id", "bundle").agg(F.count("*").cast("int").alias("n_items"), F.sum("size").alias("chars")))


def q_hier_reduce(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))
    return hierarchical_reduce(c, ["conv_id"], "turn", "size", FOLD_LIMIT, F.array_max)


def q_timestamp_marks(spark, sf_dir):
    """Marks of each user's day, of which at least four hours lie between two. Days of few events are one list each; of
    longer ones no list is made."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    e = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", t.alias("t"))
    short, long = cuts.split_by_length(e.withColumn("of", F.struct("user_id", "day")), "of")
    g = gathered(short, ["user_id", "day"], ["ts", "event_id"], t=F.col("t"))
    flags = mark_flags(F.transform("items", lambda x: x["t"]), INTERVAL)
    z = g.select("user_id", F.explode(F.arrays_zip(F.col("items").alias("i"), flags.alias("m"))).alias("x"))
    near = z.select("user_id", F.col("x.i.event_id").alias("event_id"), F.col("x.m").alias("marked"))
    if long is None:
        return near
    return near.unionByName(cuts.marks(long, "of", ["ts", "event_id"], F.hour("ts"), "t", INTERVAL).select("user_id", "event_id", "marked"))


def q_timeline(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    chunks = c.select("conv_id", F.col("turn").alias("place"), (F.col("turn") * 30).alias("start_s"))
    points = F.when(F.col("turn") % 3 == 0, F.array(F.md5("text"))).otherwise(F.array().cast("array<string>"))
    partials = c.filter("role <> 'system'").select("conv_id", F.col("turn").alias("place"), points.alias("key_points"), F.translate("text", ".", "。").alias("summary"))
    t = timeline(chunks, partials, ["conv_id"], "place")
    return t.select("conv_id", "place", "start_s", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"))


_T = "t AS (SELECT conv_id, turn, turn * 30.0::DOUBLE AS a, turn * 30.0::DOUBLE + length(text) % 40 AS z, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"

QUERIES = {
    "chunk_segments": q_chunk_segments,
    "chunk_repeated_tail": q_chunk_tails,
    "bundle_greedy": q_bundle_greedy,
    "hier_reduce": q_hier_reduce,
    "timestamp_marks": q_timestamp_marks,
    "timeline_build": q_timeline,
}


def _fold(source: str, level: int) -> str:
    """Common table expressions of one level: totals, what ends here, and the folded items of the rest."""
    last = level == 3
    out = f"""g{level} AS (SELECT conv_id, count(*) AS n, CAST(sum(s) AS BIGINT) + count(*) + 1 AS total FROM {source} GROUP BY conv_id),
     e{level} AS (SELECT conv_id, n AS n_items, total AS size, {level} AS depth, CASE WHEN total > {FOLD_LIMIT} AND n > 1 THEN 'too deep' END AS error
        FROM g{level} {"" if last else f"WHERE total <= {FOLD_LIMIT} OR n <= 1"})"""
    if not last:
        out += f""",
     r{level} AS (SELECT conv_id, s, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS i FROM {source} SEMI JOIN (SELECT conv_id FROM g{level} WHERE total > {FOLD_LIMIT} AND n > 1) USING (conv_id)),
     b{level} AS (SELECT conv_id, i, s, 0 AS b, s + 2 AS size FROM r{level} WHERE i = 0
       UNION ALL SELECT r.conv_id, r.i, r.s, CASE WHEN b.size + r.s + 1 > {FOLD_LIMIT} THEN b.b + 1 ELSE b.b END, CASE WHEN b.size + r.s + 1 > {FOLD_LIMIT} THEN r.s + 2 ELSE b.size + r.s + 1 END
       FROM b{level} b JOIN r{level} r ON r.conv_id = b.conv_id AND r.i = b.i + 1),
     l{level} AS (SELECT conv_id, b AS i, max(s) AS s FROM b{level} GROUP BY conv_id, b)"""
    return out


_CHUNKS = f"""WITH RECURSIVE {_T}, x AS (SELECT conv_id, i, turn, a, z, s, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM t),
       f AS (SELECT conv_id, i, 0::BIGINT AS lo, NULL::BIGINT AS cut FROM x WHERE i = 0
        UNION ALL SELECT n.conv_id, n.i,
         CASE WHEN n.z - h.a > {SECONDS} THEN n.i WHEN n.c - (h.c - h.s) > {CHARS}
          THEN greatest(coalesce((SELECT min(q.i) FROM x q WHERE q.conv_id = n.conv_id AND q.i >= f.lo AND q.i < n.i AND (n.c - n.s) - (q.c - q.s) <= {OVERLAP}), n.i - 1), f.lo + 1) ELSE f.lo END,
         CASE WHEN n.z - h.a > {SECONDS} OR n.c - (h.c - h.s) > {CHARS} THEN f.lo END
        FROM f JOIN x n ON n.conv_id = f.conv_id AND n.i = f.i + 1 JOIN x h ON h.conv_id = f.conv_id AND h.i = f.lo),
       b AS (SELECT conv_id, cut AS lo, i AS hi FROM f WHERE cut IS NOT NULL UNION ALL SELECT conv_id, arg_max(lo, i), max(i) + 1 FROM f GROUP BY conv_id)"""

ORACLES = {
    "chunk_segments": f"""{_CHUNKS}
       SELECT b.conv_id, CAST(row_number() OVER (PARTITION BY b.conv_id ORDER BY b.hi) - 1 AS INTEGER) AS chunk, p.turn AS first_turn, q.turn AS last_turn, q.c - (p.c - p.s) AS chars,
       (SELECT max(k.z) FROM x k WHERE k.conv_id = b.conv_id AND k.i >= b.lo AND k.i < b.hi) AS end_s
       FROM b JOIN x p ON p.conv_id = b.conv_id AND p.i = b.lo JOIN x q ON q.conv_id = b.conv_id AND q.i = b.hi - 1""",
    "chunk_repeated_tail": f"""{_CHUNKS},
       c AS (SELECT b.conv_id, hi, list(DISTINCT role) AS r FROM b JOIN (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) t ON t.conv_id = b.conv_id AND t.i >= b.lo AND t.i < b.hi GROUP BY 1, 2),
       d AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY hi) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY hi DESC) AS back FROM c)
       SELECT conv_id, CAST(count(*) AS INTEGER) AS n_chunks, CAST(count(*) - count(CASE WHEN back = 1 AND before IS NOT NULL AND list_has_all(before, r) THEN 1 END) AS INTEGER) AS n_told FROM d GROUP BY 1""",
    "bundle_greedy": f"""WITH RECURSIVE {_T}, f AS (SELECT conv_id, i, s, 0 AS b, s + 2 AS size FROM t WHERE i = 0
       UNION ALL SELECT t.conv_id, t.i, t.s, CASE WHEN f.size + t.s + 1 > {BUNDLE} THEN f.b + 1 ELSE f.b END, CASE WHEN f.size + t.s + 1 > {BUNDLE} THEN t.s + 2 ELSE f.size + t.s + 1 END
       FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
       SELECT conv_id, b AS bundle, CAST(count(*) AS INTEGER) AS n_items, CAST(sum(s) AS BIGINT) AS chars FROM f GROUP BY conv_id, b""",
    "hier_reduce": f"WITH RECURSIVE {_T}, {_fold('t', 1)}, {_fold('l1', 2)}, {_fold('l2', 3)} SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3",
    "timestamp_marks": f"""WITH RECURSIVE e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, floor(epoch(ts)) AS t, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events),
       f AS (SELECT user_id, day, event_id, i, t AS last, true AS marked FROM e WHERE i = 1
        UNION ALL SELECT e.user_id, e.day, e.event_id, e.i, CASE WHEN e.t >= f.last + {INTERVAL} THEN e.t ELSE f.last END, e.t >= f.last + {INTERVAL} FROM f JOIN e ON e.user_id = f.user_id AND e.day = f.day AND e.i = f.i + 1)
       SELECT user_id, event_id, marked FROM f""",
    "timeline_build": """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN [md5(text)] ELSE
        list_filter(list_transform(string_split(replace(replace(text, '.', '。'), '。', '。' || chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') END AS l FROM conversations WHERE role <> 'system')
        SELECT conv_id, turn AS place, turn * 30 AS start_s, CAST(len(l) AS INTEGER) AS n_lines, md5(array_to_string(l, chr(10))) AS lines_md5 FROM c WHERE len(l) > 0""",
}
