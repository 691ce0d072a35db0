"""The hierarchical reduce with its contents: partial analyses merged in bundles, level by level, until one is left."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.operators import analysis, cuts
from logloom.operators.chunks import bundle_bounds, gathered, prefix_sums
from logloom.plans import Scratch
from logloom.sources import load

#: Texts of a partial analysis that are lists.
LISTS = ("key_points", "decisions", "ideas")


def merged(rows: DataFrame, docs: str, doc: str, limits: dict[str, int]) -> DataFrame:
    """``rows`` with ``doc``, one analysis of the array ``docs`` of them, in their order: the first summary; each list without
    items that came before (equal but for width, case and outer space); tasks by their text, whatever their due; lists cut to
    ``limits``."""

    def all_of(name: str, kind: str) -> Column:
        return F.flatten(F.transform(docs, lambda d: F.coalesce(d[name], F.array().cast(kind))))

    out = rows.select("*", *[all_of(n, "array<string>").alias(f"_{n}") for n in LISTS], all_of("tasks", "array<struct<text:string,due:string>>").alias("_tasks"))
    names = (*LISTS, "tasks")
    out = out.select("*", *[text.nfkc_folds(F.transform("_tasks", lambda t: t["text"]) if n == "tasks" else F.col(f"_{n}")).alias(f"_{n}_folds") for n in names])
    each = {n: text.stable_distinct(F.col(f"_{n}"), F.col(f"_{n}_folds")) for n in names}
    each = {n: F.slice(v, 1, limits[n]) if n in limits else v for n, v in each.items()}
    one = F.struct(F.get(docs, 0)["summary"].alias("summary"), *[each[n].alias(n) for n in ("key_points", "tasks", "decisions", "ideas")])
    return out.withColumn(doc, one).select(*rows.columns, doc)


def reduced(partials: DataFrame, key: str, place: str, doc: str, limit: int, fold: Callable[[DataFrame, str, str], DataFrame], max_depth: int = 3) -> DataFrame:
    """``key, doc, depth, error``: the analyses of each session folded to one.

    While their JSON array is longer than ``limit`` (and there are several), they are packed in the order of ``place`` into bundles
    that fit, and each bundle is folded to one (by a model, say; ``fold`` adds to rows with an array of analyses, by name, the one
    that they become); what fits is folded at last. A session that does not fit at ``max_depth`` has an error and no analysis. Each level is a written table, and sessions
    that are done take no part in the next; sessions of many analyses are packed without a list of all of them. A session
    without analyses has no row; null analyses are left out.
    """
    tables = Scratch(partials.sparkSession, "reduce")
    kind = partials.schema[doc].dataType.simpleString()
    level = partials.filter(F.col(doc).isNotNull()).select(F.col(key).alias("k"), F.col(place).cast("bigint").alias("place"), F.col(doc).alias("doc"))
    done = []
    for depth in range(1, max_depth + 1):
        level = tables.written(level.withColumn("size", F.length(F.to_json("doc")).cast("bigint")), f"level-{depth}")
        totals = level.groupBy("k").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        open_ = tables.written(totals.filter((F.col("n") > 1) & (F.col("s") + F.col("n") + 1 > limit)).select(F.col("k").alias("_k")), f"open-{depth}")
        same = F.col("k").eqNullSafe(F.col("_k"))
        fits = level.join(open_, same, "left_anti").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("place", "size", "doc"))).alias("items"))
        fits = fold(fits.select("k", F.transform("items", lambda x: x["doc"]).alias("docs")), "docs", "doc")
        done.append(fits.select("k", F.col("doc").cast(kind).alias("doc"), F.lit(depth).alias("depth"), F.lit(None).cast("string").alias("error")))
        if open_.isEmpty():
            break
        if depth == max_depth:
            done.append(open_.select(F.col("_k").alias("k"), F.lit(None).cast(kind).alias("doc"), F.lit(depth).alias("depth"), F.lit("too deep").alias("error")))
            break
        short, long = cuts.split_by_length(level.join(open_, same, "left_semi"), "k")
        g = gathered(short, ["k"], ["place"], size=F.col("size"), doc=F.col("doc")).withColumn("sums", prefix_sums(F.col("items"), "size"))
        b = g.select("k", "items", F.posexplode(bundle_bounds(F.col("items"), F.col("sums"), limit)).alias("place", "b"))
        packed = b.select("k", F.col("place").cast("bigint").alias("place"), F.transform(F.slice("items", F.col("b.start") + 1, F.col("b.stop") - F.col("b.start")), lambda x: x["doc"]).alias("docs"))
        if long is not None:
            far = cuts.bundles(long, "k", ["place"], F.floor(F.col("place") / 1000), "size", limit).groupBy("k", "bundle").agg(F.array_sort(F.collect_list(F.struct("place", "size", "doc"))).alias("items"))
            packed = packed.unionByName(far.select("k", F.col("bundle").cast("bigint").alias("place"), F.transform("items", lambda x: x["doc"]).alias("docs")))
        level = fold(packed, "docs", "doc").select("k", "place", F.col("doc").cast(kind).alias("doc"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("k", key).withColumnRenamed("doc", doc)


# -- query ------------------------------------------------------------------------------------------------------------

LIMIT, LIMITS = 900, {"key_points": 9, "tasks": 5}


def partial_of_turn() -> Column:
    """What a model might say of a turn: its beginning, the beginnings of its sentences, some of them as tasks, and its role."""
    said = F.filter(F.transform(F.split(F.regexp_replace("text", r'[\s"\\]+', " "), "[.]"), lambda s: F.trim(s)), lambda s: s != "")
    tasks = F.transform(F.filter(said, lambda s: F.length(s) % 3 == 0), lambda s: F.struct(F.left(s, F.lit(6)).alias("text"), F.concat(F.lit("d"), (F.col("turn") % 5).cast("string")).alias("due")))
    role = F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.concat(F.lit(" "), "role"))
    return F.struct(
        F.left(F.regexp_replace("text", r'[\s"\\]+', " "), F.lit(20)).alias("summary"), F.transform(F.slice(said, 1, 3), lambda s: F.left(s, F.lit(10))).alias("key_points"), F.slice(tasks, 1, 2).alias("tasks"),
        F.array(role).alias("decisions"), F.array().cast("array<string>").alias("ideas"),
    ).cast(f"struct<{', '.join(f.replace(' ', ':', 1) for f in analysis.PARTIAL.split(', '))}>")


def q_reduce(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", partial_of_turn().alias("doc"))
    found = reduced(c, "conv_id", "turn", "doc", LIMIT, lambda rows, docs, doc: merged(rows, docs, doc, LIMITS))
    tasks = F.transform("doc.tasks", lambda t: F.concat(t["text"], F.lit(":"), t["due"]))
    return found.select("conv_id", "depth", "error", "doc.summary", *[F.array_join(c, "|").alias(n) for n, c in (("key_points", "doc.key_points"), ("tasks", tasks), ("decisions", "doc.decisions"))])


def _oracle() -> str:
    distinct = lambda v, of="{}": f"list_filter({v}, lambda v, i: list_position(list_transform({v}, lambda w: lower(trim({of.format('w')}))), lower(trim({of.format('v')}))) = i)"
    together = "first(summary ORDER BY i) AS summary, flatten(list(key_points ORDER BY i)) AS a, flatten(list(tasks ORDER BY i)) AS b, flatten(list(decisions ORDER BY i)) AS c"
    merge = f"""summary, list_slice({distinct("a")}, 1, {LIMITS["key_points"]}) AS key_points, list_slice({distinct("b", "{}.text")}, 1, {LIMITS["tasks"]}) AS tasks, {distinct("c")} AS decisions"""
    size = "length(CAST(to_json({'summary': summary, 'key_points': key_points, 'tasks': tasks, 'decisions': decisions, 'ideas': CAST([] AS VARCHAR[])}) AS VARCHAR))"
    out = f"""WITH RECURSIVE w AS (SELECT conv_id, turn, upper(role) AS u, role, regexp_replace(text, '[\\s"\\\\]+', ' ', 'g') AS t FROM conversations),
      q AS (SELECT *, list_filter(list_transform(string_split(t, '.'), lambda s: trim(s)), lambda s: s <> '') AS said FROM w),
      l1 AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, left(t, 20) AS summary, list_transform(list_slice(said, 1, 3), lambda s: left(s, 10)) AS key_points,
        list_slice(list_transform(list_filter(said, lambda s: length(s) % 3 = 0), lambda s: {{'text': left(s, 6), 'due': 'd' || turn % 5}}), 1, 2) AS tasks, [CASE WHEN turn % 2 = 0 THEN u ELSE ' ' || role END] AS decisions FROM q)"""
    ends = []
    for k in (1, 2, 3):
        open_ = f"SELECT conv_id FROM s{k} GROUP BY conv_id HAVING count(*) > 1 AND sum(s) + count(*) + 1 > {LIMIT}"
        out += f""",
      s{k} AS (SELECT *, {size} AS s FROM l{k}), o{k} AS ({open_}),
      e{k} AS (SELECT conv_id, {k} AS depth, NULL AS error, {merge} FROM (SELECT conv_id, {together} FROM s{k} ANTI JOIN o{k} USING (conv_id) GROUP BY conv_id))"""
        ends.append(f"SELECT * FROM e{k}")
        if k < 3:
            out += f""",
      b{k} AS (SELECT conv_id, i, 0 AS b, s + 2 AS size FROM s{k} SEMI JOIN o{k} USING (conv_id) WHERE i = 0
        UNION ALL SELECT r.conv_id, r.i, CASE WHEN x.size + r.s + 1 > {LIMIT} THEN x.b + 1 ELSE x.b END, CASE WHEN x.size + r.s + 1 > {LIMIT} THEN r.s + 2 ELSE x.size + r.s + 1 END FROM b{k} x JOIN s{k} r ON r.conv_id = x.conv_id AND r.i = x.i + 1),
      l{k + 1} AS (SELECT conv_id, i, {merge} FROM (SELECT conv_id, "at" AS i, {together} FROM (SELECT s.*, b.b AS "at" FROM s{k} s JOIN b{k} b ON b.conv_id = s.conv_id AND b.i = s.i) GROUP BY conv_id, "at"))"""
    return out + f""" SELECT conv_id, depth, error, summary, array_to_string(key_points, '|') AS key_points, array_to_string(list_transform(tasks, lambda t: t.text || ':' || t.due), '|') AS tasks, array_to_string(decisions, '|') AS decisions
      FROM ({" UNION ALL ".join(ends)} UNION ALL SELECT conv_id, 3, 'too deep', NULL, NULL, NULL, NULL FROM o3)"""


QUERIES = {"reduce_documents": q_reduce}
ORACLES = {"reduce_documents": _oracle()}
