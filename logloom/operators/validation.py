"""Nested documents checked by a table of rules, as plans: documents are VARIANT values that are unfolded level by level."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import config
from logloom.plans import Scratch
from logloom.sources import load

RULES = "path string, kind string, required boolean, least double, most double"
#: Levels of nesting that are unfolded, at most; what lies deeper is a problem of its own.
DEPTH = 32


def kind_of(value: Column) -> Column:
    """object, array, string, integer, number, boolean or null."""
    t = F.schema_of_variant(value)
    kinds = [("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BIGINT", "integer"), ("BOOLEAN", "boolean"), ("VOID", "null")]
    out = F.lit("number")
    for start, kind in reversed(kinds):
        out = F.when(t.startswith(start), kind).otherwise(out)
    return F.when(value.isNotNull(), out)


def unfolded(docs: DataFrame, key: str, doc: str, stop: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """``key, path, shape, kind, value, size``: every value of each document (a VARIANT column; null documents have none). ``path``
    is a.b[2].c, ``shape`` the same with [*] for places; size counts the items of an array or the characters of a string. Of
    containers whose shape ``stop`` (a column shape) has not got, or that it leaves, nothing below is unfolded. A written table a level."""
    tables = Scratch(docs.sparkSession, "unfold")
    level = docs.filter(F.col(doc).isNotNull()).select(F.col(key).alias("_key"), F.lit("").alias("path"), F.lit("").alias("shape"), F.col(doc).alias("value"))
    level, out, k = tables.written(level.withColumn("kind", kind_of(F.col("value"))), "level-0"), [], 0
    while True:
        out.append(level)
        inner = level.filter(F.col("kind").isin("object", "array"))
        if stop is not None:
            inner = inner.join(F.broadcast(stop), "shape", "left_semi")
        if k == depth or inner.isEmpty():
            break
        k += 1
        each = inner.withColumnRenamed("value", "_v").lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        dot = F.when(F.col("path") == "", "").otherwise(".")
        path = F.when(F.col("kind") == "array", F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", dot, "key"))
        shape = F.when(F.col("kind") == "array", F.concat("shape", F.lit("[*]"))).otherwise(F.concat("shape", dot, "key"))
        level = each.select("_key", path.alias("path"), shape.alias("shape"), "value")
        level = tables.written(level.withColumn("kind", kind_of(F.col("value"))), f"level-{k}")
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    size = F.when(F.col("kind") == "array", F.size(F.try_variant_get("value", "$", "array<variant>"))).when(F.col("kind") == "string", F.length(F.try_variant_get("value", "$", "string")))
    return every.select(F.col("_key").alias(key), "path", "shape", "kind", "value", size.cast("bigint").alias("size"))


def problems(docs: DataFrame, key: str, doc: str, rules: DataFrame) -> DataFrame:
    """``key, path, problem``: what ``rules`` (RULES; path with [*] for places) find in documents: unknown key, wrong type, too small, too
    large (of numbers, or of the size of strings and arrays), missing. The document itself has the path "".

    Unknown containers are one problem, whatever is in them. An integer passes as a number; kind any passes all. A required key is missing
    where the object that should hold it is there. The rules are a table of settings, so they are broadcast.
    """
    rules = rules.select(F.col("path").alias("shape"), F.col("kind").alias("_kind"), "required", "least", "most")
    at = Scratch(docs.sparkSession, "problems").written(unfolded(docs, key, doc, rules.filter("_kind <> 'any'").select("shape")), "values")
    met = at.join(F.broadcast(rules), "shape", "left")
    fits = (F.col("kind") == F.col("_kind")) | (F.col("_kind") == "any") | ((F.col("kind") == "integer") & (F.col("_kind") == "number"))
    amount = F.when(F.col("kind").isin("integer", "number"), F.try_variant_get("value", "$", "double")).otherwise(F.col("size").cast("double"))
    what = F.when(F.col("_kind").isNull(), "unknown key").when(~fits, "wrong type").when(amount < F.col("least"), "too small").when(amount > F.col("most"), "too large")
    found = met.select(key, "path", what.alias("problem")).filter("problem IS NOT NULL")
    # Required keys of the objects that are there.
    own = F.regexp_extract("shape", r"([^.\]]+)$", 1)
    holder = F.regexp_replace(F.regexp_replace("shape", r"[^.\]]+$", ""), r"\.$", "")
    wanted = rules.filter("required AND shape <> '' AND NOT endswith(shape, ']')").select(holder.alias("shape"), own.alias("_own"))
    asked = at.filter("kind = 'object'").join(F.broadcast(wanted), "shape").select(key, F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "_own").alias("path"))
    lacks = asked.join(at.select(F.col(key).alias("_k"), F.col("path").alias("_p")), F.col(key).eqNullSafe(F.col("_k")) & (F.col("path") == F.col("_p")), "left_anti")
    return found.unionByName(lacks.select(key, "path", F.lit("missing").alias("problem")))


# -- settings ---------------------------------------------------------------------------------------------------------

_KINDS = {"str": "string", "int": "integer", "num": "number", "bool": "boolean", "map": "any", "list": "array"}


def setting_rules(spark: SparkSession, sections: tuple[str, ...] = (), required: bool = True) -> DataFrame:
    """Rules for the known settings, of some sections or all, and the maps that hold them."""
    known = {k: _KINDS[v] for k, v in config.known_keys().items() if not sections or k.split(".")[0] in sections}
    rows = {"": ("", "object", False, None, None)}
    for k, kind in known.items():
        parts = k.split(".")
        for n in range(1, len(parts)):
            at = ".".join(parts[:n])
            rows[at] = (at, "object", required, None, None)
        rows[k] = (k, kind, required, None, None)
        if kind == "array":
            rows[k + "[*]"] = (k + "[*]", "any", False, None, None)
    return spark.createDataFrame(list(rows.values()), RULES)


def template_problems(values: DataFrame, key: str) -> DataFrame:
    """``key, rule, setting``: templates of unfolded settings that are no relative path (V-11) or have an unknown placeholder (V-13)."""
    folder, name = ("obsidian.raw.folder_template", "obsidian.wiki.folder_template"), ("obsidian.raw.filename_template", "obsidian.wiki.filename_template")
    said = F.try_variant_get("value", "$", "string")
    relative = ~said.startswith("/") & ~F.array_contains(F.split(said, "/"), "..")
    filled = F.size(F.array_except(F.regexp_extract_all(F.replace(said, F.lit("{title}"), F.lit("")), F.lit(r"\{(\w+)\}"), 1), F.array(*map(F.lit, sorted(config.PLACEHOLDERS))))) == 0
    told = F.array_compact(F.array(F.when(F.col("path").isin(*folder) & ~relative, "V-11"), F.when(F.col("path").isin(*folder, *name) & ~filled, "V-13")))
    return values.filter("kind = 'string'").select(key, F.explode(told).alias("rule"), F.col("path").alias("setting"))


def lock_rules(deletes_here: Column, deletes_there: Column, mount: Column) -> tuple[Column, Column]:
    """Arrays of notices, which never stop a start, and of violations, while deletion is on here: that it is (V-26); what the other side
    does not tell (V-30 whether it deletes, V-33 its mount), or denies."""
    on = F.coalesce(deletes_here, F.lit(False))
    notices = F.array_compact(F.array(F.when(on, "V-26"), F.when(on & deletes_there.isNull(), "V-30"), F.when(on & mount.isNull(), "V-33")))
    return notices, F.array_compact(F.array(F.when(on & ~deletes_there, "V-30"), F.when(on & (mount == "ro"), "V-33")))


# -- queries ----------------------------------------------------------------------------------------------------------


def q_config_rules(spark, sf_dir):
    """Settings of nations, as JSON, that break a rule each: unknown keys, absolute folders, unknown placeholders."""
    k = F.col("n_nationkey")
    raw, wiki = F.when(k % 3 != 0, "a/{date}").otherwise("a/{oops}"), F.when(k % 4 == 0, "/abs").otherwise("b")
    doc = F.to_json(F.struct(F.struct(F.struct(raw.alias("folder_template")).alias("raw"), F.struct(wiki.alias("folder_template")).alias("wiki")).alias("obsidian"), k.alias("extra")))
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.try_parse_json(doc).alias("doc"))
    rules = setting_rules(spark, required=False)
    unknown = problems(n, "n_nationkey", "doc", rules).filter("problem = 'unknown key'").select("n_nationkey", F.lit("V-1").alias("rule"), F.col("path").alias("key"))
    told = template_problems(unfolded(n, "n_nationkey", "doc"), "n_nationkey").withColumnRenamed("setting", "key")
    return unknown.unionByName(told)


def q_config_notices(spark, sf_dir):
    """What suppliers, as helpers, tell of deletion and their mount, against settings that delete or don't."""
    k = F.col("s_suppkey")
    there, mount = F.when(k % 3 == 0, True).when(k % 3 == 1, False), F.when(k % 5 == 0, "ro").when(k % 5 < 3, "rw")
    notices, bad = lock_rules(F.when(k % 7 != 0, k % 2 == 0), there, mount)
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(notices, ",").alias("notices"), F.array_join(bad, ",").alias("violations"))


def q_documents(spark, sf_dir):
    """Analyses of conversations, as JSON documents of their first turns, with a fault each; rules for lists, texts and nested tasks."""
    c = load(spark, sf_dir, "conversations").filter("turn < 2").groupBy("conv_id").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("m"))
    k = F.col("conv_id")
    task = F.concat(F.lit('{"text": '), F.when(k % 5 == 0, F.lit("7")).otherwise(F.lit('"do it"')), F.when(k % 3 == 0, F.lit(', "who": {"name": "x"}')).otherwise(F.lit("")), F.lit("}"))
    doc = F.concat(
        F.lit('{"summary": "'), F.repeat(F.lit("s"), F.col("n") % 9), F.lit('", "tasks": ['), F.array_join(F.array_repeat(task, F.col("m").cast("int")), ","), F.lit("]"),
        F.when(k % 4 == 0, F.lit(', "score": 1.5')).when(k % 4 == 1, F.lit(', "score": 20')).otherwise(F.lit("")), F.when(k % 2 == 0, F.lit(', "points": ["a", null, "c"]')).otherwise(F.lit(', "points": {}')), F.lit("}"),
    )
    docs = c.select("conv_id", F.try_parse_json(F.when(k % 11 != 0, doc).otherwise("{broken")).alias("doc"))
    rules = spark.createDataFrame(
        [("", "object", True, None, None), ("summary", "string", True, 1.0, 6.0), ("tasks", "array", True, 1.0, 1.0), ("tasks[*]", "object", False, None, None), ("tasks[*].text", "string", True, None, None),
         ("tasks[*].due", "string", True, None, None), ("score", "number", True, 1.0, 9.0), ("points", "array", False, None, 2.0), ("points[*]", "string", False, None, None)], RULES,
    )
    return problems(docs, "conv_id", "doc", rules)


QUERIES = {"config_rules": q_config_rules, "config_notices": q_config_notices, "document_problems": q_documents}
ORACLES = {
    "config_rules": """WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT k AS n_nationkey, 'V-1' AS rule, 'extra' AS key FROM n UNION ALL SELECT k, 'V-11', 'obsidian.wiki.folder_template' FROM n WHERE k % 4 = 0
      UNION ALL SELECT k, 'V-13', 'obsidian.raw.folder_template' FROM n WHERE k % 3 = 0""",
    "config_notices": """SELECT s_suppkey, CASE WHEN k % 7 <> 0 AND k % 2 = 0 THEN 'V-26' || CASE WHEN k % 3 = 2 THEN ',V-30' ELSE '' END || CASE WHEN k % 5 > 2 THEN ',V-33' ELSE '' END ELSE '' END AS notices,
      CASE WHEN k % 7 <> 0 AND k % 2 = 0 THEN concat_ws(',', CASE WHEN k % 3 = 1 THEN 'V-30' END, CASE WHEN k % 5 = 0 THEN 'V-33' END) ELSE '' END AS violations FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)""",
    "document_problems": """WITH c AS (SELECT conv_id, max(length(text)) % 9 AS n, count(*) AS m FROM conversations WHERE turn < 2 AND conv_id % 11 <> 0 GROUP BY 1),
      t AS (SELECT conv_id, unnest(range(0, m)) AS i FROM c)
      SELECT conv_id, 'summary' AS path, CASE WHEN n < 1 THEN 'too small' ELSE 'too large' END AS problem FROM c WHERE n < 1 OR n > 6
      UNION ALL SELECT conv_id, 'tasks', 'too large' FROM c WHERE m > 1
      UNION ALL SELECT conv_id, 'tasks[' || i || '].text', 'wrong type' FROM t WHERE conv_id % 5 = 0
      UNION ALL SELECT conv_id, 'tasks[' || i || '].who', 'unknown key' FROM t WHERE conv_id % 3 = 0
      UNION ALL SELECT conv_id, 'tasks[' || i || '].due', 'missing' FROM t
      UNION ALL SELECT conv_id, 'score', CASE WHEN conv_id % 4 = 1 THEN 'too large' ELSE 'missing' END FROM c WHERE conv_id % 4 > 0
      UNION ALL SELECT conv_id, 'points', CASE WHEN conv_id % 2 = 0 THEN 'too large' ELSE 'wrong type' END FROM c
      UNION ALL SELECT conv_id, 'points[1]', 'wrong type' FROM c WHERE conv_id % 2 = 0""",
}
