"""Rule runners: every rule of an entity as a row (entity, rule, ok, detail), and what follows from failures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.functions import keys
from logloom.sources import load


def run_rules(rows: DataFrame, by: list[str], rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """``by``, rule, ok, detail for each rule and row; an unknown outcome fails. One pass over the rows: the rules are an
    array that is exploded."""
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail")) for n, ok, detail in rules])
    return rows.select(*by, F.inline(each))


def rule_totals(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rule, n_ok and n_fail over all rows: conditional counts in one aggregation, turned into a row a rule at the end."""
    counts = [F.count_if(F.coalesce(ok, F.lit(False))).alias(f"_{i}") for i, (_, ok) in enumerate(rules)]
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("n_ok"), (F.col("_n") - F.col(f"_{i}")).alias("n_fail")) for i, (n, _) in enumerate(rules)])
    return rows.agg(F.count("*").alias("_n"), *counts).select(F.inline(each))


def until_fatal(results: DataFrame, by: list[str], order: str, fatal: str, always: str) -> DataFrame:
    """Ordered checks after a fatal failure are ``blocked`` unless they always run."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.bool_or(~F.col("ok") & F.col(fatal)).over(w), F.lit(False))
    state = F.when(before & ~F.col(always), "blocked").when(F.col("ok"), "ok").otherwise("fail")
    return results.withColumn("state", state)


def verdict(results: DataFrame, by: list[str]) -> DataFrame:
    """Whether all rules hold (and there are any), and the failed ones in order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("rule"))))
    return results.groupBy(*by).agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("passed"), F.array_join(failed, ",").alias("failed"))


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that does not hold, or null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def note_rules(text: Column, size: Column, sha: Column, key: Column, wanted: Column, matter: Column, daily: bool, heading: str = "## Summary") -> list[tuple[str, Column, Column]]:
    """Rules of a saved note. ``matter`` is front_matter() of the text. A raw note must list the wanted keys at least, a
    daily note exactly them, and have a filled summary and a link."""
    p, f = ("W", 1) if daily else ("R", 0)
    missing, extra = F.array_except(wanted, matter["keys"]), F.array_except(matter["keys"], wanted)
    rules = [
        (f"{p}-1", text.isNotNull(), F.lit("exists")), (f"{p}-2", size > 0, F.concat(size.cast("string"), F.lit(" bytes"))), (f"{p}-3", F.is_valid_utf8(text), F.lit("UTF-8")),
        (f"{p}-4", F.sha2(text, 256) == sha, F.concat(F.lit("expected="), sha)),
    ]
    if daily:
        rules.append(("W-5", matter["has"], F.lit("front matter")))
    rules.append((f"{p}-{5 + f}", matter["session_key"] == key, F.concat(F.lit("found="), F.coalesce(matter["session_key"], F.lit("none")))))
    listed = (F.size(missing) == 0) & (F.size(extra) == 0) if daily else F.size(missing) == 0
    rules.append((f"{p}-{6 + f}", matter["has"] & listed, F.concat(F.lit("missing="), F.array_join(missing, ","))))
    if daily:
        section = F.regexp_extract(text, rf"(?sm)^\Q{heading}\E[^\S\n]*$(.*?)(?=^#{{1,6}} |\z)", 1)
        rules += [("W-8", F.length(F.trim(F.regexp_replace(section, r"\s+", " "))) > 0, F.lit(heading)), ("W-9", text.rlike(r"\[\[[^\]]+\]\]"), F.lit("link"))]
    return rules


def audio_rules(size: Column, rate: Column, channels: Column, fmt: Column, got: Column, want: Column, tolerance: float, target_rate: int = 16000, target_channels: int = 1, target_fmt: str = "s16") -> Column:
    """First rule that converted audio breaks; an unknown length on either side skips the length rule."""
    return first_failure([
        ("exists", size.isNotNull()), ("empty", size > 0), ("sample_rate", rate == target_rate), ("channels", channels == target_channels), ("sample_fmt", fmt == target_fmt),
        ("duration", F.coalesce(F.abs(got - want) <= tolerance, F.lit(True))),
    ])


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; nulls never do."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(rows: DataFrame, column: str, owners: DataFrame, owner: str) -> DataFrame:
    """Rows whose reference has no owner."""
    return rows.filter(F.col(column).isNotNull()).join(owners.select(F.col(owner).alias(column)).distinct(), column, "left_anti")


def drift(df: DataFrame, wanted: str) -> list[str]:
    """Columns of a table that differ from a schema, for migration checks."""
    from pyspark.sql.types import StructType

    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(wanted).fields}
    have = dict(df.dtypes)
    return sorted({f"missing {k}" for k in want.keys() - have.keys()} | {f"extra {k}" for k in have.keys() - want.keys()} | {f"{k} is {have[k]}, not {want[k]}" for k in want.keys() & have.keys() if want[k] != have[k]})


# -- queries ----------------------------------------------------------------------------------------------------------


def q_quality_rules(spark, sf_dir):
    """Rules of order lines, as counts of rows that pass and fail."""
    c = F.col
    rules = [
        ("Q-1", c("l_quantity") > 0), ("Q-2", c("l_discount").between(0, 0.05)), ("Q-3", c("l_linestatus").isin("O", "F")),
        ("Q-4", (c("l_returnflag") != "R") | (c("l_tax") <= 0.06)), ("Q-5", c("l_extendedprice") >= c("l_quantity") * 500),
    ]
    return rule_totals(load(spark, sf_dir, "lineitem"), rules)


def q_rule_verdicts(spark, sf_dir):
    c = F.col
    rules = [("D-1", F.length("text") >= 200, c("n_chars")), ("D-2", ~c("text").contains("!!"), F.lit("shouting")), ("D-3", c("n_chars") == F.length("text"), c("n_chars")), ("D-4", c("lang").isin("en", "de"), c("lang"))]
    return verdict(run_rules(load(spark, sf_dir, "documents"), ["doc_id"], rules), ["doc_id"])


def q_doctor(spark, sf_dir):
    """Checks of each customer's account in order; a fatal failure blocks what follows, but the last always runs."""
    c = F.col
    rules = [("C-1", c("c_acctbal") > -500, c("c_acctbal")), ("C-2", c("c_nationkey") != 7, c("c_nationkey")), ("C-3", c("c_mktsegment") != "BUILDING", c("c_mktsegment")), ("C-4", c("c_custkey") % 3 != 0, c("c_custkey"))]
    r = run_rules(load(spark, sf_dir, "customer"), ["c_custkey"], rules).withColumn("fatal", c("rule").isin("C-1", "C-2")).withColumn("always", c("rule") == "C-4")
    return until_fatal(r, ["c_custkey"], "rule", "fatal", "always").select("c_custkey", "rule", "state")


def _notes(spark, sf_dir):
    from logloom.functions import text as T

    d = load(spark, sf_dir, "documents")
    k = F.col("doc_id")
    own = F.array(F.concat(F.lit("dev/"), k.cast("string")), F.concat(F.lit("dev/"), (k + 1).cast("string")))
    listed = F.when(k % 5 == 0, F.slice(own, 1, 1)).when(k % 5 == 1, F.concat(own, F.array(F.lit("dev/x")))).otherwise(own)
    session = F.concat(F.lit("dev:"), F.when(k % 7 == 0, F.lit("other")).otherwise(k.cast("string")))
    head = T.front_matter(session_key=T.yaml_quote(session), recording_keys=T.yaml_list(listed))
    body = F.concat(F.lit("\n## Summary\n\n"), F.when(k % 3 == 0, F.lit("")).otherwise(F.md5("text")), F.lit("\n\n## Links\n\n"), F.when(k % 4 == 0, F.lit("none")).otherwise(F.lit("[[2024-01-01]]")), F.lit("\n"))
    note = F.when(k % 11 == 0, body).otherwise(F.concat(head, body))
    return d.select("doc_id", note.alias("note"), own.alias("wanted"), F.concat(F.lit("dev:"), k.cast("string")).alias("key"), F.when(k % 13 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.sha2(note, 256)).alias("sha"))


def q_note_check(spark, sf_dir):
    from logloom.sources.files import front_matter

    n = _notes(spark, sf_dir).withColumn("m", front_matter(F.col("note"), "recording_keys", "session_key"))
    args = (F.col("note"), F.octet_length("note"), F.col("sha"), F.col("key"), F.col("wanted"), F.col("m"))
    raw = verdict(run_rules(n, ["doc_id"], note_rules(*args, daily=False)), ["doc_id"]).select("doc_id", F.lit("raw").alias("kind"), "passed", "failed")
    return raw.unionByName(verdict(run_rules(n, ["doc_id"], note_rules(*args, daily=True)), ["doc_id"]).select("doc_id", F.lit("daily").alias("kind"), "passed", "failed"))


def q_audio_check(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey")
    reason = audio_rules(F.when(k % 17 != 0, F.col("p_size") - 1), F.when(k % 5 == 0, 48000).otherwise(16000), (k % 7 == 0).cast("int") + 1, F.lit("s16"), F.col("p_retailprice"), F.when(k % 3 != 0, F.col("p_retailprice") + k % 4), 2.0)
    return p.select("p_partkey", reason.alias("reason"))


def q_integrity(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    a = dangling(o.select("o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey").select(F.lit("dangling").alias("rule"), F.col("o_orderkey").alias("id"))
    d = duplicates(load(spark, sf_dir, "documents").select(F.xxhash64("text").alias("h")), "h").agg(F.count("*").alias("id"))
    return a.unionByName(d.select(F.lit("duplicate contents").alias("rule"), "id"))


def q_safe_paths(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    path = F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1)
    return p.select("page_id", keys.safe_relpath(path).alias("absolute"), keys.safe_relpath(F.regexp_replace(path, "^/", "")).alias("relative"))


QUERIES = {
    "quality_rules": q_quality_rules,
    "rule_verdicts": q_rule_verdicts,
    "doctor_blocking": q_doctor,
    "note_check": q_note_check,
    "audio_check": q_audio_check,
    "integrity": q_integrity,
    "safe_paths": q_safe_paths,
}
ORACLES = {
    "quality_rules": """WITH r AS (SELECT unnest(['Q-1', 'Q-2', 'Q-3', 'Q-4', 'Q-5']) AS rule, unnest([l_quantity > 0, l_discount BETWEEN 0 AND 0.05::DOUBLE, l_linestatus IN ('O', 'F'), l_returnflag <> 'R' OR l_tax <= 0.06::DOUBLE, l_extendedprice >= l_quantity * 500]) AS ok FROM lineitem)
      SELECT rule, count(CASE WHEN ok THEN 1 END) AS n_ok, count(CASE WHEN NOT ok THEN 1 END) AS n_fail FROM r GROUP BY 1""",
    "rule_verdicts": """WITH r AS (SELECT doc_id, list_filter([CASE WHEN NOT length(text) >= 200 THEN 'D-1' END, CASE WHEN contains(text, '!!') THEN 'D-2' END, CASE WHEN n_chars <> length(text) THEN 'D-3' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'D-4' END], lambda x: x IS NOT NULL) AS f FROM documents)
      SELECT doc_id, len(f) = 0 AS passed, array_to_string(f, ',') AS failed FROM r""",
    "doctor_blocking": """WITH x AS (SELECT c_custkey, c_acctbal > -500 AS a, c_nationkey <> 7 AS b, c_mktsegment <> 'BUILDING' AS c, c_custkey % 3 <> 0 AS d FROM customer)
      SELECT c_custkey, unnest(['C-1', 'C-2', 'C-3', 'C-4']) AS rule, unnest([CASE WHEN a THEN 'ok' ELSE 'fail' END, CASE WHEN NOT a THEN 'blocked' WHEN b THEN 'ok' ELSE 'fail' END, CASE WHEN NOT (a AND b) THEN 'blocked' WHEN c THEN 'ok' ELSE 'fail' END, CASE WHEN d THEN 'ok' ELSE 'fail' END]) AS state FROM x""",
    "note_check": """WITH x AS (SELECT doc_id AS k FROM documents),
      r AS (SELECT k, list_filter([CASE WHEN k % 13 = 0 THEN 'R-4' END, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'R-5' END, CASE WHEN k % 5 = 0 OR k % 11 = 0 THEN 'R-6' END], lambda v: v IS NOT NULL) AS f,
        list_filter([CASE WHEN k % 13 = 0 THEN 'W-4' END, CASE WHEN k % 11 = 0 THEN 'W-5' END, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'W-6' END, CASE WHEN k % 5 < 2 OR k % 11 = 0 THEN 'W-7' END, CASE WHEN k % 3 = 0 THEN 'W-8' END, CASE WHEN k % 4 = 0 THEN 'W-9' END], lambda v: v IS NOT NULL) AS g FROM x)
      SELECT k AS doc_id, 'raw' AS kind, len(f) = 0 AS passed, array_to_string(f, ',') AS failed FROM r UNION ALL SELECT k, 'daily', len(g) = 0, array_to_string(g, ',') FROM r""",
    "audio_check": """SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'exists' WHEN p_size - 1 <= 0 THEN 'empty' WHEN p_partkey % 5 = 0 THEN 'sample_rate' WHEN p_partkey % 7 = 0 THEN 'channels' WHEN p_partkey % 3 <> 0 AND p_partkey % 4 > 2 THEN 'duration' END AS reason FROM part""",
    "integrity": """SELECT 'dangling' AS rule, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
      UNION ALL SELECT 'duplicate contents', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""",
    "safe_paths": """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) AS a FROM pages), q AS (SELECT page_id, regexp_replace(a, '^/', '') AS r FROM p)
      SELECT page_id, false AS absolute, r <> '' AND len(list_filter(string_split(r, '/'), lambda x: x = '' OR x LIKE '.%')) = 0 AS relative FROM q""",
}
