"""URLs judged by rules, and where no rule fits by the likelihood ratio of two character models.

The models are Markov models of variable order over the URLs that the rules accept and those that they reject: each next
character has a probability in the longest context that was seen, mixed with that of the shorter ones (Witten and Bell's
weights). A URL's score is the difference of its log-likelihoods by both models over its length; it passes from a
threshold on that is calibrated on URLs of known verdict that no model has learned from.

Counts of contexts come from all URLs of known verdict by map-side combined aggregations, and meet the distinct
(context, character) pairs of the URLs to be judged in joins; no model is collected or broadcast, so it may grow with
the corpus.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.plans import Scratch
from logloom.sources import load

#: Characters of context, at most.
ORDER = 4
#: Characters that one row is cut into (context, character) pairs at a time, so long URLs make no long lists.
PIECE = 512
#: Of five URLs of known verdict, one calibrates the threshold and four are learned.
FOLDS = 5
#: Steps of the scale, from -SCALE to SCALE nats a character, on which the threshold is set.
BINS, SCALE = 2000, 10.0
#: Characters the models know of beside those seen: the weight of the uniform distribution below order 0.
ALPHABET = 256
#: Begins each URL; no URL has it, as control characters are taken out first.
START = "\x02"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to /, ?, # or the end, in lower-case ASCII; path: from there up to ?, # or the end.
    Both are empty for null and where there is no ://."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The fitting rule of the longest name as a struct of name and verdict; null where none fits. Of equally long names the
    first alphabetically; of one name with both verdicts, block."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict != "block"), reverse=True):
        own = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        found = F.when(own & F.startswith(path, F.lit(r.path)), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def model_text(url: Column) -> Column:
    """What the models read of a URL: what follows the first :// (all of it without one), control characters taken out."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(url)
    return F.regexp_replace(rest, r"[\x00-\x1F\x7F]", "")


def grams(texts: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """``keep, gram``: for each character of a text the ORDER characters before it (START before the first) and itself."""
    pieces = texts.select(*keep, F.regexp_extract_all(text_col, F.lit(r"(?s)(.{1,%d})" % PIECE), 1).alias("_p"))
    pieces = pieces.select(*keep, F.explode(F.transform("_p", lambda x, i: F.concat(F.when(i > 0, F.right(F.get("_p", i - 1), F.lit(ORDER))).otherwise(F.lit(START * ORDER)), x))).alias("_s"))
    return pieces.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("_s") - ORDER), lambda i: F.substring(F.col("_s"), i, F.lit(ORDER + 1)))).alias("gram"))


def counts(known: DataFrame, tables: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """For each order k: how often each (context of k characters, character) occurs in accepted (a) and rejected (r) URLs,
    and for each context its occurrences (an, rn) and distinct next characters (at, rt). Lower orders are sums of the highest."""
    top = grams(known, "t", "label").groupBy("gram").agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("r"))
    top, out = tables.written(top, "grams"), []
    for k in range(ORDER + 1):
        g = top if k == ORDER else top.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        x = g.groupBy(F.left("gram", F.lit(k)).alias("context") if k else F.lit("").alias("context"))
        x = x.agg(F.sum("a").alias("an"), F.sum("r").alias("rn"), F.count_if(F.col("a") > 0).alias("at"), F.count_if(F.col("r") > 0).alias("rt"))
        out.append((g.select(F.col("gram").alias("g"), "a", "r"), x))
    return out


def ratios(needed: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``gram, micro``: the log of the ratio of both models' probabilities of each distinct gram, in millionths of a nat."""
    now = needed.select("gram").distinct().withColumn("pa", F.lit(1.0 / ALPHABET)).withColumn("pr", F.lit(1.0 / ALPHABET))
    for k, (g, x) in enumerate(model):
        now = now.withColumn("g", F.right("gram", F.lit(k + 1))).withColumn("context", F.left("g", F.lit(k)) if k else F.lit(""))
        now = now.join(g, "g", "left").join(x, "context", "left")
        mixed = [
            F.when(F.coalesce(F.col(n), F.lit(0)) > 0, (F.coalesce(F.col(c), F.lit(0)) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p)).alias(p)
            for p, c, n, t in (("pa", "a", "an", "at"), ("pr", "r", "rn", "rt"))
        ]
        now = now.select("gram", *mixed)
    return now.select("gram", F.round((F.log("pa") - F.log("pr")) * 1e6).cast("bigint").alias("micro"))


def step_of(score: Column) -> Column:
    """Number of a score on the scale, from 0 to BINS - 1."""
    return F.least(F.greatest(F.floor((score + SCALE) * (BINS / (2 * SCALE))), F.lit(0)), F.lit(BINS - 1)).cast("int")


def threshold(scored: DataFrame) -> int:
    """The first step that passes: where the mean of the rates of accepted URLs that pass and of rejected ones that don't is
    highest, nearest to score 0 (of two, the lower); score 0 if URLs of either verdict lack. One histogram of at most 2 * BINS
    rows comes to the driver."""
    found = {(r[0], r[1]): r[2] for r in scored.groupBy("label", step_of(F.col("score")).alias("bin")).count().collect()}
    total = {k: sum(n for (label, _), n in found.items() if label == k) for k in ("allow", "block")}
    if not all(total.values()):
        return BINS // 2
    passed, stopped, best = total["allow"], 0, []
    for cut in range(BINS + 1):
        best.append((-(passed * total["block"] + stopped * total["allow"]), abs(cut - BINS // 2), cut))
        passed -= found.get(("allow", cut), 0)
        stopped += found.get(("block", cut), 0)
    return min(best)[2]


def judge(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule (name of the fitting rule, or null), score (of the models, where no rule fits) and
    verdict (allow or block). Input columns of these names give way.

    Distinct URLs are learned and scored once, so a URL that a third of all rows have is no hot key of the models; its
    rows meet its score in a join that adaptive execution can split. URLs that are null, or empty for the models, have score 0; without any
    URL of known verdict all scores are 0 and pass. Long URLs are cut into pieces, none of their characters is left out.
    Repeated rows give repeated rows.
    """
    added = ["host", "path", "rule", "score", "verdict"]
    names = [c for c in pages.columns if c not in added]
    tables = Scratch(pages.sparkSession, "url-filter")
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), host.alias("host"), path.alias("path"), model_text(F.col(f"`{url_col}`")).alias("t"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    fold = F.conv(F.left(F.md5("t"), F.lit(4)), 16, 10).cast("int") % FOLDS
    urls = tables.written(rows.select("t", F.col("_rule.verdict").alias("label")).distinct().filter("t <> ''").withColumn("held", fold == 0), "urls")
    model = counts(urls.filter("label IS NOT NULL AND NOT held"), tables)
    asked = urls.filter("label IS NULL OR held").select(F.unhex(F.md5("t")).alias("key"), "label", "t")
    of_each = ratios(grams(asked, "t"), model)
    of_each = tables.written(of_each, "ratios")
    scored = grams(asked, "t", "key", "label").join(of_each, "gram").groupBy("key", "label").agg((F.sum("micro") / (F.count("*") * 1e6)).alias("score"))
    scored = tables.written(scored, "scores")
    least = threshold(scored.filter("label IS NOT NULL"))
    by_model = rows.filter("_rule IS NULL").withColumn("key", F.unhex(F.md5("t"))).join(scored.filter("label IS NULL").select("key", F.col("score").alias("_score")), "key", "left")
    by_model = by_model.select("_row", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("_score", F.lit(0.0)).alias("score"))
    by_model = by_model.withColumn("verdict", F.when(step_of(F.col("score")) >= least, "allow").otherwise("block"))
    by_rule = rows.filter("_rule IS NOT NULL").select("_row", "host", "path", F.col("_rule.name").alias("rule"), F.lit(None).cast("double").alias("score"), F.col("_rule.verdict").alias("verdict"))
    return by_rule.unionByName(by_model).select(*[F.col(f"_row.`{c}`") for c in names], *added)


def query(spark, sf_dir):
    return judge(load(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    step = f"least(greatest(floor(({{}} + {SCALE}) * {BINS / (2 * SCALE)}), 0), {BINS - 1})"
    rule = "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{'name': '{r.name}', 'verdict': '{r.verdict}'}}" for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))
    ) + " END"
    gram = f"unnest(list_transform(range(1, length(t) + 1), lambda i: substr(repeat(chr(2), {ORDER}) || t, i, {ORDER + 1}))) AS gram"
    out = f"""WITH u AS (SELECT page_id, coalesce(contains(url, '://'), false) AS has, CASE WHEN has THEN substr(url, strpos(url, '://') + 3) ELSE coalesce(url, '') END AS rest FROM pages),
      h AS (SELECT page_id, rest, CASE WHEN has THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
      p AS (SELECT page_id, host, path, regexp_replace(rest, '[\\x00-\\x1F\\x7F]', '', 'g') AS t, {rule} AS rule FROM h),
      d AS (SELECT DISTINCT t, rule.verdict AS label FROM p WHERE t <> ''), f AS (SELECT *, CAST('0x' || left(md5(t), 4) AS INTEGER) % {FOLDS} = 0 AS held FROM d),
      known AS (SELECT label, {gram} FROM f WHERE label IS NOT NULL AND NOT held), asked AS (SELECT t, label, {gram} FROM f WHERE label IS NULL OR held),
      r0 AS (SELECT DISTINCT gram, {1 / ALPHABET!r}::DOUBLE AS pa, {1 / ALPHABET!r}::DOUBLE AS pr FROM asked)"""
    for k in range(ORDER + 1):
        mix = lambda p, c, n, t: f"CASE WHEN coalesce({n}, 0) > 0 THEN (coalesce({c}, 0) + {t} * {p}) / ({n} + {t})::DOUBLE ELSE {p} END AS {p}"
        out += f""",
      g{k} AS (SELECT right(gram, {k + 1}) AS g, count(*) FILTER (label = 'allow') AS a, count(*) FILTER (label = 'block') AS r FROM known GROUP BY 1),
      x{k} AS (SELECT left(g, {k}) AS context, CAST(sum(a) AS BIGINT) AS an, CAST(sum(r) AS BIGINT) AS rn, count(*) FILTER (a > 0) AS "at", count(*) FILTER (r > 0) AS rt FROM g{k} GROUP BY 1),
      r{k + 1} AS (SELECT gram, {mix("pa", "a", "an", '"at"')}, {mix("pr", "r", "rn", "rt")} FROM r{k} LEFT JOIN g{k} ON g = right(gram, {k + 1}) LEFT JOIN x{k} ON context = left(right(gram, {k + 1}), {k}))"""
    return out + f""",
      s AS (SELECT t, label, sum(CAST(round((ln(pa) - ln(pr)) * 1e6) AS BIGINT))::DOUBLE / (count(*) * 1e6) AS score FROM asked JOIN r{ORDER + 1} USING (gram) GROUP BY t, label),
      b AS (SELECT label, {step.format("score")} AS bin FROM s WHERE label IS NOT NULL),
      n AS (SELECT count(*) FILTER (label = 'allow') AS na, count(*) FILTER (label = 'block') AS nb FROM b),
      c AS (SELECT cut, (SELECT count(*) FROM b WHERE label = 'allow' AND bin >= cut) * nb + (SELECT count(*) FROM b WHERE label = 'block' AND bin < cut) * na AS good FROM range(0, {BINS + 1}) q(cut), n WHERE na > 0 AND nb > 0),
      l AS (SELECT coalesce((SELECT cut FROM c ORDER BY good DESC, abs(cut - {BINS // 2}), cut LIMIT 1), {BINS // 2}) AS least)
      SELECT page_id, host, path, rule.name AS rule, coalesce(rule.verdict, CASE WHEN {step.format("coalesce(score, 0)")} >= least THEN 'allow' ELSE 'block' END) AS verdict
      FROM l, p LEFT JOIN s ON s.t = p.t AND s.label IS NULL"""


QUERIES = {"op12_url_filter": query}
ORACLES = {"op12_url_filter": _oracle()}
