import re
import time
import unicodedata
from collections import Counter

import numpy as np

from logloom.llm import quality_rules as R
from logloom.sources import load

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def plain_kept(text):
    """The rules, written again: symbols, word length, repeated lines, stutter, capitals, few letters."""
    n, chars, symbols, dup, _, failed = plain(text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = [c for c in text or "" if unicodedata.category(c).startswith("L")]
    capitals = [c for c in letters if unicodedata.category(c) == "Lu"]
    again = sum(a == b for a, b in zip(w, w[1:]))
    bad = (
        (symbols > 8 and symbols / n > 0.2) or chars / n < 2 or chars / n > 20 or (dup >= 3 and dup / len(lines) > 0.5)
        or (again >= 10 and again / n > 0.2) or (len(letters) >= 40 and len(capitals) / len(letters) > 0.5) or len(letters) / chars < 0.5
    ) if not failed else True
    return not bad


def test_query_equals_brute_force(spark):
    want = {r.doc_id: plain(r.text) for r in load(spark, SF, "documents").select("doc_id", "text").collect()}
    got = R.query(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert {r.doc_id: r.kept for r in got} == {r.doc_id: plain_kept(r.text) for r in load(spark, SF, "documents").select("doc_id", "text").collect()}
    marks = {r.doc_id: r.quality for r in load(spark, SF, "labels").collect()}
    good = [r.kept for r in got if marks.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in got if marks.get(r.doc_id) == 0 and not r.base_failed]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_verdict_is_that_of_all_rules_in_any_order(spark):
    texts = [r.text for r in load(spark, SF, "documents").select("text").limit(200).collect()]
    want = [not R.Text(t).base_failed and not any(r.rejects(R.Text(t)) for r in R.RULES) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for rules in (R.RULES, R.RULES[::-1]):
        assert [r.kept for r in R.judge(docs, rules).orderBy("doc_id").collect()] == want


def test_order_is_by_rejection_per_cost():
    rules = [R.Rule(n, None) for n in "abc"]
    no = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1], [0, 1, 0]], bool)
    assert [r.name for r in R.ordered(rules, np.array([1.0, 1.0, 0.2]), no)] == ["c", "b", "a"]
    assert [r.name for r in R.ordered(rules, np.array([0.1, 1.0, 9.0]), no)] == ["a", "b", "c"]


def test_measured_rules_are_ordered_by_rejection_per_cost(spark):
    def slow(t):
        time.sleep(0.002)
        return "b" in t.text

    def warm(t):
        return t.n_repeat_words < 0

    rules = (R.Rule("never", warm), R.Rule("slow", slow), R.Rule("fast", lambda t: "b" in t.text), R.Rule("other", lambda t: "c" in t.text))
    texts = [" ".join(f"{x}{i}w{k}" for k in range(12)) for i in range(20) for x in "abbc"] + ["b short", None] * 40
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    cost, no = R.estimate(docs, rules)
    assert no.sum(axis=0).tolist() == [0, 40, 40, 20] and len(no) == 80
    assert cost[1] > 100 * cost[0] and [r.name for r in R.ordered(rules, cost, no)][0] == "fast"
    assert R.ordered(rules, cost, no)[1].name == "other"
    plan = docs.sample(0.5, seed=5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_nulls_repeats_long_texts_extra_columns_and_no_rows(spark):
    long = " ".join(f"w{i % 7000}x{i // 7000 % 2}" for i in range(30_000))
    rows = [(1, None, 3), (1, None, 3), (None, " \n\t", 4), (2, "a b c d e f g h i j", 5), (3, long, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept int").withColumn("_row", R.F.lit(1))
    got = R.judge(docs).collect()
    assert sorted((r.n_words, r.base_failed) for r in got) == [(0, True)] * 3 + [(10, False), (30_000, True)]
    for r, t in zip(got, [x[1] for x in rows]):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t)[:5]
    assert R.judge(docs.limit(0)).count() == 0
