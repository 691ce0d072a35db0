"""The reduce against a fold by hand, with a session that has most of all analyses."""

import json
import random
import unicodedata

from logloom.operators import analysis, cuts, reduction

SCHEMA = f"k string, i bigint, doc struct<{', '.join(f.replace(' ', ':', 1) for f in analysis.PARTIAL.split(', '))}>"
NAMES = ("summary", "key_points", "tasks", "decisions", "ideas")


def length(doc):
    d = {n: v for n, v in zip(NAMES, doc) if v is not None}
    if "tasks" in d:
        d["tasks"] = [{n: v for n, v in zip(("text", "due"), t) if v is not None} for t in d["tasks"]]
    return len(json.dumps(d, ensure_ascii=False, separators=(",", ":")))


def fold(docs, limits):
    def distinct(values, of=lambda x: x):
        seen, out = set(), []
        for v in values:
            key = unicodedata.normalize("NFKC", of(v)).strip().casefold()
            if key not in seen:
                seen.add(key)
                out.append(v)
        return out

    lists = {n: [v for d in docs for v in (d[k] or [])] for k, n in enumerate(NAMES) if k}
    out = {n: distinct(v, (lambda t: t[0]) if n == "tasks" else (lambda x: x))[: limits.get(n)] for n, v in lists.items()}
    return (docs[0][0], *[out[n] for n in NAMES[1:]])


def by_hand(rows, limit, limits):
    out = {}
    for k in {r[0] for r in rows}:
        docs = [d for _, _, d in sorted((r for r in rows if r[0] == k and r[2] is not None), key=lambda r: r[1])]
        for depth in (1, 2, 3):
            if not docs:
                break
            if len(docs) <= 1 or sum(map(length, docs)) + len(docs) + 1 <= limit:
                out[k] = (fold(docs, limits), depth, None)
                break
            if depth == 3:
                out[k] = (None, 3, "too deep")
                break
            bundles, used = [], None
            for d in docs:
                if used is not None and used + length(d) + 1 <= limit:
                    bundles[-1].append(d)
                    used += length(d) + 1
                else:
                    bundles.append([d])
                    used = 1 + length(d) + 1
            docs = [fold(b, limits) for b in bundles]
    return out


def test_sessions_of_any_length(spark, monkeypatch):
    rnd = random.Random(8)
    words = ["mill", "Mill ", "ＭＩＬＬ", "wheel", "stone", "a", "", "river bank", "ß", "SS", 'q"\\']
    some = lambda n: [rnd.choice(words) for _ in range(rnd.randint(0, n))]
    doc = lambda: (rnd.choice(words), some(4), [(rnd.choice(words), rnd.choice([None, "d1", "d2"])) for _ in range(rnd.randint(0, 2))], rnd.choice([None, some(2)]), some(1))
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("abcd"), i, doc() if rnd.random() > 0.05 else None) for i in range(500)] + [("deep", i, (str(i), [f"{i} {j}" for j in range(40)], [], [], [])) for i in range(30)] + [("none", 0, None), ("one", 0, doc())] + [("two", i, doc()) for i in range(10)]
    limits = {"key_points": 6, "tasks": 3}
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = by_hand(rows, 700, {"key_points": 60, "tasks": 3})
    assert {d for _, d, _ in want.values()} >= {1, 2, 3} and want["deep"][2] == "too deep"
    for long in (1024, 20):
        monkeypatch.setattr(cuts.split_by_length, "__defaults__", (long,))
        got = reduction.reduced(df, "k", "i", "doc", 700, lambda r, docs, d: reduction.merged(r, docs, d, {"key_points": 60, "tasks": 3})).collect()
        plain = lambda d: None if d is None else (d.summary, list(d.key_points), [tuple(t) for t in d.tasks], list(d.decisions), list(d.ideas))
        assert {r.k: (plain(r.doc), r.depth, r.error) for r in got} == want, long
    few = by_hand(rows, 3000, limits)
    got = reduction.reduced(df, "k", "i", "doc", 3000, lambda r, docs, d: reduction.merged(r, docs, d, limits)).collect()
    assert {r.k: (plain(r.doc), r.depth, r.error) for r in got} == few
    assert reduction.reduced(df.limit(0), "k", "i", "doc", 9, lambda r, docs, d: reduction.merged(r, docs, d, {})).count() == 0
