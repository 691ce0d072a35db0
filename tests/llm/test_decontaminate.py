import hashlib
import re

from logloom.llm import decontaminate as D
from logloom.sources import load


def plain_words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(texts, items):
    wins = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).update(() if i is None else (str(i),))
    sizes = {len(w) for w in wins}
    for t in texts:
        w, hit, found = plain_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (who := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= who
        ids = ",".join(sorted(found))
        yield len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = load(spark, sf, "documents").select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in load(spark, sf, "benchmark").collect()]
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows], items))}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.query(spark, sf).collect()}
    assert got == want and any(w[4] for w in want.values())


def cases(spark):
    item = "Alpha beta-gamma, DELTA é1 two three four five six seven eight nine ten eleven"
    docs = [None, "", "...", item, "x " + item.upper().replace("É", "é") + " y", "beta gamma delta", "short one", "Short; ONE!", item * 3, "a b a b a b a"]
    items = [(1, item), (10, "short one"), (2, "a b a"), (3, None), (4, "!!"), (2, "a b a"), (None, "beta gamma")]
    frame = spark.createDataFrame([(i, t, "z") for i, t in enumerate(docs)], "doc_id bigint, text string, n_words string")
    return docs, items, frame, spark.createDataFrame(items, "item_id bigint, text string")


def test_cases_and_offsets(spark):
    docs, items, frame, bench = cases(spark)
    got = D.decontaminate(frame, bench).orderBy("doc_id").collect()
    for r, w in zip(got, brute(docs, items)):
        assert (r.n_words, r.n_hit, len(r["items"])) == w[:3]
    assert got[5].n_hit == 2 and got[5]["items"] == [] and got[5].n_words == 3
    assert [docs[7][s.start : s.stop] for s in got[7].hit_spans] == ["Short; ONE"]
    assert docs[4][got[4].hit_spans[0].start :].startswith("ALPHA")
    assert D.decontaminate(frame.limit(0), bench).count() == 0
    assert D.decontaminate(frame, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0


def test_a_large_benchmark_is_scanned_in_blocks(spark, monkeypatch):
    _, _, frame, bench = cases(spark)
    want = sorted(D.decontaminate(frame, bench).collect())
    monkeypatch.setattr(D, "BLOCK_WORDS", 5)
    assert len(list(D._blocks(bench, "item_id", "text"))) > 3
    assert sorted(D.decontaminate(frame, bench).collect()) == want


def test_windows_of_a_long_item_lie_in_several_blocks(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    monkeypatch.setattr(D, "PIECE_WINDOWS", 50)
    monkeypatch.setattr(D, "BLOCK_WORDS", 300)
    own = [rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(3000)]
    items = [(1, " ".join(own)), (2, " ".join(own[:62])), (3, " ".join(own[100:162])), (4, " ".join(own[40:49]))]
    docs = [" ".join(own[a : a + n]) for a in range(0, 200, 7) for n in (12, 13, 14, 70)] + [" ".join(own), "u " + " ".join(own[2980:]) + " v"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert len(list(D._blocks(bench, "item_id", "text"))) > 8
    got = D.decontaminate(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, len(r["items"])) for r in got] == [w[:3] for w in brute(docs, items)]


def test_repeated_rows_long_texts_and_text_ids(spark):
    _, items, _, _ = cases(spark)
    long = "filler words without end " * 200_000 + items[0][1] + " tail" * 3
    docs = [long, long, items[0][1], items[0][1]]
    frame = spark.createDataFrame([("d", t) for t in docs], "doc_id string, text string")
    bench = spark.createDataFrame([(None if i is None else f"q{i}", t) for i, t in items], "item_id string, text string")
    got = sorted((r.n_words, r.n_hit, tuple(r["items"])) for r in D.decontaminate(frame, bench).collect())
    want = sorted((n, h, ("q1",)) for n, h, *_ in brute(docs, items))
    assert got == want


def test_a_block_stays_within_its_memory():
    """The bytes of one automaton, measured in a process of its own at an eighth of the bound."""
    import subprocess
    import sys

    code = (
        "import random, resource; from logloom.llm import decontaminate as D\n"
        "r = random.Random(1); base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "n = D.BLOCK_WORDS // 8; items = [(str(i), ' '.join(f'w{r.randint(0, 30000)}' for _ in range(100))) for i in range(n // 100)]\n"
        "m = D.Machine(items); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)"
    )
    kb = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert kb * 8 < 1_000_000
