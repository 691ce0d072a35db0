import random

import numpy as np
import xxhash

from logloom.llm import simhash as S
from logloom.sources import load


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in w.translate({i: 32 for i in range(9, 14)}).split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, fps):
    """Smallest id reachable over links of 4 bits or fewer, by comparing everything with everything."""
    fps = np.array(fps, np.uint64)
    label = list(nodes)
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 4) for f in fps]
    changed = True
    while changed:
        changed = False
        for i, n in enumerate(near):
            m = min(label[j] for j in n)
            if m < label[i]:
                label[i], changed = m, True
    return label


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = load(spark, sf, "documents").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, components([r.doc_id for r in rows], fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.query(spark, sf).collect()}
    assert got == want


def test_trees_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 20)
    monkeypatch.setattr(S, "TILE_HOMES", 16)
    monkeypatch.setattr(S, "TILE_VISITORS", 64)
    rnd = random.Random(3)
    fps = {0, 2**64 - 1}
    for _ in range(300):
        f = rnd.getrandbits(64)
        fps.add(f)
        for _ in range(rnd.randint(0, 3)):
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                f ^= 1 << b
            fps.add(f)
    dense = rnd.getrandbits(64)
    for _ in range(200):
        g = dense
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            g ^= 1 << b
        fps.add(g)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    edges = S.near_links(df).collect()
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at = {int(np.uint64(f).astype(np.int64)): i for i, f in enumerate(fps)}
    for e in edges:
        a, b = sorted((root(at[e.a]), root(at[e.b])))
        parent[b] = a
    assert [root(i) for i in range(len(fps))] == components(range(len(fps)), fps)


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    rows = [(3, None, 1), (None, "", 2), (2, " \t\n", 3), (9, "One two\vthree", 4), (9, "One two\vthree", 4), (None, "a b c d e f", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int").withColumn("_id", S.F.lit("x"))
    got = sorted(S.near_duplicates(docs).collect(), key=str)
    assert sorted(str(r.component_id) for r in got) == ["2", "2", "2", "9", "9", "None"]
    assert S.near_duplicates(docs.limit(0)).count() == 0
    long = "word " * 300_000
    assert S.fingerprint(long.encode()) == xxhash.xxh64(b"word word word word", seed=42).intdigest()
