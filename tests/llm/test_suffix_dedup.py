import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from logloom.llm import suffix_dedup as S


def brute(texts, width):
    """Per text: bytes, removed bytes, maximal runs and the kept bytes."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        hit = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                hit[i : i + width] = b"\1" * width
        runs = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((len(b), sum(hit), runs, bytes(c for c, h in zip(b, hit) if not h)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdéfgh") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rnd.randint(20, 90)) for _ in range(6)]
    texts = [None, "", "a", "x" * 199, "x" * 200, "x" * 201, "y" * 450, "ab" * 300, "né" * 150]
    for _ in range(60):
        parts = [prose(rnd.randint(1, 60)) for _ in range(3)]
        if rnd.random() < 0.7:
            parts.insert(rnd.randint(0, 3), rnd.choice(shared))
        if rnd.random() < 0.2:
            parts.append(parts[0])
        texts.append(" ".join(parts))
    for t in rnd.sample(texts[9:], 10):
        texts.append(t)
        at = rnd.randint(0, len(t) - 1)
        texts.append(t[:at] + "#" + t[at + 1 :])
        texts.append(t[:at])
    rnd.shuffle(texts)
    return texts


def check(spark, texts, width):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in S.remove_repeats(docs, width).collect()}
    for i, (n, gone, runs, kept) in enumerate(brute(texts, width)):
        r = got[i]
        assert b"".join(r.kept) == kept, (i, texts[i])
        assert sum(x.stop - x.start for x in r.removed) == gone and len(r.removed) == runs


def test_equals_brute_force(spark):
    for seed in range(2):
        check(spark, corpus(seed), 200)


def test_boundaries_of_partly_equal_texts(spark):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefghijklmnop") for _ in range(900))
    texts = [base[i : i + rnd.randint(195, 260)] for i in range(0, 640, 13)] + [base[:350] + "!" + base[351:]]
    check(spark, texts, 200)


def test_a_long_text_is_looked_at_in_pieces(spark, monkeypatch):
    rnd = random.Random(12)
    base = "".join(rnd.choice("abcdefghijklmnop") for _ in range(4000))
    monkeypatch.setattr(S, "PIECE", 500)
    raw = (base + "!" + base[700:1500] + "?" * 450 + base[3000:]).encode()
    import numpy as np
    import pyarrow as pa

    from logloom.llm.window_digits import window_runs

    batch = pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["_body"])
    pieces = [(r.first + low, r.count, r.digest) for _, _, _, r, _, low in S._runs([batch], [], 200)]
    one = window_runs(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), 200, S.BLOCK)
    assert len(pieces) > 5
    for k, want in enumerate((one.first, one.count, one.digest)):
        assert (np.concatenate([p[k] for p in pieces]) == want).all()
    rows = S._part_rows(200)
    n = len(one.first)
    cols = {"_a": pa.array([1], pa.int64()), "_b": pa.array([2], pa.int64()), "full": pa.array([list(range(0, n, 3))], pa.list_(pa.int32())), "parts": pa.array([list(range(n))], pa.list_(pa.int32())), "need": pa.array([list(range(1, n, 2))], pa.list_(pa.int32())), "_body": pa.array([raw], pa.binary())}
    batch = pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    cut = pa.Table.from_batches(list(rows([batch]))).to_pylist()
    monkeypatch.setattr(S, "PIECE", 10**6)
    assert cut_rows(cut) == cut_rows(pa.Table.from_batches(list(rows([batch]))).to_pylist())


def cut_rows(rows):
    return sorted(map(repr, rows))


def test_ids_null_or_repeated_extra_columns_and_no_rows(spark):
    t = "q" * 100 + "r" * 130
    rows = [(None, t, 1), (None, "only " * 3, 2), (7, t, 3), (7, t, 3), (7, "other", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, run int").withColumn("_body", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("_id", F.lit(3))
    got = sorted((r.run, b"".join(r.kept)) for r in S.remove_repeats(docs).collect())
    assert got == [(1, b""), (2, b"only " * 3), (3, b""), (3, b""), (4, b"other")]
    assert S.remove_repeats(docs.limit(0)).collect() == []


def test_many_repeated_rows_list_each_span_once(spark):
    rnd = random.Random(5)
    t = "".join(rnd.choice("abcdefgh") for _ in range(700))
    docs = spark.createDataFrame([(7, t)] * 1000 + [(8, t[:300] + "!" * 150), (9, "z" * 150)], "doc_id bigint, text string")
    keyed = docs.select(F.col("doc_id").alias("_a"), F.lit(0).cast("bigint").alias("_b"), F.col("text").cast("binary").alias("_body"))
    assert S.repeated_spans(keyed).agg(F.max(F.size("spans"))).first()[0] < 200
    got = S.remove_repeats(docs).collect()
    assert len(got) == 1002 and all(r.kept == [b"", b""] and len(r.removed) == 1 for r in got if r.doc_id == 7)
    assert [b"".join(r.kept) for r in got if r.doc_id == 8] == [b"!" * 150]


def test_texts_without_ids_keep_apart_where_short_hashes_collide(spark):
    """Null ids and texts of which many share a 32-bit hash: no text gets the spans of another."""
    rnd = random.Random(6)
    base = "".join(rnd.choice("abcdefgh") for _ in range(400))
    texts = ["".join(rnd.choice("ijklmnop") for _ in range(512)) for _ in range(300)] + [base, base + "?", base[100:] + "."]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id string, text string").withColumn("kept", F.lit("x"))
    want = sorted(w[3] for w in brute(texts, 200))
    assert sorted(b"".join(r.kept) for r in S.remove_repeats(docs).collect()) == want


def test_only_what_the_result_reads_stays_in_the_shared_folder(spark):
    import os

    from logloom.plans import clear_shared
    from logloom.plans.shared import _base

    clear_shared(spark)
    docs = spark.createDataFrame([(i, "k" * 100 + "l" * (130 + i)) for i in range(4)], "doc_id bigint, text string")
    found = S.remove_repeats(docs)
    left = [d for _, dirs, _ in os.walk(_base(spark).removeprefix("file:")) for d in dirs]
    assert len(left) == 2 and "spans" in left
    assert found.count() == 4
    assert clear_shared(spark)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    from logloom.sources import load

    rows = load(spark, sf, "documents").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows], 200))}
    got = S.query(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, runs, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, runs, hashlib.sha256(kept).hexdigest())
