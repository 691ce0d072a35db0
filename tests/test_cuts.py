"""Bundles and marks of sequences with one that has most of all rows, against folds over lists."""

import random

from pyspark.sql import functions as F

from logloom.operators import cuts


def rows_of(seed, n, hot):
    rnd = random.Random(seed)
    out, t = [], {}
    for i in range(n):
        k = 0 if rnd.random() < hot else rnd.choice([1, 2, 3, None])
        t[k] = t.get(k, 0) + rnd.choice([0, 0, 1, 5, 40, 400])
        out.append((k, i, rnd.choice([0, 1, 3, 8, 20, 90]), float(t[k])))
    return out


def bundles_by_hand(rows, limit):
    out, state = {}, {}
    for k, i, size, _ in rows:
        b, used = state.get(k, (0, None))
        if used is not None and used + size + 1 > limit:
            b, used = b + 1, None
        state[k] = (b, (1 if used is None else used) + size + 1)
        out[i] = b
    return out


def marks_by_hand(rows, interval):
    out, last = {}, {}
    for k, i, _, t in rows:
        out[i] = k not in last or t >= last[k] + interval
        if out[i]:
            last[k] = t
    return out


def test_bundles_and_marks_of_a_hot_sequence(spark):
    rows = rows_of(1, 2500, 0.7)
    df = spark.createDataFrame([(*r, "x") for r in rows], "k bigint, i bigint, size int, t double, cut string").drop("cut").repartition(5)
    got = cuts.bundles(df, "k", ["i"], F.floor(F.col("i") / 90), "size", 60).collect()
    assert {r.i: r.bundle for r in got} == bundles_by_hand(rows, 60) and len(got) == len(rows)
    got = cuts.marks(df, "k", ["i"], F.floor(F.col("i") / 90), "t", 100.0).collect()
    assert {r.i: r.marked for r in got} == marks_by_hand(rows, 100.0) and len(got) == len(rows)


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([], "k bigint, i bigint, size int, t double")
    assert cuts.bundles(df, "k", ["i"], F.lit(0), "size", 60).count() == 0
    one = spark.createDataFrame([(1, 1, 500, 1.0)], df.schema)
    assert [r.bundle for r in cuts.bundles(one, "k", ["i"], F.lit(0), "size", 60).collect()] == [0]
    assert [r.marked for r in cuts.marks(one, "k", ["i"], F.lit(0), "t", 5.0).collect()] == [True]


def test_queries_are_the_same_when_every_sequence_is_long(spark, monkeypatch):
    from logloom.operators import chunks
    from tests.oracle import compare

    monkeypatch.setattr(cuts.split_by_length, "__defaults__", (2,))
    for name in ("bundle_greedy", "timestamp_marks"):
        compare(spark, "/root/testdata/sf0.001", chunks.QUERIES[name], chunks.ORACLES[name])
