"""Replay and positions against plain folds, with one entity that has most of all events."""

import random

from pyspark.sql import functions as F

from logloom.operators import replay as R


def by_hand(rows, current, legal=None):
    state, out = dict(current), {}
    for k, i, f, t in sorted(rows, key=lambda r: r[1]):
        s = state.get(k)
        ok = s == f and (legal is None or f is None or (f, t) in legal)
        out[i] = (s, ok)
        if ok:
            state[k] = t
    return out


def events(seed, n, hot):
    rnd = random.Random(seed)
    states = ["a", "b", "c", None]
    return [(0 if rnd.random() < hot else rnd.randint(1, 30), i, rnd.choice(states), rnd.choice("abcd")) for i in range(n)]


def replayed(spark, rows, current, **more):
    df = spark.createDataFrame(rows, "k bigint, i bigint, f string, t string").withColumn("found", F.lit(1)).repartition(4).drop("found")
    now = spark.createDataFrame(current, "k bigint, status string")
    got = R.replay(df, now, "k", "f", "t", ["i"], F.floor(F.col("i") / 100), **more).collect()
    assert len(got) == len(rows)
    return {r.i: (r.found, r.accepted) for r in got}


def test_a_hot_entity_is_replayed_over_several_levels(spark):
    rows = events(1, 3000, 0.7)
    current = [(k, "a") for k in range(0, 20)]
    got = replayed(spark, rows, current, block=8)
    assert got == by_hand(rows, current)
    assert {a for _, a in got.values()} == {True, False} and None in {f for f, _ in got.values()}


def test_legal_transitions_births_and_no_rows(spark):
    rows = events(2, 400, 0.3)
    legal = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]
    table = spark.createDataFrame(legal, "from_status string, to_status string")
    assert replayed(spark, rows, [(0, "a")], legal=table, block=16) == by_hand(rows, [(0, "a")], set(legal))
    assert replayed(spark, [], [(0, "a")]) == {}


def test_null_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(None, 1, "x", "y", 9), (None, 2, None, "a", 8), (None, 3, "a", "b", 7)], "k bigint, i bigint, f string, t string, _k int")
    got = R.replay(df, spark.createDataFrame([], "k bigint, status string"), "k", "f", "t", ["i"], F.lit(0)).orderBy("i").collect()
    assert [(r.found, r.accepted, r._k) for r in got] == [(None, False, 9), (None, True, 8), ("a", True, 7)]


def test_positions(spark):
    rows = [(k, i) for k in (1, 2, None) for i in range(50)]
    df = spark.createDataFrame(rows, "k bigint, i bigint").repartition(5)
    got = R.positions(df, "k", ["i"], F.floor(F.col("i") / 7), "pos").collect()
    assert len(got) == 150 and all(r.pos == r.i for r in got)
