"""Versions against full recomputation, and what they read and write."""

import os
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import incremental as I
from logloom.operators.state import current_state


def test_state_after_each_append_reads_only_the_tail(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 9), i, rnd.choice("abc"), i % 5) for i in range(500)] + [(77, 1000, None, 4), (None, 1001, "a", 4)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, s string, part int")
    df.write.partitionBy("part").parquet(str(tmp_path / "log"))
    log = spark.read.schema(df.schema).parquet(str(tmp_path / "log"))
    path = str(tmp_path / "state")
    for k in range(5):
        got = I.advance(spark, path, log.filter(F.col("part") <= k), "part", "k", "s", ["i"])
        want = current_state(df.filter(F.col("part") <= k), "k", "s", ["i"])
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect())), k
        assert I.latest_state(spark, path)[:2] == (k + 1, k)
    I.advance(spark, path, log, "part", "k", "s", ["i"])
    assert I.latest_state(spark, path)[0] == 5, "nothing new, no new version"
    tail = log.filter(F.col("part") > I.latest_state(spark, path)[1])
    assert tail.count() == 0 and "PartitionFilters: [isnotnull(part" in tail._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileExistsError):
        I._rename(spark, f"{path}/state-1-0", f"{path}/state-2-1")


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path, asked = str(tmp_path / "out"), []

    def compute(rows):
        found = rows.collect()
        asked.append(len(found))
        return spark.createDataFrame([(r.k, r.fingerprint, r.v * 2) for r in found], "k bigint, fingerprint string, double bigint")

    def wanted(values):
        return spark.createDataFrame([(k, f"f{v}", v) for k, v in values.items()], "k bigint, fingerprint string, v bigint")

    values = {k: k for k in range(200)}
    rows = lambda out: {r.k: r.double for r in out.collect()}
    assert rows(I.upsert(wanted(values), path, "k", compute, 16)) == {k: 2 * k for k in values}
    _, before = I._manifest(spark, path)
    values[7], values[500] = 70, 5
    del values[8]
    assert rows(I.upsert(wanted(values), path, "k", compute, 16)) == {k: 2 * v for k, v in values.items()}
    version, after = I._manifest(spark, path)
    moved = {b for b in before if before[b] != after.get(b)}
    assert asked == [200, 2] and version == 2 and 1 <= len(moved) <= 3
    kept = files(path)
    assert rows(I.upsert(wanted(values), path, "k", compute, 16)) == {k: 2 * v for k, v in values.items()}
    assert files(path) == kept and I._manifest(spark, path)[0] == 2
    assert rows(I.upsert(wanted(values).limit(0), path, "k", compute, 16)) == {} and I._manifest(spark, path) == (3, {})
