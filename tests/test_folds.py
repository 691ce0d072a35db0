"""Folds and windows against plain sequential versions of their rules, on random and boundary inputs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logloom.operators import blocks, chunks, sessions

T0 = datetime(2024, 1, 1)


def plain_blocks(parts, gap):
    out, end, unknown = [], None, False
    for s, e in sorted(parts, key=lambda p: (p[0], p[1] or datetime.min)):
        opens = end is None or unknown or (s - end).total_seconds() > gap
        end = (e or s) if opens else max(end, e or s)
        unknown = e is None
        out.append(((out[-1] if out else 0) + 1) if opens else out[-1])
    return out


def test_gap_blocks_equal_a_sequential_fold(spark):
    rnd = random.Random(1)
    groups, rows = {}, []
    for g in range(120):
        parts = set()
        for _ in range(rnd.randint(1, 9)):
            s = T0 + timedelta(seconds=rnd.randint(0, 60))
            parts.add((s, None if rnd.random() < 0.25 else s + timedelta(seconds=rnd.randint(0, 30))))
        groups[g] = sorted(parts, key=lambda p: (p[0], p[1] or datetime.min))
        rows += [(g, i, s, e) for i, (s, e) in enumerate(groups[g])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, s timestamp_ntz, e timestamp_ntz")
    got = {}
    for r in blocks.gap_blocks(df, "g", "s", "e", 10, "i").collect():
        got.setdefault(r.g, {})[r.i] = r.block
    for g, parts in groups.items():
        assert [got[g][i] for i in range(len(parts))] == plain_blocks(parts, 10), parts


def test_gap_at_the_threshold_does_not_open_a_block(spark):
    rows = [(0, T0, T0 + timedelta(seconds=5)), (1, T0 + timedelta(seconds=15), T0 + timedelta(seconds=16)), (2, T0 + timedelta(seconds=27), None)]
    df = spark.createDataFrame(rows, "i int, s timestamp_ntz, e timestamp_ntz").withColumn("g", F.lit(1))
    assert [r.block for r in blocks.gap_blocks(df, "g", "s", "e", 10, "i").orderBy("i").collect()] == [1, 1, 2]


def plain_first_fit(parts, most, seconds):
    bins, out = [], []
    for s in parts:
        at = next((i for i, (n, t) in enumerate(bins) if n < most and t + (s or 0) <= seconds), len(bins))
        if at == len(bins):
            bins.append((0, 0.0))
        bins[at] = (bins[at][0] + 1, bins[at][1] + (s or 0))
        out.append(at + 1)
    return out


def test_overflow_is_first_fit(spark):
    rnd = random.Random(2)
    days = {d: [rnd.choice([None, 0.0, 5.0, 10.0, 40.0]) for _ in range(rnd.randint(1, 15))] for d in range(60)}
    rows = [(d, i, s) for d, parts in days.items() for i, s in enumerate(parts)]
    df = spark.createDataFrame(rows, "d int, i int, s double")
    got = {}
    for r in sessions.assign_overflow(df, ["d"], ["i"], "i", "s", 3, 30.0).collect():
        got.setdefault(r.d, {})[r.i] = r.overflow
    for d, parts in days.items():
        assert [got[d][i] for i in range(len(parts))] == plain_first_fit(parts, 3, 30.0), parts


def plain_chunks(items, chars, seconds, overlap):
    out, cur = [], []
    for i, (a, z, n) in enumerate(items):
        if cur:
            over_time = z - items[cur[0]][0] > seconds
            if over_time or sum(items[j][2] for j in cur) + n > chars:
                out.append((cur[0], cur[-1] + 1))
                if over_time or overlap <= 0:
                    cur = []
                else:
                    kept, total = [], 0
                    for j in reversed(cur):
                        if kept and total + items[j][2] > overlap:
                            break
                        kept.insert(0, j)
                        total += items[j][2]
                    cur = kept if len(kept) < len(cur) else kept[1:]
        cur.append(i)
    return out + [(cur[0], cur[-1] + 1)]


def test_chunks_equal_a_sequential_fold(spark):
    rnd = random.Random(3)
    cases, rows = {}, []
    for g in range(120):
        t, items = 0.0, []
        for _ in range(rnd.randint(1, 14)):
            t += rnd.choice([1, 5, 20])
            items.append((t, t + rnd.randint(0, 6), rnd.randint(0, 12)))
        cases[g] = items
        rows += [(g, i, a, z, n) for i, (a, z, n) in enumerate(items)]
    df = spark.createDataFrame(rows, "g int, i int, a double, z double, n bigint")
    for overlap in (0, 7):
        c = chunks.gathered(df, ["g"], ["i"], start=F.col("a"), stop=F.col("z"), size=F.col("n")).withColumn("sums", chunks.prefix_sums(F.col("items"), "size"))
        got = {r.g: [(b.start, b.stop) for b in r.b] for r in c.select("g", chunks.chunk_bounds(F.col("items"), F.col("sums"), 20, 30.0, overlap).alias("b")).collect()}
        for g, items in cases.items():
            assert got[g] == plain_chunks(items, 20, 30.0, overlap), (items, overlap)


def test_bundles_marks_and_sentences(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([3, 3, 50, 1, 1, 1])], "g int, i int, n bigint")
    g = chunks.gathered(df, ["g"], ["i"], size=F.col("n")).withColumn("sums", chunks.prefix_sums(F.col("items"), "size"))
    b = g.select(chunks.bundle_bounds(F.col("items"), F.col("sums"), 9).alias("b")).first().b
    assert [(x.start, x.stop) for x in b] == [(0, 2), (2, 3), (3, 6)]
    one = spark.range(1)
    times = F.array(*[F.lit(float(x)) for x in (0, 59, 60, 61, 119, 121)])
    assert one.select(chunks.mark_flags(times, 60.0).alias("m")).first().m == [True, False, True, False, False, True]
    assert not any(one.select(chunks.mark_flags(times, 0).alias("m")).first().m)
    assert one.select(chunks.sentences(F.lit("一。二\n\n 三 。")).alias("s")).first().s == ["一。", "二", "三 。"]


def test_close_bounds(spark):
    now = F.lit("2024-01-02 10:00:00").cast("timestamp_ntz")
    rows = [("2024-01-02", "2024-01-02 09:30:00"), ("2024-01-02", "2024-01-02 09:30:01"), ("2024-01-01", "2024-01-02 09:59:00"), ("2024-01-03", "2024-01-02 09:59:00")]
    df = spark.createDataFrame(rows, "d string, u string").select(F.col("d").cast("date").alias("d"), F.col("u").cast("timestamp_ntz").alias("u"))
    assert [r[0] for r in df.select(sessions.close_reason(F.col("d"), F.col("u"), now, 1800)).collect()] == ["idle", None, "stale_day", "stale_day"]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "g int, i int, s timestamp_ntz, e timestamp_ntz")
    assert blocks.gap_blocks(none, "g", "s", "e", 1, "i").count() == 0
    parts = spark.createDataFrame([], "k int, status string")
    assert sessions.all_terminal(spark.createDataFrame([(1,)], "k int"), parts, "k", "status", ["A"]).count() == 0


def test_a_tail_told_twice_is_left_out(spark):
    values, bounds = F.array(*map(F.lit, "abcc")), F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((0, 3), (3, 4))])
    r = spark.range(1).select(chunks.without_repeated_tail(values, bounds).alias("x"), chunks.without_repeated_tail(F.array(*map(F.lit, "abcd")), bounds).alias("y")).first()
    assert len(r.x) == 1 and len(r.y) == 2


def test_previous_rows_across_buckets_and_null_keys(spark):
    """Against a plain walk: buckets of one row and of many, gaps, null values, a null key, repeated rows of other keys."""
    import random

    from pyspark.sql import functions as F

    from logloom.operators import state

    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice(["x", "y", None]), i) for i in sorted(rnd.sample(range(400), 150))]
    want, last = {}, {}
    for k, at, v, n in rows:
        want[n] = last.get(k, "none")
        last[k] = v
    log = spark.createDataFrame(rows, "k string, at int, v string, _row int").repartition(5)
    got = state.with_previous(log, "k", ["at"], F.floor(F.col("at") / 20), "before", "v")
    assert got.columns == ["k", "at", "v", "_row", "before"]
    assert {r["_row"]: "none" if r.before is None else r.before.v for r in got.collect()} == want
    assert state.with_previous(log.limit(0), "k", ["at"], F.col("at"), "before", "v").count() == 0


def test_streaks_across_buckets(spark):
    """Against a plain walk, with buckets that hold no change, one row, or none, and null values and keys."""
    import random

    from pyspark.sql import functions as F

    from logloom.operators import state

    rnd = random.Random(8)
    rows, value = [], {}
    for at in sorted(rnd.sample(range(900), 260)):
        k = rnd.choice(["a", "a", "b", None])
        if rnd.random() < 0.15:
            value[k] = rnd.choice(["x", "y", None])
        rows.append((k, at, value.get(k, "x"), at))
    want, last = {}, {}
    for k, at, v, n in rows:
        run = last[k][1] + 1 if k in last and last[k][0] == v else 1
        last[k] = (v, run)
        want[n] = run
    log = spark.createDataFrame(rows, "k string, at int, v string, _n int").repartition(5)
    for size in (1, 7, 40, 1000):
        got = state.streaks(log, "k", F.col("v"), ["at"], 3, F.floor(F.col("at") / size)).collect()
        assert {r["_n"]: r.streak for r in got} == want and all(r.stable == (r.streak >= 3) for r in got)
