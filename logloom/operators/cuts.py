"""Greedy cuts of long ordered sequences without a list of the sequence: the next cut of every place by a range lookup, the
cuts that are really made by pointer doubling."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.operators.replay import positions
from logloom.plans import Scratch

#: Places of a sequence that are summed up in one window.
BLOCK = 256
#: Sequences of more items are cut here; shorter ones are one list each.
LONG = 1024


def running(rows: DataFrame, key: str, pos: str, value: Column, name: str) -> DataFrame:
    """``rows`` plus ``name``, the sum of ``value`` up to each row, in order of ``pos`` (dense, from 0): windows of BLOCK places,
    and the sums of the blocks before, one row a block."""
    placed = rows.withColumn("_block", F.floor(F.col(pos) / BLOCK)).withColumn("_v", value)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(key, "_block").agg(F.sum("_v").alias("_s")).select(F.col(key).alias("_k2"), F.col("_block").alias("_b2"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy(key, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    both = placed.withColumn("_in", inside).join(sums, F.col(key).eqNullSafe(F.col("_k2")) & (F.col("_block") == F.col("_b2")))
    return both.withColumn(name, F.col("_in") + F.col("_before")).drop("_block", "_v", "_k2", "_b2", "_before", "_in")


def first_beyond(rows: DataFrame, key: str, pos: str, value: str, target: str, width: float, equal: bool) -> DataFrame:
    """``key, pos, next``: the first later place whose ``value`` is above ``target`` (or, with ``equal``, at it); no row where there is none.
    ``value`` must not decrease along ``pos``.

    Values and targets meet in windows by sequence and stretches of ``width``; where a stretch holds no such value, the first of the
    next stretch that has any is taken, from a table of one row a stretch.
    """
    stretch = lambda c: F.floor(F.col(c) / width).cast("bigint")
    values = rows.select(F.col(key).alias("k"), stretch(value).alias("s"), F.col(value).alias("v"), F.lit(1 if equal else 0).alias("kind"), F.col(pos).alias("at"), F.lit(None).cast("bigint").alias("asks"))
    asked = rows.select(F.col(key).alias("k"), stretch(target).alias("s"), F.col(target).alias("v"), F.lit(0 if equal else 1).alias("kind"), F.lit(None).cast("bigint").alias("at"), F.col(pos).alias("asks"))
    after = Window.partitionBy("k", "s").orderBy("v", "kind", "at", "asks").rowsBetween(1, Window.unboundedFollowing)
    met = values.unionByName(asked).withColumn("here", F.min("at").over(after)).filter("asks IS NOT NULL").select("k", "s", "asks", "here")
    # The first value of the next stretch that has any: looked up among the stretches that have values or are asked.
    held = values.groupBy("k", "s").agg(F.min("at").alias("least")).unionByName(met.filter("here IS NULL").select("k", "s").distinct().withColumn("least", F.lit(None).cast("bigint")))
    held = held.groupBy("k", "s").agg(F.min("least").alias("least"))
    ahead = held.select(F.col("k").alias("k2"), F.col("s").alias("s2"), F.min("least").over(Window.partitionBy("k").orderBy("s").rowsBetween(1, Window.unboundedFollowing)).alias("ahead"))
    found = met.join(ahead, F.col("k").eqNullSafe(F.col("k2")) & (F.col("s") == F.col("s2")), "left")
    there = F.coalesce("here", "ahead")
    found = found.select(F.col("k").alias(key), F.col("asks").alias(pos), F.when(there.isNotNull(), F.greatest(there, F.col("asks") + 1)).alias("next"))
    last = rows.groupBy(key).agg(F.max(pos).alias("_last")).withColumnRenamed(key, "_k3")
    return found.filter("next IS NOT NULL").join(last, F.col(key).eqNullSafe(F.col("_k3"))).filter("next <= _last").select(key, pos, "next")


def starts(jumps: DataFrame, firsts: DataFrame, key: str, pos: str, tables: Scratch) -> DataFrame:
    """``key, pos`` of all places that are reached from those of ``firsts`` by jumps (key, pos, next), themselves included:
    jumps of 1, 2, 4 … steps are composed until none is left, then followed from the longest to the shortest."""
    levels = [tables.written(jumps, "jumps-0")]
    while not levels[-1].isEmpty():
        a = levels[-1]
        b = a.select(F.col(key).alias("_k"), F.col(pos).alias("_p"), F.col("next").alias("_n"))
        far = a.join(b, F.col(key).eqNullSafe(F.col("_k")) & (F.col("next") == F.col("_p"))).select(key, pos, F.col("_n").alias("next"))
        levels.append(tables.written(far, f"jumps-{len(levels)}"))
    reached = firsts.select(key, pos)
    for k, a in reversed(list(enumerate(levels[:-1]))):
        b = a.select(F.col(key).alias("_k"), F.col(pos).alias("_p"), "next")
        more = reached.join(b, F.col(key).eqNullSafe(F.col("_k")) & (F.col(pos) == F.col("_p"))).select(key, F.col("next").alias(pos))
        reached = tables.written(reached.unionByName(more), f"reached-{k}")
    return reached


def _flagged(rows: DataFrame, key: str, pos: str, cuts: DataFrame) -> DataFrame:
    """``rows`` plus ``cut``: whether the place is one of ``cuts``."""
    c = cuts.select(F.col(key).alias("_k"), F.col(pos).alias("_p"), F.lit(True).alias("_cut"))
    return rows.join(c, F.col(key).eqNullSafe(F.col("_k")) & (F.col(pos) == F.col("_p")), "left").withColumn("cut", F.coalesce("_cut", F.lit(False))).drop("_k", "_p", "_cut")


def bundles(rows: DataFrame, key: str, order: list[str], bucket: Column, size: str, limit: int, per_item: int = 1, frame: int = 1) -> DataFrame:
    """``rows`` plus ``bundle``, from 0: items are packed in order while the length of their JSON array (sizes, ``per_item`` after
    each, ``frame`` once) stays within ``limit``; a larger item is a bundle of its own. What chunks.bundle_bounds gives
    for a list, for sequences of any length: no list, and no window over a whole sequence of rows. ``bucket`` as in
    replay.positions.
    """
    tables = Scratch(rows.sparkSession, "bundles")
    placed = positions(rows, key, order, bucket, "_pos")
    placed = tables.written(running(placed, key, "_pos", F.col(size).cast("bigint") + per_item, "_sum"), "sums")
    ends = placed.select(F.col(key).alias("k"), "_pos", F.col("_sum").alias("v"), (F.col("_sum") - F.col(size) - per_item + (limit - frame)).alias("t"))
    jumps = first_beyond(ends, "k", "_pos", "v", "t", limit, equal=False)
    cuts = starts(jumps, ends.filter("_pos = 0"), "k", "_pos", tables).withColumnRenamed("k", key)
    found = running(_flagged(placed, key, "_pos", cuts), key, "_pos", F.col("cut").cast("int"), "bundle")
    return found.withColumn("bundle", (F.col("bundle") - 1).cast("int")).drop("_pos", "_sum", "cut")


def marks(rows: DataFrame, key: str, order: list[str], bucket: Column, time: str, interval: float) -> DataFrame:
    """``rows`` plus ``marked``: the first of each sequence, and wherever ``interval`` has passed since the last mark's own
    ``time``. What chunks.mark_flags gives for a list, for sequences of any length. Times must not decrease along ``order``."""
    tables = Scratch(rows.sparkSession, "marks")
    placed = tables.written(positions(rows, key, order, bucket, "_pos"), "placed")
    times = placed.select(F.col(key).alias("k"), "_pos", F.col(time).alias("v"), (F.col(time) + interval).alias("t"))
    jumps = first_beyond(times, "k", "_pos", "v", "t", interval, equal=True)
    cuts = starts(jumps, times.filter("_pos = 0"), "k", "_pos", tables).withColumnRenamed("k", key)
    return _flagged(placed, key, "_pos", cuts).withColumnRenamed("cut", "marked").drop("_pos")


def split_by_length(rows: DataFrame, key: str, long: int = LONG) -> tuple[DataFrame, DataFrame | None]:
    """Rows of sequences of at most ``long`` items, and rows of longer ones (None if there are none)."""
    keys = Scratch(rows.sparkSession, "lengths").written(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > long).select(F.col(key).alias("_k")), "long")
    if keys.isEmpty():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("_k"))
    return rows.join(keys, same, "left_anti"), rows.join(keys, same, "left_semi")
