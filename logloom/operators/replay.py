"""Compare-and-set replay of an append-only log: many wanted transitions of one entity, each against the state before it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.functions import dims
from logloom.plans import Scratch
from logloom.sources import load

#: Events, or blocks of events, that are composed in one row.
BLOCK = 256
#: Stands for "no such entity" among states.
_UNKNOWN = "\x00"


def positions(rows: DataFrame, key: str, order: list[str], bucket: Column, name: str) -> DataFrame:
    """``rows`` plus ``name``: the place of each row, from 0, in its entity's ``order``.

    Windows are by entity and ``bucket`` (a day, for example; it must not decrease along ``order``); the counts of the
    buckets before are one row an entity and bucket, so an entity with a third of all rows is many windows.
    """
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.col(key).alias("_k"), bucket.alias("_b"), F.struct(*order).alias("_o"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = packed.groupBy("_k", "_b").agg(F.count("*").alias("_n")).select("_k", "_b", before.alias("_before"))
    at = F.row_number().over(Window.partitionBy("_k", "_b").orderBy(F.col("_o").asc_nulls_first())) - 1
    same = F.col("r._k").eqNullSafe(F.col("c._k")) & F.col("r._b").eqNullSafe(F.col("c._b"))
    placed = packed.withColumn("_at", at).alias("r").join(counts.alias("c"), same)
    return placed.select("_row.*", (F.col("_at") + F.col("_before")).cast("bigint").alias(name))


def _composed(items: Column, step) -> Column:
    """The function of a run of steps as a map of the states that it may change; ``step`` gives the state after an item."""
    froms = F.array_distinct(F.flatten(F.transform(items, lambda x: x["froms"])))
    return F.map_from_arrays(froms, F.transform(froms, lambda s: F.aggregate(items, s, step)))


def _states(items: Column, start: Column, step) -> Column:
    """The state before each item."""
    begin = F.struct(start.alias("s"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(items, begin, lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")), lambda acc: acc["out"])


def _event(state: Column, x: Column) -> Column:
    return F.when(state == x["from"], x["to"]).otherwise(state)


def _run(state: Column, x: Column) -> Column:
    return F.coalesce(F.try_element_at(x["does"], state), state)


def replay(wanted: DataFrame, current: DataFrame, key: str, from_col: str, to_col: str, order: list[str], bucket: Column, legal: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``wanted`` plus ``found``, the state that an event meets (null: no such entity), and ``accepted``: it is the one that
    the event expects. An accepted event leaves its to_col as state, a refused one changes nothing. An event that expects
    null is a birth. ``current`` has key and status of the entities before; with ``legal`` (from_status, to_status) other
    transitions are refused, births never.

    A transition maps states to states, and so does a run of them; such maps compose associatively. Runs of ``block`` events
    are composed to one map, runs of ``block`` maps to one, and so on; the states at the starts of runs then come down
    the same levels. So an entity with a third of all events is as many rows as its events fill blocks, and the depth
    grows with the logarithm of its events. Ties of ``order`` are taken in any order.
    """
    tables = Scratch(wanted.sparkSession, "replay")
    code = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_UNKNOWN))
    rows = positions(wanted, key, order, bucket, "_pos")
    if legal is not None:
        pairs = legal.select(F.col("from_status").alias(from_col), F.col("to_status").alias(to_col)).distinct().withColumn("_legal", F.lit(True))
        rows = rows.join(F.broadcast(pairs), [from_col, to_col], "left").withColumn("_legal", F.coalesce("_legal", F.col(from_col).isNull()))
    else:
        rows = rows.withColumn("_legal", F.lit(True))
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in wanted.columns]).alias("_row"), F.col(key).alias("_k"), "_pos", code(from_col).alias("from"), code(to_col).alias("to"), "_legal")
    # A refused transition is one from a state that no entity is in.
    source = F.when(F.col("_legal"), F.col("from")).otherwise(F.lit("\x01"))
    rows = tables.written(rows.select("_row", "_k", "_pos", source.alias("from"), "to"), "events")

    item = F.struct("_pos", "from", "to", F.array("from").alias("froms"))
    level = rows.groupBy("_k", F.floor(F.col("_pos") / block).alias("_at")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    levels = [tables.written(level.select("*", _composed(F.col("items"), _event).alias("does")), "level-0")]
    while (levels[-1].agg(F.max("_at")).first()[0] or 0) > 0:
        level = levels[-1].groupBy("_k", F.floor(F.col("_at") / block).alias("_up")).agg(F.array_sort(F.collect_list(F.struct("_at", F.map_entries("does").alias("e")))).alias("items"))
        items = F.transform("items", lambda x: F.struct(x["_at"].alias("_at"), F.map_from_entries(x["e"]).alias("does"), F.transform(x["e"], lambda y: y["key"]).alias("froms")))
        level = level.select("_k", F.col("_up").alias("_at"), items.alias("items"))
        levels.append(tables.written(level.select("*", _composed(F.col("items"), _run).alias("does")), f"level-{len(levels)}"))
    start = current.select(F.col(key).alias("_k"), F.coalesce("status", F.lit(_UNKNOWN)).alias("_start"))
    start = levels[-1].select("_k", "_at").join(start, "_k", "left").withColumn("_start", F.coalesce("_start", F.lit(_UNKNOWN)))
    for k in range(len(levels) - 1, -1, -1):
        met = levels[k].alias("l").join(start.alias("s"), F.col("l._k").eqNullSafe(F.col("s._k")) & (F.col("l._at") == F.col("s._at")))
        states = _states(F.col("items"), F.col("_start"), _run if k else _event)
        each = met.select("l._k", F.explode(F.arrays_zip("items", states.alias("states"))).alias("x"))
        start = each.select("_k", (F.col("x.items._at") if k else F.col("x.items._pos")).alias("_at"), F.col("x.states").alias("_start"))
        if k:
            start = tables.written(start, f"starts-{k}")
    found = rows.alias("r").join(start.alias("s"), F.col("r._k").eqNullSafe(F.col("s._k")) & (F.col("r._pos") == F.col("s._at")))
    return found.select("_row.*", F.nullif(F.col("_start"), F.lit(_UNKNOWN)).alias("found"), (F.col("_start") == F.col("from")).alias("accepted"))


# -- query ------------------------------------------------------------------------------------------------------------

_FROM = ("signup", "view", "click", "view", "error", "purchase")


def q_replay(spark, sf_dir):
    """Events as wanted transitions of their user: each expects a state by its number, or is a birth; customers begin as
    signup, all others are unknown before their birth."""
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("to_status"))
    expected = F.element_at(F.array(*map(F.lit, _FROM)), (F.col("event_id") % 6 + 1).cast("int"))
    e = e.withColumn("from_status", F.when(F.col("event_id") % 7 != 0, expected))
    current = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("signup").alias("status"))
    found = replay(e, current, "user_id", "from_status", "to_status", ["ts", "event_id"], F.to_date("ts"))
    return found.select("event_id", "user_id", "from_status", "to_status", "found", "accepted")


def q_replay_legal(spark, sf_dir):
    """Order states of customers as part transitions that follow one another, against the table of legal ones: which an
    order's number asks for, and which of them are refused."""
    names = F.array(*map(F.lit, dims.PART_STATES))
    pick = lambda n: F.element_at(names, (n % len(dims.PART_STATES) + 1).cast("int"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", pick(F.floor(F.col("o_orderkey") / 4)).alias("from_status"), pick(F.floor(F.col("o_orderkey") / 4) + F.col("o_orderkey") % 3).alias("to_status"))
    current = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("DISCOVERED").alias("status"))
    legal = dims.transition_table(spark).filter("entity = 'part'")
    found = replay(o, current, "o_custkey", "from_status", "to_status", ["o_orderdate", "o_orderkey"], F.year("o_orderdate"), legal)
    return found.select("o_orderkey", "from_status", "to_status", "found", "accepted")


def _fold(events: str, first: str, by: str) -> str:
    """A recursive fold in the order of ``events`` (k, i, f, t, ok); ``first`` gives the state before."""
    return f"""WITH RECURSIVE w AS ({events}), f AS (
        SELECT w.*, c.s AS found, w.ok AND w.f IS NOT DISTINCT FROM c.s AS accepted, CASE WHEN w.ok AND w.f IS NOT DISTINCT FROM c.s THEN w.t ELSE c.s END AS s FROM w LEFT JOIN ({first}) c ON c.k = w.k WHERE i = 1
        UNION ALL SELECT w.*, f.s, w.ok AND w.f IS NOT DISTINCT FROM f.s, CASE WHEN w.ok AND w.f IS NOT DISTINCT FROM f.s THEN w.t ELSE f.s END FROM f JOIN w ON w.k = f.k AND w.i = f.i + 1)
      SELECT {by}, f AS from_status, t AS to_status, found, accepted FROM f"""


_NAMES = "[" + ", ".join(f"'{s}'" for s in dims.PART_STATES) + "]"
_N = len(dims.PART_STATES)
QUERIES = {"transition_replay": q_replay, "transition_replay_legal": q_replay_legal}
ORACLES = {
    "transition_replay": _fold(
        f"""SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_id % 7 <> 0 THEN {list(_FROM)!r}[event_id % 6 + 1] END AS f, event_type AS t, true AS ok FROM events""",
        "SELECT c_custkey AS k, 'signup' AS s FROM customer", "event_id, k AS user_id",
    ),
    "transition_replay_legal": _fold(
        f"""SELECT k, o_orderkey, i, f, t, (f, t) IN ({", ".join(f"('{a}', '{b}')" for a, b in dims.transitions("part"))}) AS ok FROM (SELECT o_custkey AS k, o_orderkey,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, {_NAMES}[(o_orderkey // 4) % {_N} + 1] AS f, {_NAMES}[(o_orderkey // 4 + o_orderkey % 3) % {_N} + 1] AS t FROM orders)""",
        "SELECT c_custkey AS k, 'DISCOVERED' AS s FROM customer", "o_orderkey",
    ),
}
