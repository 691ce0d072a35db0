"""Prefix trie of conversations: a z-fast trie that grows in batches, by joins.

A conversation is a string of turns. Each prefix of it has a 128-bit name: the exclusive or of a hash of every turn and
its depth, so names are running sums, and a conversation in blocks of 256 turns needs no window over all of it. The trie is
compacted: an edge (a, b] leads from an explicit node of depth a to one of depth b, and is found in a hash table by its
handle, the prefix whose length is the two-fattest number of (a, b] (the one that most powers of two divide). A fat binary
search probes handles at two-fattest depths and finds the exit node of a conversation in about log2(depth) lookups.

A batch inserts, of the conversations that leave the trie at the same point by the same next turn, one as a leaf (by
turns the longest, or a random one, so the number of batches grows with the logarithm of the conversations); the others
go on from there in the next batch. An inserted conversation is a chain of edges below its exit point, and a later one
is attached to a point of it. Counts are sums over attachments, from the end of a chain to its top; at last the edges
are expanded to one node for each depth.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.plans import Scratch
from logloom.sources import load

#: Turns of a conversation that are put in order, or summed up, in one window.
BLOCK = 256
#: Conversation ids, by value, that one row of the sorted list of copies spans.
ID_SPAN = 65_536
#: Probes of the fat binary search in one job.
STEPS = 3
#: Tasks that write a table at least, and turns of all conversations for each of them: the many tables of a small input would
#: else be as many tiny files as there are shuffle partitions.
TASKS, TASK_TURNS = 8, 50_000
_LOW = -(1 << 62)


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_hash, n``: turns from 1 in the order of turn (null first), then of the MD5 of role and text;
    n is the code points of the text. Null roles and texts are empty; rows without conv_id belong to no conversation.

    Windows are by conversation and 256 numbers of turn, so a conversation with a third of all rows is many of them
    (turns that tie, or are null, stay together); counts of the blocks before are carried over.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(_LOW)).cast("bigint").alias("_b"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn_hash"), F.length(text).cast("bigint").alias("n"),
    )
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "_b").agg(F.count("*").alias("_n")).select("conv_id", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("conv_id", "_b").orderBy(F.col("turn").asc_nulls_first(), "turn_hash"))
    placed = rows.withColumn("_at", at).join(counts, ["conv_id", "_b"])
    return placed.select("conv_id", (F.col("_at") + F.col("_before")).alias("pos"), "turn_hash", "n")


def with_shared_starts(turns: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on those of the ids divisible by 100: conversation c takes the first h turns of c - c % 100
    (all if fewer, none if absent) in place of its own first h; h = crc32(c) % 6. Returns the rebuilt turns and all ids."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("_size"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6))
    ids = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("_base"), h.alias("_h"))
    bases = sizes.select(F.col("conv_id").alias("_base"), "_size")
    k = F.least("_h", F.coalesce("_size", F.lit(0)))
    ids = tables.written(ids.join(bases, "_base", "left").select("conv_id", "_base", "_h", k.alias("_k")), "starts")
    own = turns.join(ids, "conv_id").filter("pos > _h").select("conv_id", (F.col("pos") - F.col("_h") + F.col("_k")).alias("depth"), "turn_hash", "n")
    first = turns.filter("pos <= 5 AND conv_id % 100 = 0").withColumnRenamed("conv_id", "_base")
    shared = ids.filter("_k > 0").join(first, "_base").filter("pos <= _k").select("conv_id", F.col("pos").alias("depth"), "turn_hash", "n")
    return own.unionByName(shared), ids.select("conv_id")


def prefixes(turns: DataFrame, tables: Scratch) -> DataFrame:
    """``conv_id, depth, h, k, n, total, nh, nk``: the name (h, k) of each prefix, the size of its last turn, and of all of
    it, and the name of the prefix one turn longer (null for the last)."""
    each = [F.xxhash64(F.lit(seed), "depth", "turn_hash").alias(c) for c, seed in (("h", 1), ("k", 2))]
    rows = turns.select("conv_id", "depth", F.floor(F.col("depth") / BLOCK).alias("_b"), *each, "n")
    inside = Window.partitionBy("conv_id", "_b").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("conv_id", "_b").agg(F.bit_xor("h").alias("_h"), F.bit_xor("k").alias("_k"), F.sum("n").alias("_n"))
    carried = ends.select("conv_id", "_b", F.bit_xor("_h").over(before).alias("_h"), F.bit_xor("_k").over(before).alias("_k"), F.sum("_n").over(before).alias("_n")).filter("_h IS NOT NULL")
    rows = rows.select("conv_id", "depth", "_b", "n", F.bit_xor("h").over(inside).alias("h"), F.bit_xor("k").over(inside).alias("k"), F.sum("n").over(inside).alias("total"))
    zero = F.lit(0).cast("bigint")
    plus = rows.join(carried, ["conv_id", "_b"], "left")
    plus = plus.select(
        "conv_id", "depth", F.col("h").bitwiseXOR(F.coalesce("_h", zero)).alias("h"), F.col("k").bitwiseXOR(F.coalesce("_k", zero)).alias("k"), "n", (F.col("total") + F.coalesce("_n", zero)).alias("total")
    )
    plus = tables.written(plus, "prefixes")
    ahead = plus.filter("depth > 1").select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("h").alias("nh"), F.col("k").alias("nk"))
    return plus.join(ahead, ["conv_id", "depth"], "left")


def _spread_nulls(key: str, *by: str) -> Column:
    """A second join key: 0, or a hash where ``key`` is null, as rows that can't match would else meet in one task."""
    return F.when(F.col(key).isNull(), F.xxhash64(*by)).otherwise(0)


def two_fattest(low: Column, high: Column) -> Column:
    """The number of (low, high] that the highest power of two divides; null where there is none."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.when(low < high, F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits))


def _edges(done: DataFrame, names: DataFrame) -> DataFrame:
    """Edges ``q, a, b`` of all chains, with the names of their handle (f, fh, fk), their first turn (th, tk) and their end
    (bh, bk): a chain is cut where others are attached to it or end."""
    none = F.lit(None).cast("bigint")
    points = done.filter("p IS NOT NULL").select(F.col("p").alias("q"), F.col("x").alias("b"), none.alias("top"))
    points = points.unionByName(done.filter("x < n").select(F.col("c").alias("q"), F.col("n").alias("b"), F.col("x").alias("top"))).groupBy("q", "b").agg(F.max("top").alias("top"))
    w = Window.partitionBy("q").orderBy("b")
    e = points.select("q", F.coalesce(F.lag("b").over(w), F.max("top").over(Window.partitionBy("q"))).alias("a"), "b")
    e = e.withColumn("f", two_fattest(F.col("a"), F.col("b")))
    asked = e.select("q", "a", "b", "f", F.explode(F.array_distinct(F.array("f", F.col("a") + 1, "b"))).alias("d"))
    found = asked.join(names.select(F.col("conv_id").alias("q"), F.col("depth").alias("d"), "h", "k"), ["q", "d"])
    kinds = {"f": F.col("d") == F.col("f"), "t": F.col("d") == F.col("a") + 1, "b": F.col("d") == F.col("b")}
    return found.groupBy("q", "a", "b", "f").agg(*[F.max(F.when(is_, F.col(c))).alias(kind + c) for kind, is_ in kinds.items() for c in ("h", "k")])


def _searched(active: DataFrame, edges: DataFrame, mine: DataFrame, tables: Scratch, job: str) -> DataFrame:
    """``c, n, p, x, e``: the edge with the deepest handle that is a prefix of the conversation, by fat binary search from
    depth x on (null: none). STEPS probes make one job; those whose interval is closed take no part in the next."""
    mine = mine.select(F.col("conv_id").alias("c"), F.col("depth").alias("f"), F.col("h").alias("fh"), F.col("k").alias("fk"))
    handles = edges.select("f", "fh", "fk", F.lit(0).cast("bigint").alias("_s"), F.struct("q", "a", "b", F.col("bh").alias("h"), F.col("bk").alias("k")).alias("_e"))
    none = F.lit(None).cast("struct<q:bigint,a:bigint,b:bigint,h:bigint,k:bigint>")
    now, closed, k = active.select("c", "n", "p", "x", F.col("x").alias("lo"), F.col("n").alias("hi"), none.alias("e")), None, 0
    while True:
        for _ in range(STEPS):
            now = now.withColumn("f", two_fattest(F.col("lo"), F.col("hi"))).join(mine, ["c", "f"], "left")
            now = now.withColumn("_s", _spread_nulls("fh", "c")).join(handles, ["f", "fh", "fk", "_s"], "left")
            hit = F.col("_e").isNotNull()
            lo, hi = F.when(hit, F.col("_e.b")).otherwise(F.col("lo")), F.when(F.col("f").isNotNull() & ~hit, F.col("f") - 1).otherwise(F.col("hi"))
            now = now.select("c", "n", "p", "x", lo.alias("lo"), hi.alias("hi"), F.coalesce("_e", "e").alias("e"))
        now = tables.written(now, f"{job}-{k}")
        some = now.filter("lo >= hi").select("c", "n", "p", "x", "e")
        closed = some if closed is None else closed.unionByName(some)
        now, k = now.filter("lo < hi"), k + 1
        if now.isEmpty():
            return closed


def _located(active: DataFrame, edges: DataFrame, mine: DataFrame, names: DataFrame, tables: Scratch, job: str) -> DataFrame:
    """``c, n, p, x, nh, nk``: where each active conversation leaves the trie (depth x of chain p, null for the root) and
    the name of its prefix one turn further. ``active`` has the point (p, x) up to which it is known to agree, ``mine``
    the prefixes of active conversations, ``names`` all prefixes."""
    now = _searched(active, edges, mine, tables, job)
    # At the end of the edge found: does the conversation reach it, and is there an edge on from there?
    here = mine.select(F.col("conv_id").alias("c"), F.col("depth").alias("_at"), F.col("h").alias("_h"), F.col("k").alias("_k"), "nh", "nk")
    root = mine.filter("depth = 1").select(F.col("conv_id").alias("c"), F.lit(0).cast("bigint").alias("_at"), F.lit(0).cast("bigint").alias("_h"), F.lit(0).cast("bigint").alias("_k"), F.col("h").alias("nh"), F.col("k").alias("nk"))
    now = now.withColumn("_at", F.coalesce(F.col("e.b"), F.col("x"))).join(here.unionByName(root), ["c", "_at"], "left")
    full = F.col("e").isNull() | F.coalesce((F.col("_h") == F.col("e.h")) & (F.col("_k") == F.col("e.k")), F.lit(False))
    tops = edges.select(F.col("a").alias("_at"), F.col("th").alias("nh"), F.col("tk").alias("nk"), F.lit(0).cast("bigint").alias("_s"), F.struct("q", "a", "b").alias("_child"))
    now = now.withColumn("full", full).withColumn("_s", _spread_nulls("nh", "c")).join(tops, ["_at", "nh", "nk", "_s"], "left")
    own = F.when(~F.col("full"), F.struct(F.col("e.q").alias("q"), F.col("e.a").alias("a"), F.col("e.b").alias("b")))
    now = tables.written(now.withColumn("on", F.when(F.col("full"), F.col("_child")).otherwise(own)), f"{job}-reached")
    # How far it goes along that edge: prefixes of equal name.
    part = now.filter("on IS NOT NULL").select("c", F.col("on.q").alias("q"), F.col("on.a").alias("a"), F.least(F.col("on.b"), F.col("n")).alias("b"))
    own = mine.select(F.col("conv_id").alias("c"), F.col("depth").alias("f"), F.col("h").alias("fh"), F.col("k").alias("fk"), "nh", "nk")
    theirs = names.select(F.col("conv_id").alias("q"), F.col("depth").alias("f"), F.col("h").alias("fh"), F.col("k").alias("fk"))
    along = part.join(own, "c").filter("f > a AND f <= b").join(theirs, ["q", "f", "fh", "fk"])
    agree = along.groupBy("c").agg(F.max_by(F.struct(F.col("f").alias("x"), "nh", "nk"), "f").alias("_x"))
    now = now.join(agree, "c", "left")
    p = F.when(F.col("on").isNotNull(), F.col("on.q")).when(F.col("e").isNotNull(), F.col("e.q")).otherwise(F.col("p"))
    new = {c: F.when(F.col("on").isNotNull(), F.col(f"_x.{c}")).otherwise(F.col("_at" if c == "x" else c)).alias(c) for c in ("x", "nh", "nk")}
    return now.select("c", "n", p.alias("p"), new["x"], new["nh"], new["nk"])


def grown(strings: DataFrame, names: DataFrame, tables: Scratch) -> DataFrame:
    """``c, n, p, x, path``: every string with the point at which it left the trie when it was inserted, and the points
    (q, x) of all chains on its way, its own end last. A string that leaves at its own end (x = n) has no chain."""
    path_type = "array<struct<q:bigint,x:bigint>>"
    first = names.filter("depth = 1").select(F.col("conv_id").alias("c"), F.col("h").alias("nh"), F.col("k").alias("nk"))
    located = strings.select("c", "n", F.lit(None).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("x")).join(first, "c", "left")
    done, mine, k = None, names, 0
    while True:
        located = tables.written(located, f"located-{k}")
        random = F.xxhash64("c", F.lit(k))
        order = F.struct("n", random, "c") if k % 2 == 0 else F.struct(random, "n", "c")
        by = ["p", "x", "nh", "nk"]
        chosen = located.filter("x < n").groupBy(*by).agg(F.max_by(F.struct("c", "n"), order).alias("_r"))
        chosen = tables.written(chosen.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_r.c").alias("c"), F.col("_r.n").alias("n")), f"chosen-{k}")
        new = located.filter("x = n").select("c", "n", "p", "x").unionByName(chosen.select("c", "n", F.col("_p").alias("p"), F.col("_x").alias("x")))
        if done is None:
            new = new.withColumn("_before", F.array().cast(path_type))
        else:
            new = new.join(done.filter("x < n").select(F.col("c").alias("p"), F.slice("path", F.lit(1), F.size("path") - 1).alias("_before")), "p")
        own = F.when(F.col("x") < F.col("n"), F.array(F.struct(F.col("c").alias("q"), F.col("n").alias("x")))).otherwise(F.array().cast(path_type))
        here = F.array(F.struct(F.col("p").alias("q"), F.col("x").alias("x")))
        new = tables.written(new.select("c", "n", "p", "x", F.concat("_before", here, own).cast(path_type).alias("path")), f"new-{k}")
        done = new if done is None else done.unionByName(new)
        same = [located[c].eqNullSafe(chosen[f"_{c}"]) for c in by]
        left = located.filter("x < n").join(chosen.withColumnRenamed("c", "_c").drop("n"), same).filter("c <> _c")
        active = tables.written(left.select("c", "n", "p", "x"), f"active-{k}")
        tables.free(f"located-{k}", f"chosen-{k}")
        if active.isEmpty():
            return done
        edges = tables.written(_edges(done, names), f"edges-{k}")
        mine = tables.written(mine.join(active.select(F.col("c").alias("conv_id")), "conv_id", "left_semi"), f"names-{k}")
        if k:
            tables.free(f"active-{k - 1}", f"edges-{k - 1}", f"names-{k - 1}")
        located = _located(active, edges, mine, names, tables, f"search-{k}")
        k += 1


def _ends_hashed(members: DataFrame, tables: Scratch) -> DataFrame:
    """``c, ends``: SHA-256 of the ids of each group of copies, ascending, joined by commas. A row that is sent spans
    ID_SPAN ids by value, and the hash is fed a row at a time, so a group of any size takes little memory; SHA-256 itself
    can't be split, so a group's rows, not its ids, meet in one task."""
    parts = members.groupBy("c", F.floor(F.col("conv_id") / ID_SPAN).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    parts = tables.written(parts, "copies")
    n = parts.groupBy("c").agg(F.count("*").alias("_n"), F.first("ids").alias("ids"))
    one = n.filter("_n = 1").select("c", F.sha2("ids", 256).alias("ends"))
    many = parts.join(n.filter("_n > 1").select("c"), "c", "left_semi").repartition("c").sortWithinPartitions("c", "part")

    def rows(batches):
        at, sha = None, None
        for batch in batches:
            done = []
            for c, ids in zip(batch.column("c").to_pylist(), batch.column("ids").to_pylist()):
                if c != at:
                    if sha:
                        done.append((at, sha.hexdigest()))
                    at, sha = c, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["c", "ends"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["c", "ends"])

    return one.unionByName(many.select("c", "ids").mapInArrow(rows, "c bigint, ends string"))


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row a node of the trie of all conversations, the root included: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, sizes of last turns once for each member
    but one) and ends_sha256 (of the ids that end there).

    ``turns`` has conv_id, depth (from 1 without gaps), turn_hash (equal for equal turns) and n (size of the turn);
    ``ids`` all conversations, also those without turns. No conversation, no row. Exact copies are inserted as one. Conversations
    of any length and nodes with any number of children are rows of joins, and no list of turns or children is built;
    explicit points of one chain are one window, after they are combined by depth.
    """
    tables = Scratch(turns.sparkSession, "prefix-trie")
    names = tables.written(prefixes(turns, tables), "names")
    tables.free("prefixes")
    tables.tasks = max(TASKS, -(-names.count() // TASK_TURNS))
    zero = F.lit(0).cast("bigint")
    last = names.groupBy("conv_id").agg(F.max("depth").alias("n"), F.max_by(F.struct("h", "k"), "depth").alias("e"))
    every = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("n", zero).alias("n"), F.coalesce("e.h", zero).alias("h"), F.coalesce("e.k", zero).alias("k"))
    every = tables.written(every, "conversations")
    strings = tables.written(every.groupBy("n", "h", "k").agg(F.min("conv_id").alias("c"), F.count("*").alias("m")), "strings")
    members = every.join(strings.select("n", "h", "k", "c"), ["n", "h", "k"]).select("c", "conv_id")
    done = tables.written(grown(strings, names, tables).join(strings.select("c", "m"), "c"), "grown")

    # Sums at the explicit points of each chain (q null: the root).
    way = done.select("c", "n", "m", F.col("x").alias("top"), F.col("p"), F.posexplode("path").alias("i", "at"), F.size("path").alias("len"))
    way = way.select("c", "n", "m", "top", F.col("at.q").alias("q"), F.col("at.x").alias("b"), (F.col("top") < F.col("n")).alias("chain"), (F.col("len") - F.col("i")).alias("back"))
    child = F.col("chain") & (F.col("back") == 2)
    end = (F.col("back") == 1).cast("boolean")
    points = way.groupBy("q", "b").agg(F.sum("m").alias("m"), F.min("c").alias("low"), F.count_if(child).alias("kids"), F.max(F.when(end, F.col("c"))).alias("end"))
    points = tables.written(points, "points")
    down = Window.partitionBy("q").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("q").orderBy("b")
    chains = done.filter("x < n").select(F.col("c").alias("q"), F.col("x").alias("top"), F.col("p").alias("above"))
    total = names.select(F.col("conv_id").alias("q"), F.col("depth").alias("b"), "total")
    tops = chains.join(total.withColumnRenamed("b", "top"), ["q", "top"], "left").select("q", "top", "above", F.coalesce("total", zero).alias("top_total"))
    e = points.filter("q IS NOT NULL").join(total, ["q", "b"])
    e = e.select("*", F.sum("m").over(down).alias("n_convs"), F.min("low").over(down).alias("conv_id"), F.lag("b").over(up).alias("_a"), F.lag("total").over(up).alias("_t"), F.lead("b").over(up).isNull().alias("last"))
    e = e.join(tops, "q").withColumn("a", F.coalesce("_a", "top")).withColumn("a_total", F.coalesce("_t", "top_total"))
    e = e.withColumn("w", (F.col("n_convs") - 1) * (F.col("total") - F.col("a_total")))
    e = tables.written(e.select("q", "a", "b", "top", "above", "total", "n_convs", "conv_id", "kids", "end", "last", "w"), "edges")
    own = e.groupBy("q").agg(F.sum("w").alias("w"), F.count_if(F.col("last") & (F.col("kids") == 0)).alias("leaf"))
    below = way.filter("chain").join(own.select(F.col("q").alias("c"), "w", "leaf"), "c").groupBy("q", "b").agg(F.sum("leaf").alias("leaf"), F.sum(F.when(F.col("back") > 1, F.col("w"))).alias("under"))
    below = tables.written(below, "below")
    e = e.join(below, ["q", "b"], "left")
    under = F.sum(F.coalesce("under", zero)).over(down) + F.coalesce(F.sum("w").over(down.rowsBetween(Window.unboundedPreceding, -1)), zero)
    e = e.select("*", F.sum(F.coalesce("leaf", zero)).over(down).alias("n_leaves"), under.alias("saved_below"), F.lag("conv_id").over(up).alias("_up"))
    e = tables.written(e.drop("leaf", "under"), "counted")

    root = points.filter("q IS NULL").select(F.col("low").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.col("m").alias("n_convs"), F.col("kids").alias("n_children"), "end")
    root_below = below.filter("q IS NULL").agg(F.sum("leaf").alias("leaf"), F.sum("under").alias("under"))
    root = root.withColumn("_one", F.lit(1)).join(root_below.withColumn("_one", F.lit(1)), "_one")
    root = root.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.greatest(F.coalesce("leaf", zero), F.lit(1)).alias("n_leaves"), F.coalesce("under", zero).alias("saved_tokens"), "end")

    # Edges expanded: a node for each turn of the chain's conversation between a and b, met in blocks of turns.
    least = points.filter("q IS NULL").select(F.lit(None).cast("bigint").alias("above"), F.lit(0).cast("bigint").alias("top"), F.col("low").alias("_over"))
    over = least.unionByName(e.select(F.col("q").alias("above"), F.col("b").alias("top"), F.col("conv_id").alias("_over")))
    e = e.join(over.select(F.col("above").alias("_p"), F.col("top").alias("_t"), "_over"), F.col("above").eqNullSafe(F.col("_p")) & (F.col("a") == F.col("_t")) & (F.col("a") == F.col("top")), "left")
    e = e.withColumn("_parent", F.coalesce("_up", "_over")).withColumn("_block", F.explode(F.sequence(F.floor((F.col("a") + 1) / BLOCK), F.floor(F.col("b") / BLOCK))))
    rows = names.select(F.col("conv_id").alias("q"), F.floor(F.col("depth") / BLOCK).alias("_block"), "depth", (F.col("total") - F.col("n")).alias("before"))
    rows = rows.join(e.drop("_p", "_t"), ["q", "_block"]).filter("depth > a AND depth <= b")
    at_end = F.col("depth") == F.col("b")
    nodes = rows.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("a") + 1, F.col("_parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(at_end, F.col("kids") + F.when(F.col("last"), 0).otherwise(1)).otherwise(1).cast("bigint").alias("n_children"), "n_leaves",
        ((F.col("n_convs") - 1) * (F.col("total") - F.col("before")) + F.col("saved_below")).alias("saved_tokens"), F.when(at_end, F.col("end")).alias("end"),
    )
    ends = _ends_hashed(members, tables)
    nodes = root.unionByName(nodes).withColumn("_s", _spread_nulls("end", "conv_id", "depth"))
    nodes = nodes.join(ends.select(F.col("c").alias("end"), F.lit(0).cast("bigint").alias("_s"), "ends"), ["end", "_s"], "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def query(spark, sf_dir):
    tables = Scratch(spark, "conversations")
    turns = tables.written(numbered(load(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(*with_shared_starts(turns, tables))


#: Prefixes of sf0.01 as strings of MD5 sums; crc32 bit by bit over the digits of an id.
_ORACLE = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, count(*) AS size, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda a, d: list_reduce(list_prepend(xor(a, d), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 6 AS h FROM t GROUP BY conv_id),
    k AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.size, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
    r AS (SELECT conv_id, pos - h + k AS depth, s, n FROM t JOIN k USING (conv_id) WHERE pos > h UNION ALL SELECT k.conv_id, pos, s, n FROM k JOIN t ON t.conv_id = k.base WHERE pos <= k),
    p AS (SELECT conv_id, depth, n, md5(string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS key FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM k),
    m AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
    g AS (SELECT key, depth, any_value(up) AS up, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY key, depth),
    kids AS (SELECT up AS key, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY up),
    f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (key)),
    below AS (SELECT u.key, count(*) FILTER (f.n_children = 0) AS n_leaves, CAST(sum((f.n_convs - 1) * f.n) AS BIGINT) AS saved_tokens FROM f JOIN m d ON d.key = f.key AND d.conv_id = f.conv_id JOIN m u ON u.conv_id = d.conv_id AND u.depth <= d.depth GROUP BY u.key)
    SELECT f.conv_id, f.depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256 FROM f JOIN below USING (key) LEFT JOIN g o ON o.key = f.up"""

QUERIES = {"op11_conversation_trie": query}
ORACLES = {"op11_conversation_trie": _ORACLE}
