"""SimHash fingerprints and near-duplicate groups at a Hamming distance of four or less.

Method: vantage-point trees. Two fingerprints at distance four or less differ by at most 1, 1 or 0 bits in one of three
bit blocks (if they exceeded all three radii they would differ by 2 + 2 + 1 bits). So there is one vantage-point tree
for each block: an inner node has a vantage fingerprint and a radius, and parts fingerprints by Hamming distance inside
the block. A fingerprint lives in one leaf of each tree and, by the triangle inequality, must also be looked up in the
leaves that its block radius reaches across a boundary. Leaves are the shards; inside a shard, rings of distance to a
vantage fingerprint over all 64 bits bound the pairs that are compared, and the comparison is exact.

Searching one tree over all 64 bits with radius 4 is as exact, but seven in ten random fingerprints then cross each
boundary; with the block radii it is about one in three, and none in the tree of radius 0.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.arrow_texts import bound_batches, released
from logloom.llm.components import connected_components
from logloom.plans import Scratch
from logloom.sources import load

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: (mask, search radius) of the three blocks; radii plus one add up to DISTANCE + 1.
BLOCKS = ((0xFFFFFC0000000000, 1), (0x000003FFFFE00000, 1), (0x00000000001FFFFF, 0))
#: Fingerprints that a leaf stands for; those sampled for each leaf; and sampled at most (2 MB), which bounds the depth.
LEAF, PER_LEAF, MOST_SAMPLE = 2000, 8, 1 << 18
#: Fingerprints of a task that go down a tree together.
TOGETHER = 1 << 18
TILE_HOMES, TILE_VISITORS = 4000, 60_000


def fingerprint(body: bytes) -> int:
    words = body.lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    text = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(text, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip((end - size)[:n].tolist(), end[SHINGLE - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprint_rows(batches):
    for batch in batches:
        text = batch.column("_text")
        found = np.fromiter((fingerprint((t.as_py() or "").encode()) for t in text), np.uint64, len(text))
        others = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(found.view(np.int64))], names=[*others, "fp"])


def text_hash(text_col: str = "text") -> Column:
    """128 bits that tell texts of one id apart; null for a null text."""
    return F.md5(F.col(text_col).cast("binary"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """``_id`` and ``fp`` (the 64 bits as a signed long) of each row, and ``_hash`` (see text_hash) on demand; a null text
    has no words and fingerprint zero."""
    bound_batches(docs.sparkSession)
    hashes = [text_hash(text_col).alias("_hash")] if hashed else []
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), *hashes, F.col(text_col).alias("_text"))
    return rows.mapInArrow(released(_fingerprint_rows), "_id bigint, _hash string, fp bigint" if hashed else "_id bigint, fp bigint")


@dataclass
class Node:
    vantage: int = 0
    radius: int = -1
    inner: "Node | None" = None
    outer: "Node | None" = None
    leaf: int = -1


def distance(a: np.ndarray, b: int, mask: int = 2**64 - 1) -> np.ndarray:
    return np.bitwise_count((a ^ np.uint64(b)) & np.uint64(mask)).astype(np.int16)


def build_tree(sample: np.ndarray, mask: int, total: float, numbers) -> Node:
    """Splits at the radius nearest the median until a leaf stands for about LEAF of ``total`` fingerprints."""
    if total > LEAF and len(sample) >= PER_LEAF:
        tries = sample[np.linspace(0, len(sample) - 1, 5).astype(int)]
        cuts = []
        for v in tries.tolist():
            d = np.bincount(distance(sample, v, mask), minlength=66).cumsum()
            r = int(np.argmin(np.abs(d - len(sample) / 2)))
            crossing = int(d[min(r + 1, 65)] - (d[r - 1] if r else 0))
            if 0 < d[r] < len(sample):
                cuts.append((max(d[r], len(sample) - d[r]), crossing, v, r))
        if cuts:
            _, _, v, r = min(cuts)
            inside = distance(sample, v, mask) <= r
            part = total * inside.mean()
            return Node(v, r, build_tree(sample[inside], mask, part, numbers), build_tree(sample[~inside], mask, total - part, numbers))
    return Node(leaf=next(numbers))


def homes(tree: Node, fps: np.ndarray, mask: int) -> np.ndarray:
    out = np.zeros(len(fps), np.int32)

    def go(node, at):
        if not len(at):
            return
        if node.leaf >= 0:
            out[at] = node.leaf
            return
        inside = distance(fps[at], node.vantage, mask) <= node.radius
        go(node.inner, at[inside])
        go(node.outer, at[~inside])

    go(tree, np.arange(len(fps)))
    return out


def visits(tree: Node, fps: np.ndarray, mask: int, reach: int):
    """(leaf, indices) of all leaves that hold a fingerprint within ``reach`` of a visitor, by triangle bounds."""

    def go(node, at):
        if not len(at):
            return
        if node.leaf >= 0:
            yield node.leaf, at
            return
        d = distance(fps[at], node.vantage, mask)
        yield from go(node.inner, at[d <= node.radius + reach])
        yield from go(node.outer, at[d > node.radius - reach])

    yield from go(tree, np.arange(len(fps)))


def _stays(forest, fps):
    """Leaf, indices and whether home, for each leaf; a visit below the own leaf is left to the other of the pair."""
    for (mask, reach), tree in zip(BLOCKS, forest):
        own = homes(tree, fps, mask)
        for leaf, at in visits(tree, fps, mask, reach):
            at = at[own[at] <= leaf]
            yield leaf, at, own[at] == leaf


def _together(batches):
    """Fingerprints of a task's batches in arrays of about TOGETHER, so that a leaf gets many at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column("fp").to_numpy().view(np.uint64))
        n += len(held[-1])
        if n >= TOGETHER:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _counted(forest):
    def rows(batches):
        counts: dict[int, list[int]] = {}
        for fps in _together(batches):
            for leaf, at, home in _stays(forest, fps):
                c = counts.setdefault(leaf, [0, 0])
                c[0] += int(home.sum())
                c[1] += len(at)
        keys = sorted(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())],
            names=["leaf", "n_home", "n_all"],
        )

    return rows


def _dealt(forest, tiles):
    """Rows of tiles: a leaf is cut into home parts times visitor parts, so that no tile outgrows its bounds."""

    def rows(batches):
        for fps in _together(batches):
            mix = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for leaf, at, home in _stays(forest, fps):
                base, nh, nv = tiles[leaf]
                if nh == 0 or not len(at):
                    continue
                h, own = at[home], mix[at[home]] % np.uint64(nh)
                parts = [(base + own.astype(np.int64) * nv + j, h, True) for j in range(nv)]
                turn = (mix[at] // np.uint64(nh) % np.uint64(nv)).astype(np.int64)
                parts += [(base + i * nv + turn, at, False) for i in range(nh)]
                for tile, who, is_home in parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tile.astype(np.int64)), pa.array(fps[who].view(np.int64)), pa.array(np.full(len(who), is_home))], names=["tile", "fp", "home"]
                    )

    return rows


def _joined(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after uniting the classes of u[i] and v[i]."""
    while True:
        a, b = labels[u], labels[v]
        differ = a != b
        if not differ.any():
            return labels
        a, b, u, v = a[differ], b[differ], u[differ], v[differ]
        to = np.arange(len(labels))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        labels = to[labels]


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning edges of the links inside a tile: each linked fingerprint with the first of its class."""
    fps = pdf["fp"].to_numpy().view(np.uint64)
    is_home = pdf["home"].to_numpy()
    home, every = np.unique(fps[is_home]), np.unique(fps)
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not len(home) or len(every) < 2:
        return none
    visitor = np.unique(fps[~is_home])
    v0 = int(home[0])
    ring = distance(home, v0)
    order = np.argsort(ring, kind="stable")
    home, ring = home[order], ring[order]
    place_h, place_v = np.searchsorted(every, home), np.searchsorted(every, visitor)
    labels = np.arange(len(every))
    away = distance(visitor, v0)
    for d in np.unique(away):
        low, high = np.searchsorted(ring, d - DISTANCE), np.searchsorted(ring, d + DISTANCE, side="right")
        who = np.flatnonzero(away == d)
        for at in range(0, len(who), 256):
            some = who[at : at + 256]
            near = np.bitwise_count(visitor[some][:, None] ^ home[low:high][None, :]) <= DISTANCE
            i, j = np.nonzero(near)
            u, v = place_v[some[i]], place_h[low + j]
            apart = u != v
            if apart.any():
                labels = _joined(labels, u[apart], v[apart])
    linked = np.flatnonzero(labels != np.arange(len(every)))
    if not len(linked):
        return none
    return pd.DataFrame({"a": every[linked].view(np.int64), "b": every[labels[linked]].view(np.int64)})


def _sampled(distinct: DataFrame, total: int) -> np.ndarray:
    """About PER_LEAF fingerprints for each leaf to come, MOST_SAMPLE at most, chosen by hash; in mixed order."""
    wanted = min(MOST_SAMPLE, max(8192, 2 * PER_LEAF * total // LEAF))
    unit = F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 30))
    some = distinct.filter(unit < int(min(1.0, wanted / max(1, total)) * (1 << 30))).select("fp").toArrow()
    fps = np.unique(some.column("fp").to_numpy().view(np.uint64))
    return np.random.default_rng(7).permutation(fps)


def near_links(distinct: DataFrame) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of ``fp`` within DISTANCE bits.

    ``distinct``: one row for each fingerprint. To the driver come at most MOST_SAMPLE fingerprints for the trees, whose
    depth follows the number of rows, and two counts for each leaf (3 * MOST_SAMPLE / PER_LEAF leaves at most);
    everything else stays on the executors.
    """
    total = distinct.count()
    sample = _sampled(distinct, total)
    numbers = iter(range(1 << 30))
    forest = [build_tree(sample, mask, total, numbers) for mask, _ in BLOCKS]
    counts = distinct.select("fp").mapInArrow(_counted(forest), "leaf int, n_home bigint, n_all bigint")
    tiles, base = {}, 0
    for r in sorted(counts.groupBy("leaf").agg(F.sum("n_home").alias("h"), F.sum("n_all").alias("a")).collect()):
        nh, nv = -(-r.h // TILE_HOMES), -(-r.a // TILE_VISITORS)
        tiles[r.leaf] = (base, nh, nv)
        base += nh * nv
    dealt = distinct.select("fp").mapInArrow(_dealt(forest, tiles), "tile bigint, fp bigint, home boolean")
    return dealt.groupBy("tile").applyInPandas(_links, "a bigint, b bigint")


def _rooted(distinct: DataFrame) -> DataFrame:
    """``distinct`` plus root, the fingerprint that names its component."""
    roots = connected_components(near_links(distinct), "a", "b")
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for each row; component_id is the smallest id that links reach, itself included.

    Copies share a fingerprint and are one node, so a third of all rows being copies costs one comparison. Null ids
    take part but are never the smallest (null if a component has no other); repeated rows give repeated results; an
    empty table gives none; long texts are read whole. Other columns do not matter. Ids are integers, or strings of
    them. Links are joined in rounds, whose number grows with the logarithm of a component. Fingerprints and components,
    read lazily by the result, stay in the shared folder (see clear_shared).
    """
    tables = Scratch(docs.sparkSession, "simhash")
    own = tables.written(fingerprints(docs, id_col, text_col), "fingerprints")
    named = _rooted(tables.written(own.groupBy("fp").agg(F.min("_id").alias("least")), "distinct-fps"))
    named = tables.written(named, "rooted-fps")
    least = tables.written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least-ids")
    found = tables.written(named.join(least, "root").select("fp", "component_id"), "components")
    tables.free("distinct-fps", "rooted-fps", "least-ids")
    return own.join(found, "fp").select(F.col("_id").alias("doc_id"), "fp", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _hash`` of one row of each component: the smallest id (null after all others), then the smallest hash.

    Components are told apart by their root fingerprint, so different texts with a null or repeated id each count.
    """
    tables = Scratch(docs.sparkSession, "survivors")
    own = fingerprints(docs, id_col, text_col, hashed=True)
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_hash"))
    distinct = tables.written(own.groupBy("fp").agg(first.alias("least")), "distinct-fps")
    found = _rooted(distinct).groupBy("root").agg(F.min("least").alias("least")).select("least._id", "least._hash")
    found = tables.written(found, "survivors")
    tables.free("distinct-fps")
    return found


def query(spark, sf_dir):
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": query}
ORACLES: dict[str, str] = {}
