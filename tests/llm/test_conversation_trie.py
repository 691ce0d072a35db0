"""The trie against one that is built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from logloom.llm import conversation_trie as ct
from logloom.plans import Scratch

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + (-c) % 100
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def trie_by_hand(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    rows, leaves, saved = set(), {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = sum(saved[k] for k in kids[key]) + ((len(members[key]) - 1) * len(key[-1][1]) if key else 0)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest()
        rows.add((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(kids[key]), leaves[key], saved[key], sha))
    return rows


def found(spark, df):
    tables = Scratch(spark, "t")
    turns = tables.written(ct.numbered(df), "turns")
    got = ct.prefix_trie(*ct.with_shared_starts(turns, tables)).collect()
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    rows = [tuple(r[c] for c in names) for r in got]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversations(seed, n, texts, longest):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(0, 5 * n), n):
        for t in range(rnd.randint(1, longest)):
            turn = rnd.choice([t, t, t, t, 3, None])
            rows.append((c, turn, rnd.choice(["user", "user", "a", None]) if rnd.random() < 0.2 else "user", rnd.choice(texts)))
    return rows


@pytest.mark.parametrize(("seed", "texts", "longest"), [(1, ["a", "b"], 9), (2, ["a", "bb", "", None, "é\U0001f600", "x\ny"], 12), (3, ["same"], 20)])
def test_random_conversations(spark, seed, texts, longest):
    rows = conversations(seed, 90, texts, longest)
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", _b int").repartition(3)
    assert found(spark, df) == trie_by_hand(rebuilt_by_hand(rows))


def test_long_conversations_snapshots_and_copies(spark):
    """One conversation has most of all turns; others are starts of it, leave it at each depth, or are copies."""
    rnd = random.Random(5)
    base = [str(rnd.random()) for _ in range(1500)]
    rows = [(1, t, "user", x) for t, x in enumerate(base)]
    for c in range(2, 40):
        cut = rnd.choice([3, 17, 255, 256, 257, 511, 512, 600, 1499, 1500])
        rows += [(c, t, "user", x) for t, x in enumerate(base[:cut])] + ([(c, 5000, "user", str(c % 5))] if c % 3 else [])
    assert found(spark, spark.createDataFrame(rows, SCHEMA)) == trie_by_hand(rebuilt_by_hand(rows))


def test_nulls_and_empty_tables(spark):
    assert found(spark, spark.createDataFrame([], SCHEMA)) == set()
    rows = [(None, 1, "user", "x"), (3, None, None, None), (-120, 1, "user", "x"), (-100, 1, "user", "y")]
    got = found(spark, spark.createDataFrame(rows, SCHEMA))
    assert got == trie_by_hand(rebuilt_by_hand(rows)) and {r[3] for r in got if r[1] == 0} == {3}


def test_many_copies_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ct, "ID_SPAN", 7)
    rows = [(c, 1, "user", "x") for c in range(300)] + [(c, t, "user", "y") for c in range(300, 330) for t in range(2)]
    assert found(spark, spark.createDataFrame(rows, SCHEMA)) == trie_by_hand(rebuilt_by_hand(rows))


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a, 70)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", ct.two_fattest(F.col("a"), F.col("b"))).collect()
    for a, b, f in got:
        assert f == (max(range(a + 1, b + 1), key=lambda x: x & -x) if a < b else None)
