"""Benchmark passages in documents, by one Aho-Corasick automaton over normalised word sequences.

A text is lower-cased in A-Z and read as words of a-z, 0-9 and non-ASCII characters. A window is 13 consecutive words
of a benchmark item (all words of a shorter one). The automaton holds every window of every item; each document is
scanned once, and word positions map back to character offsets of the original text.
"""

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.arrow_texts import packed, released, texts_of, unpacked
from logloom.llm.suffix_dedup import merged
from logloom.plans import Scratch
from logloom.sources import load

WINDOW = 13
#: Words of benchmark text in one automaton, about: it takes some 0.7 KB a word. A larger benchmark is scanned for in
#: several passes.
BLOCK_WORDS = 400_000
#: Windows of an item that stay together; longer items are cut, so that no item makes a block larger.
PIECE_WINDOWS = 20_000

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RANGE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split()


def windows(item: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    if not item:
        return set()
    return {tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))}


class Machine:
    """The automaton over word numbers, the numbers of the words that occur in items (from 1; 0 is any other), and for
    each window its length and the items that have it, as places in ``ids``."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW):
        self.ids = [i for i, _ in items]
        self.numbers: dict[bytes, int] = {}
        self.lengths: list[int] = []
        owner, window = [], []
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for place, (_, text) in enumerate(items):
            own = words(text)
            for w in own:
                self.numbers.setdefault(w, len(self.numbers) + 1)
            for w in windows(own, size):
                key = tuple(self.numbers[x] for x in w)
                number = automaton.get(key, -1)
                if number < 0:
                    number = len(self.lengths)
                    self.lengths.append(len(key))
                    automaton.add_word(key, number)
                owner.append(place)
                window.append(number)
        automaton.make_automaton()
        order = np.argsort(window, kind="stable")
        self.owner = np.array(owner, np.int32)[order]
        self.first = np.searchsorted(np.array(window, np.int64)[order], np.arange(len(self.lengths) + 1))
        self.automaton = automaton

    def scan(self, own: list[bytes]) -> tuple[set[str], list[tuple[int, int]]]:
        """Ids of items with an occurring window, and the word ranges of all occurrences."""
        if not self.lengths or not own:
            return set(), []
        seen, ranges = set(), []
        for end, number in self.automaton.iter(tuple([self.numbers.get(w, 0) for w in own])):
            seen.add(number)
            ranges.append((end - self.lengths[number] + 1, end + 1))
        who = {self.ids[p] for n in seen for p in self.owner[self.first[n] : self.first[n + 1]].tolist()}
        return who - {None}, ranges


_machines: dict[tuple, Machine] = {}


def _machine(items: list[tuple[str | None, str]]) -> Machine:
    """Built once a worker, not once a task; a worker holds one at a time."""
    key = tuple(items)
    if key not in _machines:
        _machines.clear()
        _machines[key] = Machine(items)
    return _machines[key]


def _union(ranges):
    return merged(np.array([r[0] for r in ranges]), np.array([r[1] for r in ranges])) if ranges else []


def _pass(items, text_col):
    def rows(batches):
        machine = _machine(items)
        for batch in batches:
            counts, found, ranges, spans = [], [], [], []
            for t, old_items, old_ranges in zip(texts_of(batch, text_col), batch.column("items"), batch.column("hits")):
                t = t.as_py()
                own = words(t)
                who, where = machine.scan(own)
                counts.append(len(own))
                found.append(sorted(who | set(old_items.as_py() or ())))
                hits = _union(where + [(x["start"], x["stop"]) for x in old_ranges.as_py() or ()])
                at = [m.span() for m in _WORD.finditer(t)] if hits else []
                ranges.append([{"start": a, "stop": b} for a, b in hits])
                spans.append([{"start": at[a][0], "stop": at[b - 1][1]} for a, b in hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(ranges, _RANGE), pa.array(spans, _RANGE)],
                names=["_row", "n_words", "items", "hits", "hit_spans"],
            )

    return rows


def _cut(size: int):
    """Pieces of items, normalised: each window of an item begins in one piece of ``size`` windows, and is whole in it."""

    def rows(batches):
        for batch in batches:
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t")):
                own = words(t.as_py())
                for a in range(0, len(own), size):
                    piece = own[a : a + size + WINDOW - 1]
                    if a == 0 or len(piece) >= WINDOW:
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.string()), pa.array([b" ".join(piece).decode()]), pa.array([len(piece)], pa.int64())], names=["i", "t", "n"])

    return rows


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, tables: Scratch | None = None):
    """The items, long ones in pieces, in blocks of about BLOCK_WORDS words; only one block's texts are in the driver at a time."""
    items = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
    pieces = (tables or Scratch(benchmark.sparkSession, "benchmark")).written(items.mapInArrow(_cut(PIECE_WINDOWS), "i string, t string, n bigint"), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n = -(-total // BLOCK_WORDS) or 1
    for b in range(n):
        part = pieces if n == 1 else pieces.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield sorted(((r.i, r.t) for r in part.collect()), key=lambda x: (x[0] or "", x[1]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` plus n_words, items (ids, as text, of benchmark items with an occurring window, ascending), hits (word
    ranges), hit_spans (the same as character offsets of the text) and n_hit, the words inside any occurrence.

    Null and wordless texts have no words and no hits; long texts are scanned whole. Items without words are never found;
    those with a null id count in the hits and are not listed; an empty benchmark finds nothing. Repeated items change
    nothing, repeated rows give repeated rows. An item of any length is scanned for in pieces that share no window. Input columns of the names above give way. Ids may be of any type.
    """
    added = ["n_words", "items", "hits", "hit_spans", "n_hit"]
    rows, names, _ = packed(docs, added, text_col)
    now = rows.select(
        "_row", F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<string>").alias("items"), *[F.array().cast("array<struct<start:bigint,stop:bigint>>").alias(c) for c in ("hits", "hit_spans")],
    )
    schema, tables = now.schema, Scratch(docs.sparkSession, "decontaminate")
    for i, items in enumerate(_blocks(benchmark, item_id, item_text, tables)):
        if i:
            now = tables.written(now, f"pass-{i}")
            tables.free(f"pass-{i - 1}")
        now = now.mapInArrow(released(_pass(items, text_col)), schema)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["stop"] - x["start"])
    return unpacked(now.withColumn("n_hit", n_hit), names, added)


def contaminated(n_hit="n_hit", n_words="n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def query(spark, sf_dir):
    found = decontaminate(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


QUERIES = {"op5_decontaminate": query}
ORACLES: dict[str, str] = {}
