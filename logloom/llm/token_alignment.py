"""Tokens of two tokenizers aligned by the bytes where both end, with corpus-wide counts of token pairs.

Texts pass in slices as Arrow arrays. Both tokenizers give a list of ids for each document; lists are flattened, token
lengths summed up to end offsets within the document (cumulative sums, less the sum at its start, by parent index), and a
hash join on (document, end) finds the ends that both share: the links, which also cut the tokens into groups. Each slice
counts its own token pairs by Table.group_by; Spark merges these partial counts, and sends each slice the corpus counts
of the pairs it has, so a pair that is everywhere is one row a slice.

Texts are cut into chunks where both tokenizers have a boundary. A worker remembers the tokens of chunks in bounded number,
when there are too many those met most often; new chunks of a slice are encoded once.
"""

import hashlib
import re
from collections.abc import Callable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import bpe
from logloom.llm.arrow_texts import bound_batches, released
from logloom.plans import Scratch
from logloom.plans.shared import LONG_ROWS, groups_sorted
from logloom.sources import load

#: Bytes of text that are aligned together, and whose new chunks are encoded together; a longer text is a slice of its own.
SLICE_BYTES, WORD_BYTES = 300_000, 1_000_000
#: Chunks of text, and bytes of them, that a worker remembers the tokens of.
REMEMBERED, REMEMBERED_BYTES = 120_000, 8_000_000
#: Bytes of a word that is merged in rounds with others of this size or less.
SHORT_WORD = 64
#: Characters of chunks that sentencepiece gets as they are; longer ones are cut, as its memory follows what it gets at once.
WHOLE_CHUNK = 1000
#: Cuts a text that begins with a space where both tokenizers have a boundary: before a run of spaces. Where white space
#: comes before the run, the byte-level pattern takes both together but for the last space, so only a single space that
#: something else follows is a cut.
_CHUNKS = re.compile(r" +[^ ]*(?:(?<=\s)(?! \S) +[^ ]*)*").findall
ADDED = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"}


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + sizes[i] - 1 of all i, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Tokenizer:
    """``encode`` gives the ids of many words in a row and the number of each word's, ``token_bytes`` are the bytes of each
    id, ``split`` cuts a chunk into words whose tokens don't depend on what is around them. Chunks of up to ``whole``
    characters can be passed as words."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], token_bytes: list[bytes], split: Callable[[str], list[str]], whole: int = 0):
        self.encode, self.bytes, self.split, self.whole = encode, token_bytes, split, whole
        size = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        self.sizes, self._size, self._start, self._flat = pa.array(size), size, np.cumsum(size) - size, np.frombuffer(b"".join(token_bytes), np.uint8)

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words are encoded once."""
        if max(map(len, chunks)) <= self.whole:
            return self.encode(chunks)
        found = list(map(self.split, chunks))
        until = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        words = list(chain.from_iterable(found))
        distinct = list(dict.fromkeys(words))
        number = np.fromiter(map(dict(zip(distinct, range(len(distinct)))).__getitem__, words), np.int64, len(words))
        ids, size = self.encode(distinct)
        start, size = (np.cumsum(size) - size)[number], size[number]
        return ids[_spread(start, size)], np.diff(np.concatenate(([0], np.cumsum(size)))[until], prepend=0)

    def tokens(self, chunks: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, the number of each one's, and which chunks are not the bytes of their tokens."""
        ids, size = self._encoded(chunks)
        bad = np.zeros(len(chunks), bool)
        if not np.array_equal(self._flat[_spread(self._start[ids], self._size[ids])], np.frombuffer(b"".join(raw), np.uint8)):
            until = np.cumsum(size).tolist()
            bad[:] = [b"".join(map(self.bytes.__getitem__, ids[z - n : z].tolist())) != c for c, n, z in zip(raw, size.tolist(), until)]
        return ids, size, bad


class _Tokens:
    """Token ids of numbered chunks: where each one's begin, and how many they are."""

    def __init__(self):
        self.ids, self.start, self.size, self.bad = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, ids: np.ndarray, size: np.ndarray, bad: np.ndarray):
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.size, self.ids, self.bad = np.append(self.size, size), np.append(self.ids, ids), np.append(self.bad, bad)

    def of(self, chunks: np.ndarray) -> np.ndarray:
        return self.ids[_spread(self.start[chunks], self.size[chunks])]

    def keep(self, chunks: np.ndarray):
        ids, size, bad = self.of(chunks), self.size[chunks], self.bad[chunks]
        self.__init__()
        self.add(ids, size, bad)


class ChunkMemory:
    """Token ids of texts by several tokenizers, chunk by chunk; all of them have a boundary between chunks."""

    def __init__(self, *tokenizers: Tokenizer):
        self.tokenizers, self.known = tokenizers, [_Tokens() for _ in tokenizers]
        self.numbers: dict[str, int] = {}
        self.held = self.uses = np.zeros(0, np.int64)

    def _forget(self):
        """Half of what may be remembered stays, the chunks met most often; those met once go."""
        order = np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2]
        kept = np.sort(order[(self.uses[order] > 1) & (np.cumsum(self.held[order]) <= REMEMBERED_BYTES // 2)])
        chunks = list(self.numbers)
        self.numbers = {chunks[k]: n for n, k in enumerate(kept.tolist())}
        self.held, self.uses = self.held[kept], self.uses[kept] // 2
        for t in self.known:
            t.keep(kept)

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts in a row, and how many each text has; valid until the next call."""
        if len(self.numbers) > REMEMBERED or self.held.sum() > REMEMBERED_BYTES:
            self._forget()
        found = list(map(_CHUNKS, texts))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        chunks = list(chain.from_iterable(found))
        new = [c for c in dict.fromkeys(chunks) if c not in self.numbers]
        if new:
            raw = [c.encode() for c in new]
            for tokenizer, known in zip(self.tokenizers, self.known):
                known.add(*tokenizer.tokens(new, raw))
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
            self.held, self.uses = np.append(self.held, np.fromiter(map(len, raw), np.int64, len(raw))), np.append(self.uses, np.zeros(len(raw), np.int64))
        numbers = np.fromiter(map(self.numbers.__getitem__, chunks), np.int32, len(chunks))
        self.uses = self.uses + np.bincount(numbers, minlength=len(self.uses))
        return numbers, counts

    def tokens(self, chunks: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each tokenizer the ids of texts given by chunk numbers, in a row, the number of each text's, and which texts
        are bad: have a chunk that is not the bytes of its tokens."""
        until, out = np.concatenate(([0], np.cumsum(counts))), []
        for t in self.known:
            tokens, bad = np.concatenate(([0], np.cumsum(t.size[chunks])))[until], np.concatenate(([0], np.cumsum(t.bad[chunks])))[until]
            out.append((t.of(chunks), np.diff(tokens), np.diff(bad) > 0))
        return out


def byte_level(spec: str) -> Tokenizer:
    """A byte-level BPE from the text of its JSON file; strings of special tokens are ordinary text."""
    vocab = bpe.Vocabulary(spec)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        long = np.fromiter(map(len, raw), np.int64, len(raw)) > SHORT_WORD
        if not long.any():
            return bpe.merge_short_words(vocab, raw)
        (short_ids, short_size), (long_ids, long_size) = bpe.merge_short_words(vocab, list(compress(raw, ~long))), bpe.merge_words(vocab, list(compress(raw, long)))
        ids, size, start = np.concatenate([short_ids, long_ids]), np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        size[~long], size[long] = short_size, long_size
        start[~long], start[long] = np.cumsum(short_size) - short_size, len(short_ids) + np.cumsum(long_size) - long_size
        return ids[_spread(start, size)], size

    return Tokenizer(encode, vocab.tokens, regex.compile(bpe.PATTERN).findall)


def pieces(model: bytes) -> Tokenizer:
    """A sentencepiece model from the bytes of its file. It puts a space before each text itself, and no piece has a space
    behind another character, so each run of spaces with what follows it can be a word of its own."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    space = [sp.piece_to_id("▁")]

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [ids or space for ids in sp.encode([w[1:] for w in words], num_threads=1)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    raw = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
    return Tokenizer(encode, raw, re.compile(" +[^ ]*").findall, WHOLE_CHUNK)


def _ends(ids: np.ndarray, counts: np.ndarray, sizes: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flat ids, the document of each, and where it ends in the bytes of its document."""
    offsets = np.concatenate(([0], np.cumsum(counts)))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    until = pc.cumulative_sum(sizes.take(flat))
    start = pa.array(np.concatenate(([0], until.to_numpy()))[offsets[:-1]])
    return flat, doc, pc.subtract(until, start.take(doc))


def _at(doc: pa.Array, end: pa.Array) -> np.ndarray:
    """Document and end as one number."""
    return (doc.to_numpy().astype(np.int64) << 32) + end.to_numpy()


def _joined(values: pa.Array, offsets: np.ndarray, between: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), between)


class Aligner:
    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.a, self.b, self.memory = a, b, ChunkMemory(a, b)
        self.decimals = pa.array(list(map(str, range(max(len(a.bytes), len(b.bytes))))), pa.string())

    def slices(self, texts: list[str | None]):
        """Number of texts and ``aligned`` of each slice of the texts, of about SLICE_BYTES."""
        spaced = [" " + t if t else "" for t in texts]
        chunks, counts = self.memory.number(spaced)
        at = np.concatenate(([0], np.cumsum(counts)))
        sizes = np.cumsum([len(t) for t in spaced])
        low = 0
        while low < len(texts):
            high = min(len(texts), max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + SLICE_BYTES))))
            yield high - low, self.aligned(chunks[at[low] : at[high]], counts[low:high])
            low = high

    def aligned(self, chunks: np.ndarray, counts: np.ndarray) -> dict:
        """For each text, given by its chunks in the memory, n_a, n_b, n_links and groups_sha256; for each link its pair, as
        a place in the lists pair_a, pair_b and pair_n (how many links of the slice have it)."""
        (a, na, bad_a), (b, nb, bad_b) = self.memory.tokens(chunks, counts)
        bad = bad_a | bad_b
        if bad.any():
            a, b = a[~np.repeat(bad, na)], b[~np.repeat(bad, nb)]
            na, nb = np.where(bad, 0, na), np.where(bad, 0, nb)
        fa, da, ea = _ends(a, na, self.a.sizes)
        fb, db, eb = _ends(b, nb, self.b.sizes)
        left = pa.table({"at": _at(da, ea), "i": pa.array(np.arange(len(fa), dtype=np.int32))})
        right = pa.table({"at": _at(db, eb), "j": pa.array(np.arange(len(fb), dtype=np.int32))})
        links = left.join(right, "at", join_type="inner", use_threads=False).sort_by("i").combine_chunks()
        i, j = (links.column(c).to_numpy() for c in ("i", "j"))
        a, b, doc = a[i], b[j], da.to_numpy()[i]
        n_links = np.bincount(doc, minlength=len(na)).astype(np.int64)
        groups = pc.binary_join_element_wise(
            _joined(self.decimals.take(fa), np.concatenate(([0], i + 1)), ","), _joined(self.decimals.take(fb), np.concatenate(([0], j + 1)), ","), "|"
        )
        told = _joined(groups, np.concatenate(([0], np.cumsum(n_links))), ";")
        pair = pa.array((a.astype(np.int64) << 32) + b).dictionary_encode()
        n = pa.table({"pair": pair.indices}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        keys = pair.dictionary.to_numpy()
        return {
            "n_a": na, "n_b": nb, "n_links": n_links, "groups_sha256": [hashlib.sha256(s.as_buffer()).hexdigest() if k else "" for s, k in zip(told, n_links)],
            "pair": pair.indices, "pair_a": keys >> 32, "pair_b": keys & 0xFFFFFFFF, "pair_n": n.column("count_all").to_numpy(),
        }


_aligners: dict[tuple[str, bytes], Aligner] = {}


def _aligner(spec: str, model: bytes) -> Aligner:
    """Built once a worker."""
    if (spec, model) not in _aligners:
        _aligners.clear()
        _aligners[spec, model] = Aligner(byte_level(spec), pieces(model))
    return _aligners[spec, model]


_LISTS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pair_a": pa.int32(), "pair_b": pa.int32(), "pair_n": pa.int32()}


def _one(values: pa.Array) -> pa.Array:
    """A list array whose only value is all of ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


_SLICE = "slice bigint, {row}, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, groups_sha256 array<string>, pair_a array<int>, pair_b array<int>, pair_n array<int>, pair binary"
_codec = pa.Codec("zstd", compression_level=1)


def _places(pair: pa.Array) -> bytes:
    """Places of pairs, one for each link, byte by byte and compressed; ``_places_of`` gives them back."""
    return _codec.compress(pair.to_numpy().astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _places_of(packed: bytes, n: int) -> pa.Array:
    return pa.array(np.frombuffer(_codec.decompress(packed, 4 * n, asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel())


def _slices(spec: str, model: bytes):
    def rows(batches):
        aligner, number = _aligner(spec, model), TaskContext.get().partitionId() << 32
        for batch in batches:
            text = batch.column("_text")
            sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64).cumsum()
            low = 0
            while low < len(text):
                high = min(len(text), max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + WORD_BYTES))))
                for n, got in aligner.slices(text.slice(low, high - low).to_pylist()):
                    kept = batch.column("_row").slice(low, n)
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), _one(kept), *[_one(pa.array(got[c], k)) for c, k in _LISTS.items()], pa.array([_places(got["pair"])], pa.binary())], names=["slice", "rows", *_LISTS, "pair"])
                    number, low = number + 1, low + n
            pa.default_memory_pool().release_unused()

    return rows


def _told(batches):
    """A row for each document of a slice, from the places and the corpus counts of its links' pairs."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c).slice(k, 1).flatten() for c in batch.schema.names if c != "pair"}
            n = row["n_links"].to_numpy()
            pair = _places_of(batch.column("pair")[k].as_py(), int(n.sum()))
            links = pa.table({"doc": pa.array(np.repeat(np.arange(len(n)), n)), "count": row["count"].take(pair), "best": row["best"].take(pair).cast(pa.int64())})
            sums = links.group_by("doc", use_threads=False).aggregate([("count", "sum"), ("best", "sum")])
            count, best = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            at = sums.column("doc").to_numpy()
            count[at], best[at] = sums.column("count_sum").to_numpy(), sums.column("best_sum").to_numpy()
            yield pa.RecordBatch.from_arrays([row["rows"], row["n_a"], row["n_b"], row["n_links"], row["n_links"], pa.array(best), pa.array(count), row["groups_sha256"]], names=["_row", *ADDED])


def align(docs: DataFrame, byte_bpe_json: str, piece_model: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair has the highest
    count of all pairs of its B token), count_sum (of the links' corpus-wide pair counts) and groups_sha256.

    Both tokenizers read a space and the text. Texts that are null, empty, or not the bytes of their tokens (those with
    U+2581) have no tokens: zeros and an empty string. Input columns of the names above give way. The files are read
    once on the driver (2 MB, whatever the corpus) and sent with the tasks. Tokens never have no bytes, so two tokens
    end at a byte at most and links are as many as groups. Each text is encoded once; what is kept of it between
    the passes are the places of its links' pairs in its slice, 300 KB of text or a single longer one. Repeated rows give
    repeated rows.
    """
    spec = open(byte_bpe_json, encoding="utf-8").read()
    model = open(piece_model, "rb").read()
    names = [c for c in docs.columns if c != text_col and c not in ADDED]
    bound_batches(docs.sparkSession)
    tables = Scratch(docs.sparkSession, "align")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    found = tables.written(rows.mapInArrow(released(_slices(spec, model)), _SLICE.format(row=f"rows array<{kind}>")), "slices", LONG_ROWS)
    pairs = found.select("slice", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("at", "p")).select("slice", "at", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))
    counts = tables.written(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    best = counts.groupBy("b").agg(F.max("count").alias("_best"))
    counts = tables.written(counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("_best")).alias("best")), "counts")
    asked = pairs.select("slice", "at", "a", "b").join(counts, ["a", "b"]).groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("at", "count", "best"))).alias("c"))
    with groups_sorted(docs.sparkSession):
        asked = tables.written(asked.select("slice", F.col("c.count").alias("count"), F.col("c.best").alias("best")), "asked", LONG_ROWS)
    both = found.select("slice", "rows", "n_a", "n_b", "n_links", "groups_sha256", "pair").join(asked, "slice", "left")
    both = both.select("rows", "n_a", "n_b", "n_links", "groups_sha256", "pair", F.coalesce("count", F.array().cast("array<bigint>")).alias("count"), F.coalesce("best", F.array().cast("array<boolean>")).alias("best"))
    out = both.mapInArrow(released(_told), f"_row {kind}, " + ", ".join(f"{c} {k}" for c, k in ADDED.items()))
    return out.select(*[F.col(f"_row.`{c}`") for c in names], *ADDED)


def query(spark, sf_dir):
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_token_alignment": query}
ORACLES: dict[str, str] = {}
