"""Byte-level BPE encoding and decoding with a given vocabulary file.

Method: a pair occurrence index. The distinct words of a slice of a partition lie in one array of symbols; each pair
that has a rank is mapped to all its positions. Active ranks are applied in ascending order, each to all its positions
at once, and only the lists of the pairs to the left and right of a merge are updated. A merge makes pairs of higher
rank only, so one ascending sweep gives what merging word by word, lowest rank first, gives.

A departure: the index is not over all texts of a partition but over the distinct words of SLICE_BYTES of them, and the
tokens of words met before are remembered, in bounded number. Memory then does not follow the partition, and merges never
cross words, so the tokens are the same.
"""

import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.arrow_texts import packed, released, texts_of, unpacked
from logloom.sources import load

#: Fixed value: the public pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text whose new words are merged together, and words that a worker remembers.
SLICE_BYTES = 6_000_000
#: Bytes of text whose rows go out together.
OUT_BYTES = 1_000_000
REMEMBERED = 120_000
#: Short words that are merged together.
BLOCK_WORDS = 10_000
_NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a tokenizer file: merges by pair, token bytes, and special strings."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, alphabet = spec["model"], byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        vocab: dict[str, int] = model["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[alphabet[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.tokens = [b""] * self.size
        for token, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)


def merge_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in a row, and the number of each word's."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    symbol = vocab.first[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
    n = len(symbol)
    end = np.cumsum(size)
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    full = size > 0
    after[end[full] - 1] = -1
    before[(end - size)[full]] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, _NONE, np.int32)
    has = np.flatnonzero(after >= 0)
    rank[has] = vocab.ranks(symbol[has], symbol[has + 1])

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def listed(at: np.ndarray):
        r = rank[at]
        at, r = at[r != _NONE], r[r != _NONE]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        opens = np.flatnonzero(np.append(True, r[1:] != r[:-1])).tolist()
        for k, a, b in zip(r[opens].tolist(), opens, [*opens[1:], len(at)]):
            if k in index:
                index[k].append(at[a:b])
            else:
                index[k] = [at[a:b]]
                heapq.heappush(active, k)

    listed(has)
    while active:
        k = heapq.heappop(active)
        at = index.pop(k)
        at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
        at = at[rank[at] == k]
        if not len(at):
            continue
        if vocab.left[k] == vocab.right[k] and len(at) > 1:
            at = _leftmost(at, after)
        gone = after[at]
        beyond = after[gone]
        symbol[at] = vocab.made[k]
        alive[gone] = False
        rank[gone] = _NONE
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        rank[at] = _NONE
        p, q = at[inner], beyond[inner]
        rank[p] = vocab.ranks(symbol[p], symbol[q])
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        rank[ahead] = vocab.ranks(symbol[ahead], symbol[after[ahead]])
        listed(np.concatenate([p, ahead]) if len(ahead) else p)
    stops = np.concatenate(([0], np.cumsum(alive)))[end]
    return symbol[alive], np.diff(stops, prepend=0)


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping positions of a pair of equal symbols, those that merging from the left takes."""
    taken, blocked = [], -1
    for p, q in zip(at.tolist(), after[at].tolist()):
        if p != blocked:
            taken.append(p)
            blocked = q
    return np.array(taken, at.dtype)


def merge_short_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``merge_words``. Each round merges one pair of every word, of those of its lowest rank the leftmost; rounds are as
    many as the merges of one word at most and each passes over all words of a block, so words should be short."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    if len(words) > BLOCK_WORDS:
        ids, sizes = zip(*(merge_short_words(vocab, words[i : i + BLOCK_WORDS]) for i in range(0, len(words), BLOCK_WORDS)))
        return np.concatenate(ids), np.concatenate(sizes)
    size = np.fromiter(map(len, words), np.int64, len(words))
    symbol = vocab.first[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    end = np.cumsum(size)
    full = size > 0
    starts = (end - size)[full]
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    after[end[full] - 1] = -1
    before[starts] = -1
    alive = np.ones(n, bool)
    none = np.int64(_NONE) << 32
    order = np.full(n, none)  # of pairs within their word: rank, then place

    def ranked(p: np.ndarray, q: np.ndarray):
        order[p] = (vocab.ranks(symbol[p], symbol[q]).astype(np.int64) << 32) + p

    has = np.flatnonzero(after >= 0)
    ranked(has, has + 1)
    while len(starts):
        low = np.minimum.reduceat(order, starts)
        low = low[low < none]
        if not len(low):
            break
        at = low & 0xFFFFFFFF
        gone = after[at]
        beyond = after[gone]
        symbol[at] = vocab.made[low >> 32]
        alive[gone] = False
        order[at] = order[gone] = none
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        ranked(at[inner], beyond[inner])
        ahead = before[at]
        ranked(ahead[ahead >= 0], at[ahead >= 0])
    stops = np.concatenate(([0], np.cumsum(alive)))[end]
    return symbol[alive], np.diff(stops, prepend=0)


def decode(vocab: Vocabulary, ids) -> str:
    return b"".join(map(vocab.tokens.__getitem__, ids)).decode("utf-8", errors="replace")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + sizes[i] - 1 of all i, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Numbers(dict):
    """Numbers words as they come, and lists the new ones."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word):
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Encoder:
    """Remembers the tokens of words as one array; texts pass as arrays of word numbers."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.pattern = vocab, regex.compile(PATTERN)
        size = np.fromiter(map(len, vocab.tokens), np.int64, vocab.size)
        self.token_bytes = np.frombuffer(b"".join(vocab.tokens), np.uint8)
        self.token_size, self.token_start = size, np.cumsum(size) - size
        self._forget()

    def _forget(self):
        self.numbers = _Numbers()
        self.ids = np.zeros(0, np.int32)
        self.start = self.size = np.zeros(0, np.int64)

    def pieces(self, text: str) -> list:
        """Words of a text; a special token is a tuple of its id."""
        split, special = self.vocab.split, self.vocab.special
        parts = [text] if split is None else split.split(text)
        if len(parts) == 1:
            return self.pattern.findall(text)
        return [x for p in parts for x in ([(special[p],)] if p in special else self.pattern.findall(p))]

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and where each text ends. New words are merged, all at once."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        found = [np.array(list(map(self.numbers.__getitem__, self.pieces(t))), np.int32) for t in texts]
        new, self.numbers.new = self.numbers.new, []
        if new:
            special = [i for i, w in enumerate(new) if isinstance(w, tuple)]
            ids, size = merge_words(self.vocab, [w.encode() if isinstance(w, str) else b"" for w in new])
            if special:
                at = np.cumsum(size)[special]
                ids = np.insert(ids, at, [new[i][0] for i in special])
                size[special] = 1
            self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.append(self.ids, ids)
        return (np.concatenate(found) if found else np.zeros(0, np.int32)), np.cumsum([len(f) for f in found], dtype=np.int64)

    def tokens(self, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts given by word numbers, in a row, and where each text ends."""
        size = self.size[numbers]
        until = np.concatenate(([0], np.cumsum(size)))
        return self.ids[_spread(self.start[numbers], size)], until[ends]

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts that token ids stand for."""
        size = self.token_size[ids]
        raw = self.token_bytes[_spread(self.token_start[ids], size)]
        until = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], ends))]
        binary = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(until.astype(np.int64)), pa.py_buffer(raw)])
        try:
            return binary.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that end inside a character
            return pa.array([b.decode("utf-8", errors="replace") for b in binary.to_pylist()], pa.string())

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.tokens(*self.number(texts))
        return [x.tolist() for x in np.split(ids, ends[:-1])] if texts else []


_encoders: dict[int, Encoder] = {}


def _rows(spec: str, text_col: str):
    def rows(batches):
        key = hash(spec)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(Vocabulary(spec))
        encoder = _encoders[key]
        for batch in batches:
            column = texts_of(batch, text_col)
            sizes = np.asarray(pc.binary_length(column), np.int64).cumsum()

            def until(low: int, limit: int) -> int:
                return min(len(column), max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + limit))))

            low = 0
            while low < len(column):
                high = until(low, SLICE_BYTES)
                numbers, ends = encoder.number(column.slice(low, high - low).to_pylist())
                ends = np.concatenate(([0], ends))
                a = low
                while a < high:
                    b = min(high, until(a, OUT_BYTES))
                    base = ends[a - low]
                    ids, at = encoder.tokens(numbers[base : ends[b - low]], ends[a - low + 1 : b - low + 1] - base)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], at)).astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), lists, encoder.decoded(ids, at)], names=["_row", "ids", "decoded"])
                    a = b
                low = high

    return rows


def encode_decode(docs: DataFrame, tokenizer_json: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``ids`` (array of int) and ``decoded`` (the text that the ids decode to).

    ``tokenizer_json`` is the path of the vocabulary, read once on the driver (about 1.5 MB, whatever the corpus) and
    sent with the tasks. Null texts encode as empty. Strings of special tokens become those tokens. Input columns called
    ids or decoded give way. Words are merged once for each slice and remembered in bounded number.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = f.read()
    rows, names, row = packed(docs, ["ids", "decoded"], text_col)
    out = rows.mapInArrow(released(_rows(spec, text_col)), f"_row {row}, ids array<int>, decoded string")
    return unpacked(out, names, ["ids", "decoded"])


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir, tokenizer_json: str | None = None):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode_decode(docs, tokenizer_json or public_vocabulary())
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op6_bpe": query}
ORACLES: dict[str, str] = {}
