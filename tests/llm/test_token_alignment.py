"""Alignment against the libraries and plain counting."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logloom.llm import token_alignment as ta
from logloom.llm.bpe import byte_alphabet
from logloom.sources import load

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
BACK = {c: b for b, c in byte_alphabet().items()}


def a_bytes(i):
    return bytes(BACK[c] for c in A.id_to_token(i))


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def by_hand(texts):
    """For each text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha)."""
    found, counts = [], Counter()
    for t in texts:
        a, b = ([], []) if not t else (A.encode(" " + t, add_special_tokens=False).ids, B.encode(t))
        whole = (" " + t).encode() if t else b""
        if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        ends = [dict(), dict()]
        for k, (ids, raw) in enumerate(((a, a_bytes), (b, b_bytes))):
            at = 0
            for place, i in enumerate(ids):
                at += len(raw(i))
                ends[k][at] = place
        shared = sorted(ends[0].keys() & ends[1].keys())
        groups, i, j = [], 0, 0
        for e in shared:
            groups.append(",".join(map(str, a[i : ends[0][e] + 1])) + "|" + ",".join(map(str, b[j : ends[1][e] + 1])))
            i, j = ends[0][e] + 1, ends[1][e] + 1
        links = [(a[ends[0][e]], b[ends[1][e]]) for e in shared]
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return [
        (na, nb, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
        for na, nb, g, k in found
    ]


def run(df):
    out = ta.align(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    return {r.doc_id: tuple(r[c] for c in ta.ADDED) for r in out.collect()}


def hard_texts(seed, n):
    rnd = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "\t", "　", "▁", "<|endoftext|>", "<s>", "</s>", "<0x41>", "1234", "é", "é", "ﬁ", "漢字", "\U0001f600", "\x00", "'s", "don't", " ", "\r\n", "xyzzyqqq", "ÄÖ", ".", "--", "‍", "▁▁"]
    return [None, "", " ", "  ", "a ", " a", "<|endoftext|>", "▁", *["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(n)]]


@pytest.mark.parametrize("slice_bytes", [40, 1_000_000])
def test_equals_the_libraries(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(ta, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(ta, "REMEMBERED", 50)
    monkeypatch.setattr(ta, "WORD_BYTES", 4 * slice_bytes)
    texts = hard_texts(1, 400) + ["word " * 5000, "x" * 5000, "the the"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    got = run(spark.createDataFrame(rows, "doc_id bigint, text string, n_a string, extra int").repartition(5))
    want = by_hand(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, texts[i]


def test_documents(spark):
    rows = load(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in ta.ADDED) for r in ta.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, by_hand([r.text for r in rows]))}


def test_no_rows_repeats_and_nulls(spark):
    schema = "doc_id bigint, text string"
    assert run(spark.createDataFrame([], schema)) == {}
    out = ta.align(spark.createDataFrame([(1, "same text")] * 3 + [(None, None)], schema), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()
    assert sorted(r.n_a for r in out) == [0, 2, 2, 2] and {r.count_sum for r in out if r.doc_id} == {6} and {r.groups_sha256 for r in out if r.doc_id is None} == {""}


def test_long_rows_are_stored_in_small_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from logloom.plans import Scratch
    from logloom.plans.shared import LONG_ROWS

    tables = Scratch(spark, "long")
    tables.path = str(tmp_path)
    rows = spark.range(300, numPartitions=1).selectExpr("id", "transform(sequence(1, 50000), x -> CAST(hash(id, x) AS INT)) AS v")
    assert tables.written(rows, "t", LONG_ROWS).count() == 300
    meta = pq.ParquetFile(glob.glob(f"{tmp_path}/t/*.parquet")[0]).metadata
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 16_000_000


def test_places_of_pairs_come_back():
    import pyarrow as pa

    for places in ([], [0], [5, 70_000, 2**31 - 1, 0]):
        assert ta._places_of(ta._places(pa.array(places, pa.int32())), len(places)).to_pylist() == places


SPEC, MODEL = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(P.path("piece_bpe_32k.model"), "rb").read()


def aligned(aligner, texts):
    """(n_a, n_b, n_links, sha) of each text."""
    return [row for _, got in aligner.slices(texts) for row in zip(*(list(got[c]) for c in ("n_a", "n_b", "n_links", "groups_sha256")))]


def test_chunks_met_often_outlive_the_others(monkeypatch):
    monkeypatch.setattr(ta, "REMEMBERED", 50)
    aligner, often = ta.Aligner(ta.byte_level(SPEC), ta.pieces(MODEL)), "and of the"
    encoded = [Counter(), Counter()]
    for tokenizer, words in zip((aligner.a, aligner.b), encoded):
        monkeypatch.setattr(tokenizer, "encode", lambda new, encode=tokenizer.encode, words=words: words.update(new) or encode(new))
    texts = [f"{often} {often} " + " ".join(f"w{i}x{k}" for k in range(60)) for i in range(20)]
    got = [aligned(aligner, [t])[0] for t in texts]
    assert all(words[" " + w] == 1 for words in encoded for w in often.split()) and len(aligner.memory.numbers) < 200
    assert got == [(r[0], r[1], r[3], r[6]) for r in by_hand(texts)]


def test_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(ta, "REMEMBERED_BYTES", 2000)
    aligner = ta.Aligner(ta.byte_level(SPEC), ta.pieces(MODEL))
    texts = [("z" * 900 + f"{i % 4} ") * 3 + "the the" for i in range(12)]
    for t in texts:
        assert aligned(aligner, [t]) == [(r[0], r[1], r[3], r[6]) for r in by_hand([t])]
        assert aligner.memory.held.sum() == sum(len(c.encode()) for c in aligner.memory.numbers) <= 4000


@pytest.mark.parametrize("whole", [0, 10, 1000])
def test_chunks_of_white_space(monkeypatch, whole):
    monkeypatch.setattr(ta, "WHOLE_CHUNK", whole)
    monkeypatch.setattr(ta, "SHORT_WORD", 6)
    monkeypatch.setattr(ta, "REMEMBERED", 300)
    rnd = random.Random(whole)
    parts = [" ", " ", "  ", "\n", "\n", "\t", "\r", "\x1c", "\x85", "\u00a0", "\u3000", "\u2028", "\u200b", "a", "Foo", "'s", "12", "...", "é", "▁"]
    weights = [3] * 7 + [1] * 6 + [2] * 6 + [0.1]
    texts = ["".join(rnd.choices(parts, weights, k=rnd.randint(1, 14))) for _ in range(3000)]
    aligner = ta.Aligner(ta.byte_level(SPEC), ta.pieces(MODEL))
    got = [row for i in range(0, len(texts), 100) for row in aligned(aligner, texts[i : i + 100])]
    for t, g, r in zip(texts, got, by_hand(texts), strict=True):
        assert g == (r[0], r[1], r[3], r[6]), t


def test_short_words_merge_as_any(monkeypatch):
    from logloom.llm import bpe

    monkeypatch.setattr(bpe, "BLOCK_WORDS", 70)
    vocab, rnd = bpe.Vocabulary(SPEC), random.Random(5)
    words = [b"", b"x", *(bytes(rnd.choices(b" aaaathenoiZ\xc3\xa9=-", k=rnd.randint(0, 40))) for _ in range(500)), b"", b"a" * 64]
    for some in ([], [b""], [b"", b"ab"], words):
        ids, sizes = bpe.merge_short_words(vocab, some)
        want, want_sizes = bpe.merge_words(vocab, some)
        assert ids.tolist() == want.tolist() and sizes.tolist() == want_sizes.tolist()
