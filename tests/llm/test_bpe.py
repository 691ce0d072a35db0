import hashlib
import random

import pytest
from tokenizers import Tokenizer

from logloom.llm import bpe as B
from logloom.sources import load

PATH = B.public_vocabulary()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query_equals_library(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in B.query(spark, sf).collect()}
    for r in load(spark, sf, "documents").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == sha(",".join(map(str, ids)))
        assert g.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_hard_texts(library):
    rnd = random.Random(5)
    texts = ["", " ", "aaaaaaaaaaaaa", "a" * 999, "  \n\n  x", "it's we'll I'D", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "<|endoftext", "日本語 текст é ñ ß", "🎉👩‍👩‍👧 é", "  x　", "12345 3.14159", "=" * 77, "!!!???...", "\x00\x01\x7f", "x" * 70000]
    alphabet = "ab c\n\té1!'st—ß "
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    encoder = B.Encoder(B.Vocabulary(open(PATH, encoding="utf-8").read()))
    for t, ids in zip(texts, encoder.encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t[:80]
        assert B.decode(encoder.vocab, ids) == library.decode(want, skip_special_tokens=False) == t


def test_partial_characters_decode_as_the_library_does(library):
    vocab = B.Vocabulary(open(PATH, encoding="utf-8").read())
    ids = library.encode("é日🎉", add_special_tokens=False).ids
    for i in range(len(ids)):
        assert B.decode(vocab, ids[i : i + 1]) == library.decode(ids[i : i + 1], skip_special_tokens=False)


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6)], "doc_id bigint, text string, ids int").withColumn("_row", B.F.lit(1))
    got = sorted((str(r.doc_id), list(r["ids"]), r.decoded, r._row) for r in B.encode_decode(docs, PATH).collect())
    assert got == [("1", [], "", 1), ("1", [], "", 1), ("None", [64, 275], "a b", 1)]
    assert B.encode_decode(docs.limit(0), PATH).count() == 0
