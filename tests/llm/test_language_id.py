import zlib

import numpy as np

from logloom.llm import language_id as L
from logloom.sources import load

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in load(spark, SF, "documents").select("doc_id", "lang").collect()}
    got = L.query(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.97


def sets(text):
    """N-grams of a text as sets of strings, by the docstring's words."""
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(t.split()) + " " if t.strip() else " "
    return [{t[i : i + n] for i in range(len(t) - n + 1)} for n in L.ORDERS]


def kernel(a, b):
    return np.mean([len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y))) for x, y in zip(sets(a), sets(b))])


def test_kernel_is_that_of_n_gram_sets():
    texts = ["Abc, abé!  x", "bcd ABé zz", "ქართული ენა", "\U00010400\U00010401 abc", "12 !", "", "Straße ÄÖ", "abc " * 50]
    columns = [L._distinct(np.concatenate(x)) for x in zip(*map(L.n_grams, texts))]
    m = L.presence(texts, columns)
    for i, a in enumerate(texts):
        assert [len(x) for x in L.n_grams(a)] == [len(x) for x in sets(a)], a
        for j, b in enumerate(texts):
            assert abs((m[i] @ m[j]) - kernel(a, b)) < 1e-5, (a, b)


def test_trained_scores_equal_kernels_of_sets(spark):
    """The trained model on held-out documents, with each kernel value from sets of n-grams."""
    docs = load(spark, SF, "documents")
    model = L.train(docs)
    back = [{c: "".join(chr(x) if (x := (int(c) >> (L._BITS * k)) & ((1 << L._BITS) - 1)) else " " for k in reversed(range(n))) for c in own.tolist()} for n, own in zip(L.ORDERS, model.columns)]
    cuts = np.cumsum([0, *map(len, model.columns)])
    marks = [[{back[k][c] for c in own[row[a:b] > 0].tolist()} for k, (own, a, b) in enumerate(zip(model.columns, cuts, cuts[1:]))] for row in model.landmarks]
    got = [r for r in L.query(spark, SF).collect() if r.held_out and r.lang_pred != "und"][:60]
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in got:
        own = sets(text[r.doc_id])
        k = np.array([np.mean([len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b))) for a, b in zip(own, m)]) for m in marks])
        scores = k @ model.weights + model.offset
        assert model.languages[int(scores.argmax())] == r.lang_pred
        assert abs(min(1, max(0, scores.max())) - r.score) < 2e-3


#: First code points and numbers of letters of ten scripts, Latin twice.
SCRIPTS = {"latin-a": (97, 13), "latin-b": (110, 13), "greek": (0x3B1, 20), "cyrillic": (0x430, 32), "armenian": (0x561, 38), "hebrew": (0x5D0, 27), "georgian": (0x10D0, 33), "thai": (0xE01, 46), "hangul": (0xAC00, 300), "deseret": (0x10428, 38)}


def test_ten_scripts_are_told_apart(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for lang, (first, n) in SCRIPTS.items():
        words = ["".join(chr(first + min(n - 1, int(rnd.expovariate(4 / n)))) for _ in range(rnd.randint(2, 8))) for _ in range(200)]
        rows += [(len(rows) + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 30))), lang) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = L.identify(docs, L.train(docs)).filter(L.fold("doc_id", L.HOLD_OUT) == L.HELD).collect()
    for lang in SCRIPTS:
        own = [r.lang_pred == lang for r in got if r.lang == lang]
        assert len(own) > 20 and np.mean(own) >= 0.95, lang


def test_few_short_texts_among_many_long_ones_are_learned(spark, monkeypatch, caplog):
    from logloom.llm import samples

    monkeypatch.setattr(samples, "TRAIN_TEXT_BYTES", 100)
    F = L.F
    long_ = spark.range(60_000).select(F.concat(F.lit("x"), "id").alias("doc_id"), F.lit("a").alias("lang"), F.lit(500).alias("n"))
    short = [(f"s{i}", lang, 50) for lang, n in (("a", 20), ("b", 3), ("c", 400)) for i in range(n)]
    rows = long_.unionByName(spark.createDataFrame(short + [("l", "d", 10**10)], "doc_id string, lang string, n bigint"))
    got = samples.per_class(rows, "doc_id", "lang", 30, "n").collect()
    assert {lang: sum(r.lang == lang for r in got) for lang in "abcd"} == {"a": 20, "b": 3, "c": 30, "d": 0}
    assert "label d is not learned" in caplog.text
    one = samples.per_class(rows, "doc_id", "lang", 1, "n").collect()
    assert sorted(r.lang for r in one) == ["a", "b", "c"]
    monkeypatch.setattr(samples, "CLASSES", 2)
    assert {r.lang for r in samples.per_class(rows, "doc_id", "lang", 1, "n").collect()} == {"a", "c"}
    assert "labels from b on, by frequency, are not learned" in caplog.text


def test_hot_ids_and_long_only_languages_are_learned_within_the_budget(spark, monkeypatch):
    from logloom.llm import samples

    monkeypatch.setattr(samples, "TRAIN_TEXT_BYTES", 200)
    rows = [("hot", f"the cat {i % 50} sat on the mat", "en") for i in range(3000)] + [(f"e{i}", f"a dog {i} ran over the hill", "en") for i in range(100)]
    rows += [(f"l{i}", "der hund lief über die straße und " * (20 + i), "de") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    sized = docs.select("doc_id", "lang", L.F.octet_length("text").alias("n"))
    chosen = samples.per_class(sized, "doc_id", "lang", 40, "n")
    got = samples.texts_of_sample(docs, chosen, ["doc_id", "lang"], "text")
    by = {k: [r for r in got if r.lang == k] for k in ("en", "de")}
    assert 20 <= len(by["en"]) <= 40 and len({r.doc_id for r in by["en"]}) == len(by["en"]) and len(by["de"]) >= 1
    assert L.identify(docs, L.train(docs)).filter("lang_pred <> lang").count() == 0
    monkeypatch.setattr(samples, "TRAIN_BYTES", 1000)
    assert {r.lang for r in samples.per_class(sized, "doc_id", "lang", 40, "n").collect()} == {"en"}


def test_parts_of_a_long_text_give_the_same_n_grams():
    for text in ("", "ab  12é, xyz!  a b", "  ab", "ab..", "a" * 9 + " " * 9 + "é"):
        whole = [x.tolist() for x in L.n_grams(text, 10**6)]
        for part in (1, 2, 3, 5):
            assert [x.tolist() for x in L.n_grams(text, part)] == whole, (text, part)


def test_nulls_no_letters_repeats_extra_columns_and_no_rows(spark):
    rows = [(i, f"the cat {w} sat on the mat", "en") for i, w in enumerate("abcdefghij")] + [(i + 50, f"der hund {w} lief über straße", "de") for i, w in enumerate("abcdefghij")]
    rows += [(90, None, "en"), (91, "12 !?", None), (None, "the the", "en"), (None, "the the", "en"), (92, "", "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", L.F.lit("s")).withColumn("_row", L.F.lit(1))
    model = L.train(docs)
    got = L.identify(docs, model).collect()
    assert len(got) == len(rows)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (90, 91, 92)} == {("und", 0.0)}
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 90)
    assert L.identify(docs.limit(0), model).count() == 0
    assert L.train(docs.limit(0)) is None
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}
