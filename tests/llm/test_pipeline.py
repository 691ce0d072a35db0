import numpy as np
import pytest

import corpus_pipeline as C
from logloom.llm import quality_classifier as Q
from logloom.sources import load
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_simhash import components, plain_fingerprint
from tests.llm.test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out, docs = [], load(spark, SF, "documents")
    out.append(docs)
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns
    assert set(steps[0].columns) < set(steps[-1].columns)


def test_quality_stage_keeps_what_the_classifier_accepts(spark, steps):
    net = Q.train(steps[0], load(spark, SF, "labels"))
    from logloom.llm import byte_convnet

    before = texts(steps[0])
    ids = sorted(before)
    p = 1 / (1 + np.exp(-byte_convnet.score(net, [before[i].encode() for i in ids]).astype(float)))
    assert set(texts(steps[1])) == {i for i, x in zip(ids, p) if x >= 0.3}


def test_near_copies_stage_keeps_one_of_each_group(steps):
    before = texts(steps[1])
    ids = sorted(before)
    want = set(components(ids, [plain_fingerprint(before[i]) for i in ids]))
    assert set(texts(steps[2])) == want and len(want) < len(ids)


def test_repeats_stage_removes_what_repeats(steps):
    before, after = texts(steps[2]), texts(steps[3])
    ids = sorted(before)
    changed = 0
    for i, (_, gone, _, kept) in zip(ids, repeats([before[i] for i in ids], 200)):
        if gone and not kept.decode(errors="ignore"):
            assert i not in after
        else:
            changed += gone > 0
            assert after[i] == (kept.decode(errors="ignore") if gone else before[i])
    assert changed


def test_decontamination_stage_drops_by_the_rule(spark, steps):
    before, after = texts(steps[3]), texts(steps[4])
    ids = sorted(before)
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    assert set(after) == {i for i, h in zip(ids, hits([before[i] for i in ids], items)) if not h[4]}


def test_tokens_decode_to_the_texts(steps):
    for r in steps[5].collect():
        assert r.decoded == r.text and r.n_tokens == len(r["ids"])


def test_run_gives_the_last_stage(spark, steps):
    assert C.run(spark, SF).count() == steps[5].count()


PROSE = [
    "The quick brown fox jumps over the lazy dog near the river bank while two old men watch it from the bridge and say nothing at all about it.",
    "Prices of copper rose again after the mine in the north was closed for the winter, and traders expect them to stay where they are until spring.",
    "She wrote nine letters to the council about the broken bridge, and when none of them was answered she went to repair the railing herself.",
]


def odd_documents(spark):
    """Null and repeated ids, null and empty texts, repeated rows, and columns of the names that operators use."""
    rows = [(None, PROSE[0]), (None, PROSE[1]), (None, PROSE[1]), (7, PROSE[2]), (7, None), (1, ""), (1, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("score", "kept", "removed", "hits", "n_words", "items", "_row", "_doc", "_name", "spans", "_id", "_hash"):
        docs = docs.withColumn(name, C.F.lit(f"own {name}"))
    return docs


def test_stages_leave_input_columns_alone_and_lose_no_text(spark):
    docs = odd_documents(spark)
    own = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    every = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    want = {
        "quality_classifier": None,
        "simhash_near_dedup": sorted([(None, PROSE[0]), (None, PROSE[1]), (7, PROSE[2]), (1, "")], key=str),
        "suffix_array_dedup": sorted([(i, t or "") for i, t in every], key=str),
        "benchmark_decontamination": every,
        "bpe_encoding": every,
    }
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe_encoding":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        if want[name] is not None:
            assert sorted(((r.doc_id, r.text) for r in got), key=str) == want[name], name
        else:
            assert set((r.doc_id, r.text) for r in got) <= set(every)
        assert got and all(r[c] == f"own {c}" for r in got for c in own), name
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0


def test_repeated_rows_keep_a_defined_one(spark):
    docs = spark.createDataFrame([(3, PROSE[0], s) for s in "cab" * 40], "doc_id bigint, text string, source string").repartition(7)
    assert [tuple(r) for r in C.drop_near_copies(spark, docs, SF).collect()] == [(3, PROSE[0], "a")]


def test_an_empty_table_runs_through(spark, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    load(spark, SF, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    out = C.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids" in out.columns


def test_different_texts_with_null_or_equal_ids_all_stay(spark):
    one, two, three = ("The quick brown fox jumps over the lazy dog near the river bank", "Prices of copper rose again after the mine was closed", "She wrote nine letters to the council about the broken bridge")
    rows = [(None, one), (None, two), (None, two), (7, one), (7, three), (3, one), (8, three + " "), (7, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, _id string, _hash int")
    got = C.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, two), (3, one), (7, three), (7, None)], key=str)
