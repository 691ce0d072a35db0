import zlib

import numpy as np

from logloom.llm import byte_convnet as N
from logloom.llm import quality_classifier as Q
from logloom.sources import load

SF = "/root/testdata/sf0.01"


def plain_score(net, text):
    """The network written out for one text, chunk by chunk."""
    p = net.params
    n_cells = -(-(len(text) + N.WIDTH) // N.CELL)
    b = [256] * N.WIDTH + list(text) + [256] * (n_cells * N.CELL - len(text))
    cell = []
    for c in range(n_cells):
        outs = [np.concatenate([p["embed"][b[c * N.CELL + s + k]] for k in range(N.WIDTH)]) @ p["filters"] for s in range(0, N.CELL, N.STRIDE)]
        cell.append(np.max(outs, axis=0))
    hs, at = [], 0
    while True:
        part = cell[at : at + N.CHUNK]
        held = max(0, min((at + len(part)) * N.CELL, len(text)) - at * N.CELL)
        z = np.append(np.maximum(np.max(part, axis=0) + p["bias"], 0), [held / (N.CHUNK * N.CELL), np.log1p(held) / 6])
        hs.append(np.tanh(z @ p["hidden"] + p["hidden_bias"]))
        at += N.CHUNK - 1
        if at + 1 >= n_cells:
            break
    return float(np.append(np.max(hs, axis=0), np.mean(hs, axis=0)) @ p["out"] + p["out_bias"][0])


def test_scores_equal_the_plain_network_whatever_the_batch():
    net = N.Net.start(4)
    rnd = np.random.default_rng(1)
    texts = [b"", b"a", bytes(rnd.integers(0, 256, 121, np.uint8)), bytes(rnd.integers(32, 120, 4000, np.uint8)), b"xy" * 300, bytes(rnd.integers(0, 256, 640, np.uint8))]
    got = N.score(net, texts)
    np.testing.assert_allclose(got, [plain_score(net, t) for t in texts], rtol=1e-3, atol=1e-4)
    np.testing.assert_allclose(got, [N.score(net, [t])[0] for t in texts], rtol=1e-4, atol=1e-5)


def test_gradients_equal_differences():
    net = N.Net.start(2)
    texts, y, w = [b"hello there " * 40, b"###" * 200, b"z"], np.array([1, 0, 1]), np.ones(3)
    _, g = N.gradients(net, texts, y, w)
    for name in ("embed", "filters", "hidden", "out"):
        at = tuple(x[0] for x in np.nonzero(np.abs(g[name]) == np.abs(g[name]).max()))
        old, eps = net.params[name][at], 2e-3
        net.params[name][at] = old + eps
        up = N.gradients(net, texts, y, w)[0]
        net.params[name][at] = old - eps
        down = N.gradients(net, texts, y, w)[0]
        net.params[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 0.1 * abs(g[name][at]) + 1e-3, name


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in Q.query(spark, SF).collect()}
    assert len(got) == load(spark, SF, "documents").count()
    marks = {r.doc_id: r.quality for r in load(spark, SF, "labels").collect()}
    held = [(got[i].predicted, q) for i, q in marks.items() if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([p == q for p, q in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_trained_scores_equal_the_plain_network(spark):
    docs = load(spark, SF, "documents").select("doc_id", "text")
    net = Q.train(docs, load(spark, SF, "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    some = [r for r in Q.query(spark, SF).collect() if r.held_out and len(text[r.doc_id]) < 3000][:80]
    for r in some:
        assert abs(1 / (1 + np.exp(-plain_score(net, text[r.doc_id].encode()))) - r.score) < 1e-3


def test_a_very_long_text_is_read_to_its_end(spark):
    net = N.Net.start(3)
    long = "plain words of prose " * 150_000
    docs = spark.createDataFrame([(1, long), (2, long + "\x01\x02\x7f~~~" * 400)], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in Q.score(docs, net).collect()}
    assert got[1] != got[2] and abs(got[1] - 1 / (1 + np.exp(-float(N.score(net, [long.encode()])[0])))) < 1e-5


def test_nulls_repeats_extra_columns_no_rows_and_lone_labels(spark):
    docs = spark.createDataFrame([(1, None, 7), (1, None, 7), (None, "x", 8), (2, "### $$$", 9)], "doc_id bigint, text string, score int").withColumn("_row", Q.F.lit(0))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in Q.score(docs, Q.train(docs, none)).collect()} == {0.5}
    lone = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (2, None)], "doc_id bigint, quality int")
    assert min(r.score for r in Q.score(docs, Q.train(docs, lone)).collect()) > 0.9
    assert Q.score(docs.limit(0), N.Net.start(1)).count() == 0
    assert len(Q.score(docs, N.Net.start(1)).collect()) == 4
