"""Quality scores of texts from a byte-level convolutional network trained on labelled documents."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import byte_convnet
from logloom.llm.arrow_texts import packed, released, slices, texts_of, unpacked
from logloom.llm.samples import fold, per_class, texts_of_sample
from logloom.sources import load

#: Labelled rows that the network is fitted on, at most: rejected and accepted ones.
SAMPLE = {0: 1600, 1: 3200}
EPOCHS, LEAST_STEPS, BATCH = 10, 500, 32
HOLD_OUT = 5
THRESHOLD = 0.3


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: dict = SAMPLE) -> byte_convnet.Net:
    """A network fitted on the driver to at most ``sample`` whole texts per label, of ids outside the held-out fold.

    Ids with several labels take the smallest; ids with several texts count once; labels other than 0 and 1, and ids that are null or
    have no text, are left out, as are texts above 64 KB of a label that has shorter ones. Without labels every score will be 0.5; with one label only, it is a constant near that label.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & (fold(id_col, HOLD_OUT) != 0)).groupBy(F.col(id_col).cast("string").alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    texts = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).filter("_text IS NOT NULL")
    sizes = texts.groupBy("_id").agg(F.min(F.octet_length("_text")).alias("_size"))
    chosen = per_class(known.join(sizes, "_id"), "_id", "_label", sample, "_size")
    rows = sorted((r._id, r._label, r._text) for r in texts_of_sample(texts, chosen, ["_id"], "_text"))
    y = np.array([r[1] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        net = byte_convnet.Net.start(0)
        net.params["out"][:] = 0
        net.params["out_bias"][:] = 0 if not len(y) else 3 if y[0] else -3
        return net
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))
    return byte_convnet.fit([r[2].encode() for r in rows], y, epochs=epochs, batch=BATCH, rate=0.005, balance=0.0)


def _scored(net, text_col):
    def rows(batches):
        for cols, buf, starts, ends in slices(batches, ["_row"], lambda b: texts_of(b, text_col)):
            texts = [buf[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
            logit = byte_convnet.score(net, texts).astype(np.float64)
            yield pa.RecordBatch.from_arrays([cols["_row"], pa.array(1 / (1 + np.exp(-logit)))], names=["_row", "score"])

    return rows


def score(docs: DataFrame, net: byte_convnet.Net, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score`` in 0..1 (an input column of that name gives way). Every byte of every text is read,
    and slices of bounded size, or a single long text, lie in memory at a time; null texts count as empty; repeated rows
    give repeated rows. In the query a null id is held out, as no text without an id is learned. The network is a few dozen kilobytes and travels with the tasks; nothing is shuffled."""
    rows, names, row = packed(docs, ["score"], text_col)
    return unpacked(rows.mapInArrow(released(_scored(net, text_col)), f"_row {row}, score double"), names, ["score"])


def query(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, load(spark, sf_dir, "labels")))
    held = F.coalesce(fold("doc_id", HOLD_OUT) == 0, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op8_quality_classifier": query}
ORACLES: dict[str, str] = {}
