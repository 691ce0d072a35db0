"""Documents to training tokens in five stages, each written as Parquet and read again as the next stage's input.

A stage carries the columns of its input as one struct past its operator, so input columns of any name come out as they
went in. Null ids and texts, repeated rows and empty tables pass every stage: a null text is an empty one (and stays null
where a stage does not change texts), rows that repeat whole are copies of each other.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, decontaminate, quality_classifier, simhash, suffix_dedup
from logloom.plans import shared_path
from logloom.plans.shared import delete_folder
from logloom.sources import load


def _carried(docs: DataFrame, *beside: str) -> DataFrame:
    """``_doc``, all columns but the text as one struct; the text; and copies of the columns ``beside``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("_doc"), "text", *beside)


def _restored(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs``, from ``_doc``, the text, or ``changed``."""
    kept = {c: F.col(f"_doc.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")} | changed
    return found.select(*[kept[c].alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels, does not reject (score of THRESHOLD or more)."""
    net = quality_classifier.train(docs, load(spark, sf_dir, "labels"))
    kept = quality_classifier.score(_carried(docs), net).filter(F.col("score") >= quality_classifier.THRESHOLD)
    return _restored(kept, docs)


def _named(doc_id: Column, text_hash: Column) -> Column:
    """One name for an id and the hash of a text, either of which may be null."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(":"), F.coalesce(text_hash, F.lit("none"))).cast("binary"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one of the smallest id (null ids last; then the smallest text hash); of
    rows that repeat an id and its text, the one whose other columns come first as JSON. Different texts with a null or
    repeated id are documents of their own. Rows that repeat are combined map-side, so they make no hot key."""
    keep = simhash.survivors(docs).select(_named(F.col("_id"), F.col("_hash")).alias("_name"))
    rows = _carried(docs, "doc_id").select("_doc", "text", _named(F.col("doc_id").cast("bigint"), simhash.text_hash()).alias("_name"))
    first = F.min_by(F.struct("_doc", "text"), F.to_json("_doc")).alias("_row")
    found = rows.groupBy("_name").agg(first).join(keep, "_name", "left_semi").select("_row._doc", "_row.text")
    return _restored(found, docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 200 that occur twice or more; characters of which only a part stays go too.
    Documents of which nothing stays go. n_chars follows the text."""
    found = suffix_dedup.remove_repeats(_carried(docs, "doc_id"), as_text=True)
    found = found.filter((F.size("removed") == 0) | (F.octet_length("kept") > 0))
    return _restored(found, docs, text=F.col("kept"), n_chars=F.length("kept").cast("bigint"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark passages make up less than a twentieth of the words."""
    found = decontaminate.decontaminate(_carried(docs), load(spark, sf_dir, "benchmark"))
    return _restored(found.filter(~decontaminate.contaminated()), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents plus token ids, their number n_tokens, and decoded, the text that they decode to; input
    columns of these three names give way."""
    found = bpe.encode_decode(docs, bpe.public_vocabulary())
    return found.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", tokenize),
]

#: The trained network and the dedup stages are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; the table of a stage is deleted when the next one is written."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
