"""Bounded samples of labelled rows for training on the driver."""

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Longer texts are scored whole like any other, but trained on only where a label has no shorter one.
TRAIN_TEXT_BYTES = 65_536
#: Bytes of all texts of a sample, at most.
TRAIN_BYTES = 320 << 20
#: Classes that are told apart; of more, the most frequent.
CLASSES = 1000
_log = logging.getLogger(__name__)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def per_class(rows: DataFrame, id_col: str, label_col: str, most: int | dict, size_col: str) -> DataFrame:
    """Distinct ``id_col, label_col, _longest``: at most ``most`` ids of each label (or most[label]), the first by a hash of
    the id, and few enough that their texts (of size_col bytes), _longest bytes at most, fit TRAIN_BYTES together.

    _longest is TRAIN_TEXT_BYTES, or the shortest text of a label if all are longer. Only ids that may be chosen are
    counted, so long texts of a label take nothing from its short ones. Labels that are not learned are logged: those whose shortest
    text alone exceeds their share, and those beyond the CLASSES most frequent. One pass counts; another keeps, below a
    hash threshold, about three times the ids wanted (and 100), and these few are ranked. What is returned is small next
    to any broadcast bound.
    """
    short = F.col(size_col) <= TRAIN_TEXT_BYTES
    counted = rows.groupBy(label_col).agg(F.count("*").alias("c"), F.approx_count_distinct(F.when(short, F.col(id_col))).alias("n"), F.min(size_col).alias("least"))
    counts = counted.filter("least IS NOT NULL").orderBy(F.desc("c"), label_col).limit(CLASSES + 1).collect()
    if len(counts) > CLASSES:
        _log.warning("labels from %s on, by frequency, are not learned: %d are at most", counts.pop()[0], CLASSES)
    wished = {r[0]: most[r[0]] if isinstance(most, dict) else most for r in counts}
    spark, kind = rows.sparkSession, dict(rows.dtypes)[label_col]
    limits = []
    for r in counts:
        longest, share = max(TRAIN_TEXT_BYTES, r.least), TRAIN_BYTES * wished[r[0]] // sum(wished.values())
        wanted = min(wished[r[0]], share // longest) if longest else wished[r[0]]
        if not wanted:
            _log.warning("label %s is not learned: its shortest text has %d bytes", r[0], r.least)
            continue
        limits.append((r[0], wanted, longest, min(1.0, (3 * wanted + 100) / r.n) if r.n else 1.0))
    table = spark.createDataFrame(limits, f"`{label_col}` {kind}, _most bigint, _longest bigint, _below double")
    unit = F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = rows.withColumn("_unit", unit).join(F.broadcast(table), label_col).filter((F.col("_unit") < F.col("_below")) & (F.col(size_col) <= F.col("_longest")))
    few = few.select(id_col, label_col, "_longest", "_most", "_unit").distinct()
    place = F.row_number().over(Window.partitionBy(label_col).orderBy("_unit", id_col))
    return few.withColumn("_place", place).filter("_place <= _most").select(id_col, label_col, "_longest")


def texts_of_sample(texts: DataFrame, chosen: DataFrame, keys: list[str], text_col: str) -> list:
    """The chosen rows with a text of ``texts``, collected: one text for each of ``keys`` (that of the smallest hash), so
    an id that a third of all rows has brings one text, combined map-side."""
    small = texts.filter(F.octet_length(text_col) <= TRAIN_BYTES)
    joined = small.join(F.broadcast(chosen), keys).filter(F.octet_length(text_col) <= F.col("_longest"))
    names = [c for c in chosen.columns if c != "_longest"]
    return joined.groupBy(*names).agg(F.min(F.struct(F.xxhash64(text_col), F.col(text_col).alias("t"))).alias("m")).select(*names, F.col("m.t").alias(text_col)).collect()
