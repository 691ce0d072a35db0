"""Streams over the driver's tables, and a sink that may be replayed."""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from logloom.plans import shared_path
from logloom.sources import load


#: State groups of a day. A group of its own for each device-day would be millions of calls of Python for a few rows each.
BUCKETS = 64


def bucketed(parts: DataFrame) -> DataFrame:
    """``parts`` with ``bucket``, by which the devices of a day share a state group (null: those without user_id, whose user_id
    becomes 0, so that ids stay whole numbers in pandas)."""
    bucket = F.when(F.col("user_id").isNotNull(), F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)))
    return parts.withColumn("bucket", bucket).withColumn("user_id", F.coalesce("user_id", F.lit(0).cast("bigint")))


def packed(*columns: np.ndarray) -> tuple[bytes, ...]:
    """Columns of the devices of a state group as they are kept in its state, 8 bytes a value."""
    return tuple(np.ascontiguousarray(c).astype("<f8" if c.dtype.kind == "f" else "<i8").tobytes() for c in columns)


def unpacked(column: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(bytes(column), kind).copy()


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The table ``name`` as files that arrive. The path is a pattern, as a table may be one file or a folder of files."""
    r = spark.readStream.schema(load(spark, sf_dir, name).schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(f"{sf_dir.rstrip('/')}/{name[:-1]}[{name[-1]}].parquet")


def _drain(df: DataFrame, path: str, mode: str, steps=None) -> DataFrame:
    spark = df.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        for step in steps or ():
            batch = step(batch, number)
        batch.write.mode("overwrite").parquet(f"{path}/out/_batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(StructType([*df.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{path}/out")


def drained(df: DataFrame, name: str, mode: str, steps=None) -> DataFrame:
    """Runs the stream over all that is there and returns what it put out, with the batch of each row as ``_batch``.

    Each micro-batch overwrites its own folder, so a batch that is run again after a failure changes nothing. ``steps``
    are functions of (batch, number) that run in order before it is stored.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, f"stream-{name}")
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/out/_batch=-1")
    return _drain(df, path, mode, steps)


def fed(rows: DataFrame, wave: Column, n: int, build, name: str, mode: str = "append") -> DataFrame:
    """Rows that arrive in ``n`` waves (``wave`` numbers them from 0), in order: after each, the stream ``build`` makes of
    what has arrived runs until it is done, and starts again from its checkpoint with the next. Returns what it put out.

    The waves are written once, and each is renamed into the folder that the stream watches.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, f"fed-{name}")
    rows.withColumn("_wave", wave.cast("int")).write.partitionBy("_wave").parquet(f"{path}/staged")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(f"{path}/in"))
    made = lambda: build(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{path}/in"))
    out = made()
    spark.createDataFrame([], out.schema).write.parquet(f"{path}/out/_batch=-1")
    found = spark.read.schema(StructType([*out.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{path}/out")
    for k in range(n):
        if fs.exists(hadoop(f"{path}/staged/_wave={k}")):
            fs.rename(hadoop(f"{path}/staged/_wave={k}"), hadoop(f"{path}/in/wave-{k}"))
            found = _drain(made(), path, mode)
    return found


def latest(updates: DataFrame, by: list[str]) -> DataFrame:
    """Of an update-mode output, the last row of each key."""
    rest = [c for c in updates.columns if c not in by and c != "_batch"]
    last = updates.groupBy(*by).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
    return last.select(*by, *[F.col(f"_last.{c}") for c in rest])
