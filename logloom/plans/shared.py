"""Intermediate tables in the folder that the driver and all executors share."""

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_GROUPS_HELD = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
_lock, _users, _before = threading.Lock(), 0, ""
#: Of tables with rows of 100 KB and more: row groups of some 8 MB, looked at each few rows. The writer holds a row group in
#: memory, and the reader of nested columns up to 4096 rows of one; by default a row group has 128 MB, at least 100 rows.
LONG_ROWS = {"parquet.block.size": 8_000_000, "parquet.page.size.row.check.min": 4, "parquet.block.size.row.check.min": 4}


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ctx = spark.sparkContext
        if not ctx.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = ctx.getCheckpointDir()
        if not base:
            ctx.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-"))
            base = ctx.getCheckpointDir()
    return f"{base.rstrip('/')}/logloom-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, in a folder of this application; only where that is unset (local runs,
    tests) a temporary folder serves."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_shared(spark: SparkSession) -> bool:
    """Deletes all that this application has written to the shared folder. Results that are read lazily from there
    (of the dedup operators, for example) must have been written elsewhere or collected before."""
    return delete_folder(spark, _base(spark))


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the actions inside go as soon as each action ends, not when the driver happens to collect garbage.
    The setting is the session's: it is on while any thread is inside, and gets its old value when the last one leaves."""
    global _users, _before
    with _lock:
        if _users == 0:
            _before = spark.conf.get(_FREE_SHUFFLES)
            spark.conf.set(_FREE_SHUFFLES, "true")
        _users += 1
    try:
        yield
    finally:
        with _lock:
            _users -= 1
            if _users == 0:
                spark.conf.set(_FREE_SHUFFLES, _before)


@contextmanager
def groups_sorted(spark: SparkSession):
    """Aggregations planned and run inside that collect lists are sorted by their key and take one group at a time, where
    they else hold the lists of 128 groups as objects. The setting is the session's, as above."""
    before = spark.conf.get(_GROUPS_HELD)
    spark.conf.set(_GROUPS_HELD, "1")
    try:
        yield
    finally:
        spark.conf.set(_GROUPS_HELD, before)


def _stored(df: DataFrame, path: str, options: dict | None = None) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and a lost executor costs nothing that was done.
    The table stays until clear_shared; see Scratch for tables that are needed for a while."""
    return _stored(df, shared_path(df.sparkSession, name))


def splittable(df: DataFrame, name: str) -> DataFrame:
    """``df``, an aggregation by the key of a join to come, as a written table. Joined directly, the aggregation would
    pin the join to its own partitioning, and a key with a third of all rows on the other side would be one task's;
    joined from a table, adaptive execution may split the hot partition."""
    return written(df, name)


class Scratch:
    """The written tables of one job, by name, each deleted once the tables made from it are written themselves.
    ``tasks``, once set, is how many tasks, and so files, write a table at most."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.path, self.tasks = spark, shared_path(spark, job), None

    def written(self, df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
        if self.tasks:
            df = df.coalesce(self.tasks)
        return _stored(df, f"{self.path}/{name}", options)

    def free(self, *names: str) -> None:
        """Deletes tables that no table or result to come reads."""
        for name in names:
            delete_folder(self.spark, f"{self.path}/{name}")


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` plus ``value`` as a column that later ones may read many times: it passes an explode of one row, as projects
    above would else be merged and make it anew for each of its fields."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array(value)).alias(name))
