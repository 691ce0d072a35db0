"""The Parquet tables of a scale-factor directory."""

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``, through Spark's reader so that any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
