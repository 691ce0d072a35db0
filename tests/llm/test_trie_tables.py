"""Tables of a small trie are a few files, however many shuffle partitions there are."""

from pyspark.sql import functions as F

from logloom.plans import Scratch


def test_tasks_bound_the_files_of_a_table(spark):
    tables = Scratch(spark, "few")
    tables.tasks = 3
    df = tables.written(spark.range(1000).repartition(40, "id"), "t")
    assert df.select(F.input_file_name()).distinct().count() <= 3 and df.count() == 1000
