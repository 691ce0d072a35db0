"""Connected components of an edge table by alternating large-star and small-star steps."""

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.plans import Scratch

_log = logging.getLogger(__name__)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges``; root is the smallest node that can be reached.

    Each step is a min-aggregation (combined map-side, so a node in a third of all edges is no hot spot), written, and a
    join back on the node, which adaptive execution can split at a hot node. Edges never multiply, no neighbour list is
    built, and a round deletes the tables of the one before. Rounds end when count and checksum of the edges stand still,
    after a number that grows with the logarithm of the nodes; a graph that takes ``max_rounds`` ends in an error.
    """
    tables = Scratch(edges.sparkSession, "components")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e, mark = tables.written(e, "edges-0"), None
    for k in range(1, max_rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tables.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"low-{k}")
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.written(large, f"large-star-{k}")
        tables.free(f"low-{k}", f"edges-{k - 1}")
        own = tables.written(large.groupBy("u").agg(F.min("v").alias("v")), f"own-{k}")
        other = large.join(own.withColumnRenamed("v", "m"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = tables.written(own.unionByName(other).distinct(), f"edges-{k}")
        tables.free(f"large-star-{k}", f"own-{k}")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        _log.info("round %d: %d edges", k, now[0])
        if now == mark:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds; {mark[0]} edges are left")
