"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """For each node, the least of itself and its neighbours, joined back to its links."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of the links ``u, v``; the label is the least node it is linked with.

    Each round joins every node's links with their least node (no group is gathered) and
    writes the new links to the shared folder; the number of rounds grows with the
    logarithm of the longest chain. Nulls are no nodes; repeated links and loops are
    harmless; no links give an empty result.
    """
    edges = written(edges.select("u", "v").dropna().filter("u != v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _least(down)
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("u"), "v")
    return edges.union(roots).distinct().toDF("node", "label")
