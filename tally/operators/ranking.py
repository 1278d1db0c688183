"""Distributed exact ranking inside large groups.

A plain ``row_number().over(partitionBy(y).orderBy(key))`` sends every row of a
class to one task — with a binary label that is half the data in one task. Here
rows are first spread over ``2^bits`` hash buckets per group (the bucket is the
key's prefix, so bucket order agrees with key order); bucket sizes are counted
(a small table: groups x buckets), turned into running offsets, and the final
rank is offset + row_number inside (group, bucket). Every window partition then
holds about n / 2^bits rows, whatever the class balance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.exprs import hash_bucket


def ranked(df: DataFrame, group_cols: list[str], key_col: str, tie_col: str,
           rank_col: str = "rank", bits: int = 16, size_col: str | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row inside ``group_cols`` ordered by (key, tie).

    ``size_col`` also adds the group's size, from the bucket sizes at hand.
    """
    b = "_bucket"
    x = df.withColumn(b, hash_bucket(key_col, bits))
    # one exchange on (group, bucket): the in-bucket row number, and — from the same
    # partitioning, without another pass over the input — each bucket's size
    w_in = Window.partitionBy(*group_cols, b).orderBy(key_col, tie_col)
    x = x.withColumn("_rn", F.row_number().over(w_in))
    sizes = x.groupBy(*group_cols, b).agg(F.max("_rn").alias("_bn"))
    w_off = Window.partitionBy(*group_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_bn").over(Window.partitionBy(*group_cols)).alias(size_col)] if size_col else []
    offsets = sizes.select(*group_cols, b, F.coalesce(F.sum("_bn").over(w_off), F.lit(0)).alias("_off"), *extra)
    return (
        x.join(offsets, [*group_cols, b])
        .withColumn(rank_col, (F.col("_off") + F.col("_rn")).cast("long"))
        .drop(b, "_rn", "_off")
    )
