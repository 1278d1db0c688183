"""Hot keys are split: neither a dominant class nor a dominant group lands in one window partition."""

from pyspark.sql import functions as F

from tally.functions.exprs import hash_bucket, seeded_key
from tally.operators import ordered, ranking


def test_hot_class_ranked_over_many_buckets(spark):
    # 95 % of rows in one class
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 20 == 0, 1).otherwise(0).alias("y"))
    x = df.withColumn("_key", seeded_key(7, "id"))
    r = ranking.ranked(x, ["y"], "_key", "id", "rk", bits=8)
    got = {row.y: sorted(v.rk for v in r.where(F.col("y") == row.y).collect()) for row in df.select("y").distinct().collect()}
    assert got[0] == list(range(1, 3801)) and got[1] == list(range(1, 201))
    buckets = x.where("y = 0").select(hash_bucket("_key", 8).alias("b")).distinct().count()
    assert buckets > 200  # the hot class is spread over (almost) all 256 window partitions


def test_hot_group_spans_several_ranges(spark):
    # group 'a' holds 90 % of the rows
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"),
                                  F.col("id").cast("double").alias("v"), F.lit(1).alias("one"))
    tagged = ordered.range_split(df, ["g"], "v", parts=8)
    assert tagged.where("g = 'a'").select("_pid").distinct().count() >= 5
    r = ordered.running_counts(df, ["g"], "v", ["one"], parts=8)
    a = [row.cum_one for row in r.where("g = 'a'").orderBy("v").collect()]
    assert a == list(range(1, 2701))
