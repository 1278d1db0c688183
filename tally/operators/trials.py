"""Trial-record reports (A10, A11, A13) over best-parameter records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.operators.clean import format_pct, format_share
from tally.operators.ordered import running_counts


def param_mode(trials: DataFrame, model: str, run: str, params: list[str]) -> DataFrame:
    """A10: most frequent parameter combination per model; ties go to the combination seen first."""
    c = trials.groupBy(model, *params).agg(F.count(F.lit(1)).alias("count"), F.min(run).alias("_first"))
    top = c.groupBy(model).agg(F.max_by(F.struct(*params, "count"), F.struct("count", -F.col("_first"))).alias("_top"),
                               F.sum("count").alias("n"))
    return top.select(model, *[f"_top.{p}" for p in params], F.col("_top.count").alias("count"), "n",
                      format_share("_top.count", "n").alias("share"),
                      format_pct(F.col("_top.count") * 100.0 / F.col("n")).alias("pct"))


def param_value_distribution(trials: DataFrame, model: str, params: list[str]) -> DataFrame:
    """Per model and parameter, count and share of every value."""
    kv = trials.select(model, F.explode(F.create_map(*[x for p in params for x in (F.lit(p), F.col(p).cast("string"))]))
                       .alias("param", "value"))
    c = kv.groupBy(model, "param", "value").agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(model, "param")))


def trial_log(trials: DataFrame, model: str, run: str, folds: int = 10) -> DataFrame:
    """K-th record of a model (in run order) -> repeat k // folds + 1, fold k % folds + 1."""
    r = running_counts(trials.withColumn("_one", F.lit(1)), [model], run, ["_one"])
    k = F.col("cum__one") - 1
    return r.withColumns({"repeat_no": (F.floor(k / folds) + 1).cast("int"), "fold_no": (k % folds + 1).cast("int")}) \
        .drop("_one", "cum__one", "tot__one")
