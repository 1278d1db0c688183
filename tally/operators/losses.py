"""Losses and slice-level metrics of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.exprs import ColumnOrName, col, keyed_values, softplus
from tally.operators import metrics as M


def bce(z: ColumnOrName, y: ColumnOrName, pos_weight: ColumnOrName | float = 1.0) -> Column:
    """Log loss of a logit ``z`` for label ``y``, positives weighing ``pos_weight``; no overflow at any ``z``."""
    w = F.lit(float(pos_weight)) if isinstance(pos_weight, (int, float)) else col(pos_weight)
    return w * col(y) * softplus(-col(z)) + (1 - col(y)) * softplus(col(z))


def weighted_bce(df: DataFrame, keys: list[str], z: str, y: str = "y", extra: tuple[Column, ...] = ()) -> DataFrame:
    """Per group the weight sqrt(neg / pos) of positives, and the mean loss with and without it.

    The weights of all groups are one scalar subquery; ``extra`` aggregates are computed in the same pass. A group without positives has NULL weights and losses.
    """
    ratio = F.sqrt(F.sum(1 - F.col(y)).cast("double") / F.nullif(F.sum(y), F.lit(0)))
    named = keys or ["_all"]
    x = df if keys else df.withColumn("_all", F.lit(0))
    x = x.withColumn("_weight", keyed_values(x.groupBy(*named).agg(ratio.alias("_w")), named, ["_w"])["_w"])
    out = x.groupBy(*named).agg(*extra, F.max("_weight").alias("pos_weight"), F.avg(bce(z, y, "_weight")).alias("weighted_bce"), F.avg(bce(z, y)).alias("bce"))
    return out if keys else out.drop("_all")


def masked_bce(df: DataFrame, keys: list[str], z: ColumnOrName, y: ColumnOrName, mask: ColumnOrName, pos_weight: float = 1.0) -> DataFrame:
    """Per group the loss summed over real positions (``mask`` 1, padding 0) by their number, and that number."""
    m = col(mask).cast("double")
    return df.groupBy(*keys).agg((F.sum(bce(z, y, pos_weight) * m) / (F.sum(m) + 1e-8)).alias("loss"), F.sum(m).cast("long").alias("n_real"))


def slice_metrics(df: DataFrame, score: str, label: str, valid: ColumnOrName, threshold: float = 0.5) -> DataFrame:
    """Metrics over real positions; NaN scores are dropped and counted."""
    v = df.where(col(valid))
    ok = v.where(~F.isnan(score))
    cm = M.with_rates(M.confusion(ok, [], score, label, threshold, ">"))
    auc = M.auroc(ok, [], score, label).select("auc").scalar()
    c = v.agg(F.sum((~F.isnan(score)).cast("long")).alias("n_valid"), F.sum(F.isnan(score).cast("long")).alias("n_nan_dropped")).select(F.struct("n_valid", "n_nan_dropped")).scalar()
    return cm.select(c.getField("n_valid").alias("n_valid"), c.getField("n_nan_dropped").alias("n_nan_dropped"), "*", auc.alias("auc"))
