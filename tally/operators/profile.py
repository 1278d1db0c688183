"""Profiling operators (A1-A7): describe, info, value counts, crosstab, histogram, KDE, box plots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.exprs import keyed_values
from tally.operators.ordered import exact_quantiles


def long_values(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Unpivot numeric columns to (keys..., column, value double)."""
    keys = keys or []
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("_kv")).select(*keys, "_kv.column", "_kv.value")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A1: count, mean, sample std, min, exact quartiles (linear), max per column — one pass + ranks."""
    lv = long_values(df, columns)
    q = exact_quantiles(lv, ["column"], "value", [0.25, 0.5, 0.75], with_stats=True)
    stats = ["count", "mean", "std", "min", "max"]
    return q.groupBy("column", *stats).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                             for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])


def info(df: DataFrame) -> DataFrame:
    """A2: dtype and non-NULL count per column, plus the row count."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f.name).alias("non_null"),
                 F.col("_rows").alias("rows"))
        for i, f in enumerate(df.schema.fields)])).alias("s")).select("s.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A3: count and share of each value, most frequent first."""
    c = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    tot = df.select(F.count(F.lit(1))).scalar()
    return c.withColumn("share", F.col("count") / tot.cast("double")).orderBy(F.desc("count"), F.asc(column))


def crosstab(df: DataFrame, column: str, target: str = "y", values: list | None = None) -> DataFrame:
    """A4: category x target counts, one column per target value."""
    vals = values if values is not None else [0, 1]
    return df.groupBy(column).pivot(target, vals).agg(F.count(F.lit(1))).na.fill(0, [str(v) for v in vals]) \
        .select(column, *[F.col(str(v)).alias(f"{target}_{v}") for v in vals])


def histogram(df: DataFrame, column: str, bins: int = 30, keys: list[str] | None = None,
              density: bool = False) -> DataFrame:
    """A5: equal-width bins between min and max (per group); the last bin is closed."""
    keys = keys or []
    x = df.select(*keys, F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    stats = [F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n")]
    if keys:
        x = x.withColumns(keyed_values(x.groupBy(*keys).agg(*stats), keys, ["lo", "hi", "n"]))
    else:
        st = x.agg(*stats).select(F.struct("lo", "hi", "n")).scalar()
        x = x.withColumns({f: st.getField(f) for f in ("lo", "hi", "n")})
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("lo")) / width).cast("int"), F.lit(bins - 1)))
    h = x.groupBy(*keys, b.alias("bin"), "lo", "hi", "n").agg(F.count(F.lit(1)).alias("count"))
    h = h.withColumns({
        "left": F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(float(bins)),
        "right": F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / F.lit(float(bins)),
    })
    if density:
        h = h.withColumn("density", F.col("count") / (F.col("n") * (F.col("hi") - F.col("lo")) / F.lit(float(bins))))
    return h.drop("lo", "hi", "n")


def kde(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """Exact Gaussian KDE (Scott bandwidth: std * n^(-1/5)) on ``points`` grid points over [min, max].

    One aggregate with a sum per grid point: each row adds its contributions in
    place, nothing is multiplied or shuffled but the partial sums.
    """
    x = df.select(F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    st = x.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"),
               F.stddev_samp("_v").alias("sd")).select(F.struct("lo", "hi", "n", "sd")).scalar()
    lo, hi, n, sd = (st.getField(f) for f in ("lo", "hi", "n", "sd"))
    x = x.withColumns({"_lo": lo, "_step": (hi - lo) / F.lit(float(points - 1)),
                       "_bw": sd * F.pow(n.cast("double"), F.lit(-0.2))})
    at = lambda i: F.col("_lo") + F.lit(i) * F.col("_step")
    sums = [F.sum(F.exp(-0.5 * F.pow((at(i) - F.col("_v")) / F.col("_bw"), F.lit(2.0)))).alias(f"s{i}")
            for i in range(points)]
    g = x.agg(F.first("_lo").alias("_lo"), F.first("_step").alias("_step"), F.first("_bw").alias("_bw"),
              F.count(F.lit(1)).alias("_n"), *sums)
    out = g.select("_lo", "_step", "_bw", "_n", F.posexplode(F.array(*[f"s{i}" for i in range(points)])).alias("i", "_s"))
    return out.where(F.col("_n") > 0).select("i", (F.col("_lo") + F.col("i") * F.col("_step")).alias("x"),
                      (F.col("_s") / (F.col("_n").cast("double") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def boxplot_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme points inside the fences) and outlier count per group."""
    q = exact_quantiles(df, [by], column, [0.25, 0.5, 0.75])
    qw = q.groupBy(by).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                             for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    qw = qw.withColumn("iqr", F.col("q3") - F.col("q1"))
    x = df.select(by, F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    x = x.withColumns(keyed_values(qw, [by], ["q1", "median", "q3", "iqr"]))
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    inside = (F.col("_v") >= lo_f) & (F.col("_v") <= hi_f)
    return x.groupBy(by, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


def head(df: DataFrame, n: int = 5, order: str = "id") -> DataFrame:
    """First n rows in a defined order (distributed top-n)."""
    return df.orderBy(order).limit(n)
