"""Exact order statistics without a single-task window.

Global running sums, exact ranks and exact quantiles normally need one ordered
pass over a whole group. Here a group is cut into contiguous value ranges with
``repartitionByRange`` (boundaries come from Spark's sample of the data, so the
ranges hold similar row counts even when values are skewed). Per-range totals
form a small table (groups x ranges) whose running offsets are cheap; inside a
range the ordinary window runs on ~n / ranges rows. The result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.session import checkpoint_dir

PID = "_pid"


def _parts(df: DataFrame, parts: int | None) -> int:
    if parts:
        return parts
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_split(df: DataFrame, group_cols: list[str], order_col: str, parts: int | None = None) -> DataFrame:
    """Range-partition on (groups, order) and tag each row with its range id ``_pid``.

    Range boundaries come from a sample drawn anew each time the exchange runs,
    so the tagged frame is checkpointed (reliable checkpoint in the session's
    shared ``spark.checkpoint.dir``): every later branch — totals, offsets and
    in-range windows — then sees the same ids, also after an executor is lost.
    """
    checkpoint_dir(df.sparkSession)
    keys = [F.col(c) for c in group_cols] + [F.col(order_col)]
    tagged = df.repartitionByRange(_parts(df, parts), *keys).withColumn(PID, F.spark_partition_id())
    return tagged.checkpoint(eager=True)


def _wgroup(group_cols: list[str]) -> Window:
    return Window.partitionBy(*group_cols)


def _with_group(df: DataFrame, group_cols: list[str]) -> tuple[DataFrame, list[str], bool]:
    """Ungrouped calls get a constant group column so every join stays an equi-join."""
    if group_cols:
        return df, list(group_cols), False
    return df.withColumn("_g", F.lit(0)), ["_g"], True


def running_counts(df: DataFrame, group_cols: list[str], order_col: str, sum_cols: list[str],
                   parts: int | None = None, neighbours: bool = False) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ascending ``order_col`` within each group.

    ``order_col`` must be unique within a group (aggregate first). Adds
    ``cum_<c>`` (sum over rows with order <= this row), ``tot_<c>`` (group
    total) and, with ``neighbours``, ``prev_<c>``/``next_<c>`` (the values of the
    adjacent rows in order; NULL at the ends).
    """
    orig_cols = df.columns
    df, group_cols, synthetic = _with_group(df, group_cols)
    x = range_split(df, group_cols, order_col, parts)
    gp = [*group_cols, PID]
    aggs = [F.sum(c).alias(f"_p_{c}") for c in sum_cols]
    if neighbours:
        aggs += [F.min_by(c, order_col).alias(f"_first_{c}") for c in sum_cols]
        aggs += [F.max_by(c, order_col).alias(f"_last_{c}") for c in sum_cols]
    summ = x.groupBy(*gp).agg(*aggs)
    wg = _wgroup(group_cols)
    w_before = wg.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    sel = [*gp]
    for c in sum_cols:
        sel.append(F.coalesce(F.sum(f"_p_{c}").over(w_before), F.lit(0)).alias(f"_off_{c}"))
        sel.append(F.sum(f"_p_{c}").over(wg).alias(f"tot_{c}"))
        if neighbours:
            sel.append(F.lag(f"_last_{c}").over(wg.orderBy(PID)).alias(f"_pprev_{c}"))
            sel.append(F.lead(f"_first_{c}").over(wg.orderBy(PID)).alias(f"_pnext_{c}"))
    summ = summ.select(*sel)
    w_in = Window.partitionBy(*gp).orderBy(order_col)
    w_run = w_in.rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.col(c) for c in x.columns]
    for c in sum_cols:
        cols.append(F.sum(c).over(w_run).alias(f"_in_{c}"))
        if neighbours:
            cols.append(F.lag(c).over(w_in).alias(f"_lag_{c}"))
            cols.append(F.lead(c).over(w_in).alias(f"_lead_{c}"))
    y = x.select(*cols).join(summ, gp)
    out = [F.col(c) for c in orig_cols]
    for c in sum_cols:
        out.append((F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(f"cum_{c}"))
        out.append(F.col(f"tot_{c}"))
        if neighbours:
            out.append(F.coalesce(F.col(f"_lag_{c}"), F.col(f"_pprev_{c}")).alias(f"prev_{c}"))
            out.append(F.coalesce(F.col(f"_lead_{c}"), F.col(f"_pnext_{c}")).alias(f"next_{c}"))
    return y.select(*out)


def dense_index(df: DataFrame, group_cols: list[str], order_col: str, index_col: str = "index",
                parts: int | None = None) -> DataFrame:
    """0-based position of each distinct ``order_col`` value inside its group (sorted ascending)."""
    d = df.select(*group_cols, order_col).where(F.col(order_col).isNotNull()).distinct() \
        .withColumn("_one", F.lit(1))
    r = running_counts(d, group_cols, order_col, ["_one"], parts)
    return r.select(*group_cols, order_col, (F.col("cum__one") - 1).cast("int").alias(index_col))


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                    parts: int | None = None, with_stats: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy/pandas default) per group.

    Returns (groups..., p, q). Rows collapse to counts of distinct values first, so
    that a tied value is one row whatever its share; running counts over the
    distinct values then show which value holds each target rank. ``with_stats``
    adds count, mean, sample std, min and max per group (one more partial aggregate).
    """
    out_groups = list(group_cols)
    df, group_cols, _ = _with_group(df, group_cols)
    x = df.select(*group_cols, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = x.groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_c"))
    r = running_counts(counts, group_cols, "_v", ["_c"], parts)
    targets = []
    for p in probs:
        h = (F.col("tot__c") - 1).cast("double") * F.lit(float(p))
        targets += [F.struct(F.lit(float(p)).alias("p"), h.alias("_h"), (f(h) + 1).cast("long").alias("_r"))
                    for f in (F.floor, F.ceil)]
    held = F.filter(F.array(*targets), lambda t: (t["_r"] <= F.col("cum__c")) & (t["_r"] > F.col("cum__c") - F.col("_c")))
    hit = r.select(*group_cols, "_v", F.explode(F.array_distinct(held)).alias("_t")).select(*group_cols, "_v", "_t.*")
    frac = F.col("_h") - F.floor("_h")
    q = (hit.groupBy(*group_cols, "p", "_h").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
         .select(*group_cols, "p", (F.col("_lo") + frac * (F.col("_hi") - F.col("_lo"))).alias("q")))
    if with_stats:
        st = x.groupBy(*group_cols).agg(
            F.count(F.lit(1)).alias("count"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"),
            F.min("_v").alias("min"), F.max("_v").alias("max"))
        q = q.join(st, group_cols)  # a row per group on either side
    return q.select(*out_groups, *[c for c in q.columns if c not in group_cols])
