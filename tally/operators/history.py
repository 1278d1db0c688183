"""Training-history operators.

A history is a small per-run sequence (one row per epoch); per-run windows and
per-run folds over the ordered epoch array are bounded by the number of epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.operators.ordered import running_counts


def best_so_far(hist: DataFrame, run: str, epoch: str, metric: str) -> DataFrame:
    """Running best (strictly greater wins, so the first maximum is kept) and its epoch."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = hist.withColumn("is_new_best", before.isNull() | (F.col(metric) > before))
    best_epoch = F.max(F.when(F.col("is_new_best"), F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumns({"best_so_far": F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                          "best_epoch": best_epoch})


def early_stopping(hist: DataFrame, run: str, epoch: str, metric: str, patience: int, mode: str = "min",
                   delta: float = 0.0, tie: str = "reset") -> DataFrame:
    """Replay early stopping over each run's ordered history.

    mode 'min' / tie 'reset' is the loss callback: the first value sets the best;
    a value that is not better by ``delta`` adds to the counter; an equal value
    (delta 0) resets it; NaN becomes the new best. mode 'max' / tie 'count' is the
    notebook variant: best starts at 0 and only a strictly higher value resets.
    Returns run, stop_epoch (NULL if patience never ran out), best_epoch, best_value.
    """
    seq = hist.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"),
                                                                      F.col(metric).cast("double").alias("v"))))
                                .alias("_h"))
    init = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("best_epoch"),
                    F.lit(0).alias("counter"), F.lit(None).cast("int").alias("stop"))
    if mode == "max":
        init = init.withField("best", F.lit(0.0))

    def step(acc: Column, x: Column) -> Column:
        v = x["v"]
        e = x["e"].cast("int")
        if mode == "min":
            score, best = -v, acc["best"]
            worse = (~F.isnan(score)) & (~F.isnan(best)) & (score < best + F.lit(delta))
            if tie == "count":
                worse = worse | (score == best)
            first = best.isNull()
        else:
            score, best = v, acc["best"]
            worse = ~(score > best + F.lit(delta)) if tie == "count" else (score < best + F.lit(delta))
            first = F.lit(False)
        counter = acc["counter"] + 1
        bumped = F.struct(best.alias("best"), acc["best_epoch"].alias("best_epoch"), counter.alias("counter"),
                          F.when(counter >= patience, e).alias("stop"))
        reset = F.struct(score.alias("best"), e.alias("best_epoch"), F.lit(0).alias("counter"),
                         F.lit(None).cast("int").alias("stop"))
        return F.when(acc["stop"].isNotNull(), acc).when(first, reset).when(worse, bumped).otherwise(reset)

    out = seq.select(run, F.aggregate("_h", init, step).alias("s"))
    best_value = -F.col("s.best") if mode == "min" else F.col("s.best")
    return out.select(run, F.col("s.stop").alias("stop_epoch"), F.col("s.best_epoch").alias("best_epoch"),
                      best_value.alias("best_value"))


def merge_history(ckpts: DataFrame, run: str, order: list[str], length: str) -> DataFrame:
    """Walk checkpoints in order; a checkpoint's history replaces the merged one when longer.

    Adds ``taken``; the final merged history is the last taken row per run.
    """
    w = Window.partitionBy(run).orderBy(*order)
    prev = F.coalesce(F.max(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = ckpts.withColumn("taken", F.col(length) > prev)
    last = F.max(F.when(F.col("taken"), F.struct(*order))).over(Window.partitionBy(run))
    return x.withColumn("is_final", F.col("taken") & (F.struct(*order) == last))


def epoch_metrics(preds: DataFrame, epoch: str, order: str, loss: Column, batch_size: int) -> DataFrame:
    """Per epoch, row-mean loss and mean of batch means (batches of ``batch_size`` in ``order``)."""
    x = preds.withColumn("_loss", loss).withColumn("_one", F.lit(1))
    r = running_counts(x, [epoch], order, ["_one"])
    r = r.withColumn("batch", F.floor((F.col("cum__one") - 1) / batch_size).cast("int"))
    b = r.groupBy(epoch, "batch").agg(F.avg("_loss").alias("_bm"), F.count(F.lit(1)).alias("_bn"),
                                      F.sum("_loss").alias("_bs"))
    return b.groupBy(epoch).agg(
        F.sum("_bn").alias("n"), (F.sum("_bs") / F.sum("_bn")).alias("loss_rows"),
        F.avg("_bm").alias("loss_batches"), F.count(F.lit(1)).alias("n_batches"))
