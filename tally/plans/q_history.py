"""Catalogue: training histories, checkpoints, epoch metrics and trial reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.functions.exprs import softplus
from tally.operators import clean, compare, history, thresholds as TH, trials
from tally.plans import fixtures as fx
from tally.plans.q_metrics import r6, sweep_sql
from tally.plans.registry import register
from tally.sources.tables import Tables


def H(spark, sf):
    return fx.history(Tables(spark, sf))


def TR(spark, sf):
    return fx.trials(Tables(spark, sf))


@register("best_so_far", "W1", views=("history",), oracle="""
SELECT run, epoch, val_auc,
       COALESCE(MAX(val_auc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL
                OR val_auc > MAX(val_auc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_new_best,
       MAX(val_auc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
FROM history""")
def best_so_far(spark, sf):
    return history.best_so_far(H(spark, sf), "run", "epoch", "val_auc").select(
        "run", "epoch", "val_auc", "is_new_best", "best_so_far")


@register("best_epoch", "W1", views=("history",), oracle="""
SELECT run, epoch AS best_epoch, val_auc AS best_value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY val_auc DESC, epoch) AS rk FROM history) WHERE rk = 1""")
def best_epoch(spark, sf):
    h = H(spark, sf)
    return h.groupBy("run").agg(F.max_by("epoch", F.struct("val_auc", -F.col("epoch"))).alias("best_epoch"),
                                F.max("val_auc").alias("best_value"))


def _stop_sql(metric: str, patience: int, better: str) -> str:
    """Window form of the early-stopping replay (no NaN, delta 0)."""
    return f"""i AS (SELECT run, epoch, {metric} AS v, ROW_NUMBER() OVER (PARTITION BY run ORDER BY epoch) AS k,
                  {better} AS improved FROM (SELECT *, MIN({metric}) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_min,
                                                   MAX({metric}) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max
                                            FROM history) h),
c AS (SELECT *, k - COALESCE(MAX(CASE WHEN improved THEN k END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS counter FROM i),
s AS (SELECT run, MIN(CASE WHEN counter >= {patience} THEN epoch END) AS stop_epoch FROM c GROUP BY run),
b AS (SELECT c.run, s.stop_epoch, MAX(CASE WHEN improved AND (s.stop_epoch IS NULL OR epoch <= s.stop_epoch) THEN epoch END) AS best_epoch
      FROM c JOIN s ON c.run = s.run GROUP BY c.run, s.stop_epoch)"""


@register("early_stopping", "W2", views=("history",), oracle=f"""
WITH {_stop_sql('val_loss', 5, 'prev_min IS NULL OR val_loss <= prev_min')}
SELECT b.run, CAST(stop_epoch AS INTEGER) AS stop_epoch, CAST(best_epoch AS INTEGER) AS best_epoch, h.val_loss AS best_value
FROM b JOIN history h ON b.run = h.run AND b.best_epoch = h.epoch""")
def early_stopping(spark, sf):
    """Loss callback: patience 5, delta 0, equal loss resets the counter."""
    return history.early_stopping(H(spark, sf), "run", "epoch", "val_loss", patience=5, mode="min")


@register("early_stopping_f1", "W2", views=("history",), oracle=f"""
WITH {_stop_sql('val_auc', 3, 'val_auc > GREATEST(COALESCE(prev_max, 0), 0)')}
SELECT b.run, CAST(stop_epoch AS INTEGER) AS stop_epoch, CAST(best_epoch AS INTEGER) AS best_epoch,
       COALESCE(h.val_auc, 0.0) AS best_value
FROM b LEFT JOIN history h ON b.run = h.run AND b.best_epoch = h.epoch""")
def early_stopping_f1(spark, sf):
    """Notebook variant: maximise, best starts at 0, an equal value adds to the counter; patience 3."""
    return history.early_stopping(H(spark, sf), "run", "epoch", "val_auc", patience=3, mode="max", tie="count")


CKPT_SQL = """ck AS (SELECT run, epoch, 'v' || CAST(CAST(FLOOR((epoch - 1) / CAST(10 AS DOUBLE)) AS INTEGER) + 1 AS VARCHAR) AS version,
         CASE epoch % 4 WHEN 0 THEN run || '_best.pth'
                        WHEN 1 THEN 'checkpoint_epoch_' || CAST(epoch AS VARCHAR) || '.pth'
                        WHEN 2 THEN 'checkpoint_epoch' || CAST(epoch % 10 AS VARCHAR) || '.pth'
                        ELSE run || '_final.pth' END AS filename,
         CASE WHEN CAST(FLOOR((epoch - 1) / CAST(10 AS DOUBLE)) AS INTEGER) = 1 THEN epoch - 10 ELSE epoch END AS hist_len
  FROM history)"""


def checkpoints(spark, sf):
    """Checkpoint records derived from each history row (three sessions; v2 restarted its history)."""
    h = H(spark, sf)
    sess = F.floor((F.col("epoch") - 1) / F.lit(10.0)).cast("int")
    m = F.col("epoch") % 4
    name = (F.when(m == 0, F.concat(F.col("run"), F.lit("_best.pth")))
            .when(m == 1, F.concat(F.lit("checkpoint_epoch_"), F.col("epoch").cast("string"), F.lit(".pth")))
            .when(m == 2, F.concat(F.lit("checkpoint_epoch"), (F.col("epoch") % 10).cast("string"), F.lit(".pth")))
            .otherwise(F.concat(F.col("run"), F.lit("_final.pth"))))
    return h.select("run", "epoch", F.concat(F.lit("v"), (sess + 1).cast("string")).alias("version"),
                    name.alias("filename"),
                    F.when(sess == 1, F.col("epoch") - 10).otherwise(F.col("epoch")).alias("hist_len"))


@register("parse_checkpoint_name", "P9", views=("history",), oracle=f"""
WITH {CKPT_SQL},
p AS (SELECT run, version, filename, contains(lower(filename), 'best') AS is_best,
             CASE WHEN contains(lower(filename), 'best') OR NOT contains(filename, 'epoch') THEN NULL
                  ELSE TRY_CAST(NULLIF(regexp_extract(filename, 'epoch[_]?(\\d+)', 1), '') AS INTEGER) END AS ep FROM ck)
SELECT run, version, filename, is_best, ep AS epoch, COALESCE(NULLIF(ep, 0), 999) AS sort_epoch,
       CAST(ROW_NUMBER() OVER (PARTITION BY run ORDER BY version, COALESCE(NULLIF(ep, 0), 999), filename) AS INTEGER) AS "order"
FROM p""")
def parse_checkpoint_name(spark, sf):
    from pyspark.sql import Window
    p = clean.parse_checkpoint_name(checkpoints(spark, sf), "filename")
    w = Window.partitionBy("run").orderBy("version", "sort_epoch", "filename")
    return p.select("run", "version", "filename", "is_best", "epoch", "sort_epoch",
                    F.row_number().over(w).alias("order"))


@register("merge_history", "W3", views=("history",), oracle=f"""
WITH {CKPT_SQL},
t AS (SELECT *, hist_len > COALESCE(MAX(hist_len) OVER (PARTITION BY run ORDER BY version, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM ck)
SELECT run, version, epoch, hist_len, taken,
       taken AND (version, epoch) = MAX(CASE WHEN taken THEN (version, epoch) END) OVER (PARTITION BY run) AS is_final FROM t""")
def merge_history(spark, sf):
    c = checkpoints(spark, sf)
    return history.merge_history(c, "run", ["version", "epoch"], "hist_len").select(
        "run", "version", "epoch", "hist_len", "taken", "is_final")


@register("epoch_metrics", "M21 M17", views=("slices",), oracle="""
WITH x AS (SELECT CAST(EXTRACT(DAY FROM z_pos) AS INTEGER) AS epoch, slice_id, label, slice_score * 10 - 5 AS z FROM slices),
l AS (SELECT epoch, label * (GREATEST(-z, 0) + LN(1 + EXP(-ABS(z)))) + (1 - label) * (GREATEST(z, 0) + LN(1 + EXP(-ABS(z)))) AS loss,
             CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY epoch ORDER BY slice_id) - 1) / 128.0) AS INTEGER) AS batch FROM x),
b AS (SELECT epoch, batch, AVG(loss) AS bm, COUNT(*) AS bn, SUM(loss) AS bs FROM l GROUP BY epoch, batch)
SELECT epoch, SUM(bn)::BIGINT AS n, ROUND(SUM(bs) / SUM(bn), 6) AS loss_rows, ROUND(AVG(bm), 6) AS loss_batches, COUNT(*) AS n_batches
FROM b GROUP BY epoch""")
def epoch_metrics(spark, sf):
    s = fx.slices(Tables(spark, sf)).withColumn("epoch", F.dayofmonth("z_pos").cast("int"))
    z = F.col("slice_score") * 10 - 5
    loss = F.col("label") * softplus(-z) + (1 - F.col("label")) * softplus(z)
    return r6(history.epoch_metrics(s, "epoch", "slice_id", loss, 128))


@register("cv_summary", "A12 M10", views=("scored", "fits"), oracle=f"""
WITH v AS (SELECT * FROM scored WHERE split = 'val'), {sweep_sql('v', 'model, repeat', TH.GRID_A, '>')},
f AS (SELECT model, repeat, MAX(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END) AS best_f1
      FROM cm GROUP BY model, repeat),
t AS (SELECT model, ROUND(AVG(seconds), 6) AS mean_seconds, COUNT(*) AS n_fits FROM fits GROUP BY model)
SELECT f.model, ROUND(AVG(best_f1), 6) AS mean_best_f1, COUNT(*) AS n_runs, ANY_VALUE(mean_seconds) AS mean_seconds,
       COALESCE(ANY_VALUE(n_fits), 0) AS n_fits FROM f LEFT JOIN t ON f.model = t.model GROUP BY f.model""")
def cv_summary(spark, sf):
    """Mean best validation F1 over the repeats of each model, and its mean training time."""
    tables = Tables(spark, sf)
    v = fx.scored(tables).where(F.col("split") == "val")
    sw = TH.threshold_sweep(v, ["model", "repeat"], TH.GRID_A, ">")
    best = sw.groupBy("model", "repeat").agg(F.max("f1").alias("best_f1"))
    return r6(compare.cv_summary(best, fx.fits(tables), "best_f1", "seconds"))


@register("param_mode", "A10 P10", views=("trials",), oracle="""
WITH c AS (SELECT model, param_a, param_b, COUNT(*) AS count, MIN(run) AS first FROM trials GROUP BY ALL),
r AS (SELECT *, SUM(count) OVER (PARTITION BY model) AS n,
             ROW_NUMBER() OVER (PARTITION BY model ORDER BY count DESC, first) AS rk FROM c)
SELECT model, param_a, param_b, count, CAST(n AS BIGINT) AS n, printf('%d/%d', count, n) AS share,
       printf('%.1f%%', round_even(count * 100.0 / n, 1)) AS pct FROM r WHERE rk = 1""")
def param_mode(spark, sf):
    return trials.param_mode(TR(spark, sf), "model", "run", ["param_a", "param_b"])


@register("param_value_distribution", "A11", views=("trials",), oracle="""
WITH kv AS (SELECT model, 'param_a' AS param, param_a AS value FROM trials
            UNION ALL SELECT model, 'param_b', param_b FROM trials),
c AS (SELECT model, param, value, COUNT(*) AS count FROM kv GROUP BY ALL)
SELECT model, param, value, count, ROUND(count / CAST(SUM(count) OVER (PARTITION BY model, param) AS DOUBLE), 6) AS share FROM c""")
def param_value_distribution(spark, sf):
    return r6(trials.param_value_distribution(TR(spark, sf), "model", ["param_a", "param_b"]))


@register("trial_log", "A13", views=("trials",), oracle="""
SELECT model, run, param_a, param_b,
       CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY model ORDER BY run) - 1) / 10.0) + 1 AS INTEGER) AS repeat_no,
       CAST((ROW_NUMBER() OVER (PARTITION BY model ORDER BY run) - 1) % 10 + 1 AS INTEGER) AS fold_no FROM trials""")
def trial_log(spark, sf):
    return trials.trial_log(TR(spark, sf), "model", "run").select("model", "run", "param_a", "param_b",
                                                                  "repeat_no", "fold_no")
