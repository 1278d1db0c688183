"""Catalogue: evaluation of pooled predictions (the `scored` view)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.functions.exprs import sigmoid
from tally.operators import compare as C
from tally.operators import losses
from tally.operators import metrics as M
from tally.operators import thresholds as TH
from tally.plans import fixtures as fx
from tally.plans.registry import dsql, register
from tally.sources.tables import Tables


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 digits (sums in different orders differ in the last bits)."""
    return df.select(*[F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def S(spark: SparkSession, sf: str) -> DataFrame:
    return fx.scored(Tables(spark, sf))


CM_SQL = """SUM(CASE WHEN {p} AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
       SUM(CASE WHEN {p} AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
       SUM(CASE WHEN NOT ({p}) AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
       SUM(CASE WHEN NOT ({p}) AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS tn"""


def cm_sql(op: str = ">=", t: float = 0.5) -> str:
    return CM_SQL.format(p=f"score {op} {dsql(t)}")


def rates_sql(extra: bool = False) -> str:
    s = """ROUND(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) END, 6) AS accuracy,
       ROUND(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
       ROUND(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
       ROUND(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1"""
    if extra:
        s += """,
       ROUND(CASE WHEN tn + fp = 0 THEN 0 ELSE CAST(tn AS DOUBLE) / (tn + fp) END, 6) AS specificity,
       ROUND(CASE WHEN tn + fn = 0 THEN 0 ELSE CAST(tn AS DOUBLE) / (tn + fn) END, 6) AS npv"""
    return s


def points_sql(src: str, keys: str) -> str:
    """Oracle curve points: per (keys, score) pos, neg, tps, fps, P, N."""
    return f"""g AS (SELECT {keys}, score, SUM(y)::BIGINT AS pos, SUM(1 - y)::BIGINT AS neg FROM {src} GROUP BY {keys}, score),
pts AS (SELECT *, SUM(pos) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
               SUM(neg) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
               SUM(pos) OVER (PARTITION BY {keys}) AS P, SUM(neg) OVER (PARTITION BY {keys}) AS N,
               LAG(pos) OVER (PARTITION BY {keys} ORDER BY score DESC) AS hi_pos,
               LEAD(pos) OVER (PARTITION BY {keys} ORDER BY score DESC) AS lo_pos,
               LEAD(neg) OVER (PARTITION BY {keys} ORDER BY score DESC) AS lo_neg
        FROM g)"""


def auc_sql(keys: str) -> str:
    return f"""auc AS (SELECT {keys}, CASE WHEN MAX(P) > 0 AND MAX(N) > 0 THEN
                 SUM(pos * (CAST(N - fps AS DOUBLE) + neg / CAST(2 AS DOUBLE))) / (CAST(MAX(P) AS DOUBLE) * MAX(N)) END AS auc
        FROM pts GROUP BY {keys})"""


# ------------------------------------------------------------------ M1 / M2 / M3 / M5 / M6
@register("confusion_matrix", "M1 P8", views=("scored",), oracle=f"""
SELECT model, split, {cm_sql('>=')} FROM scored GROUP BY model, split""")
def confusion_matrix(spark, sf):
    return M.confusion(S(spark, sf), ["model", "split"], threshold=0.5, op=">=")


@register("normalized_confusion", "M2", views=("scored",), oracle=f"""
WITH cm AS (SELECT model, {cm_sql('>=')} FROM scored GROUP BY model),
cells AS (SELECT model, 0 AS true_label, 0 AS pred_label, tn AS count, tn + fp AS tot FROM cm
          UNION ALL SELECT model, 0, 1, fp, tn + fp FROM cm
          UNION ALL SELECT model, 1, 0, fn, fn + tp FROM cm
          UNION ALL SELECT model, 1, 1, tp, fn + tp FROM cm)
SELECT model, true_label, pred_label, count,
       ROUND(CASE WHEN tot = 0 THEN 0 ELSE CAST(count AS DOUBLE) / tot END, 6) AS share FROM cells""")
def normalized_confusion(spark, sf):
    cm = M.confusion(S(spark, sf), ["model"], threshold=0.5, op=">=")
    return r6(M.normalized_confusion(cm, ["model"]))


@register("binary_metrics", "M3", views=("scored",), oracle=f"""
WITH cm AS (SELECT model, repeat, {cm_sql('>=')} FROM scored GROUP BY model, repeat)
SELECT model, repeat, tp, fp, fn, tn, {rates_sql()} FROM cm""")
def binary_metrics(spark, sf):
    return r6(M.binary_metrics(S(spark, sf), ["model", "repeat"], threshold=0.5, op=">="))


@register("clinical_rates", "M5 P8", views=("scored",), oracle=f"""
WITH cm AS (SELECT model, split, {cm_sql('>')} FROM scored GROUP BY model, split)
SELECT model, split, tp, fp, fn, tn,
       ROUND(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS sensitivity,
       ROUND(CASE WHEN tn + fp = 0 THEN 0 ELSE CAST(tn AS DOUBLE) / (tn + fp) END, 6) AS specificity,
       ROUND(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS ppv,
       ROUND(CASE WHEN tn + fn = 0 THEN 0 ELSE CAST(tn AS DOUBLE) / (tn + fn) END, 6) AS npv
FROM cm""")
def clinical_rates(spark, sf):
    return r6(M.clinical_rates(M.confusion(S(spark, sf), ["model", "split"], threshold=0.5, op=">")))


@register("classification_report", "M6", views=("scored",), oracle=f"""
WITH cm AS (SELECT model, {cm_sql('>=')} FROM scored GROUP BY model),
r AS (SELECT model, tp, fp, fn, tn,
        CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p1,
        CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r1,
        CASE WHEN tn + fn = 0 THEN 0 ELSE CAST(tn AS DOUBLE) / (tn + fn) END AS p0,
        CASE WHEN tn + fp = 0 THEN 0 ELSE CAST(tn AS DOUBLE) / (tn + fp) END AS r0,
        tp + fn AS s1, tn + fp AS s0 FROM cm),
f AS (SELECT *, CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1_1,
                CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f1_0, s0 + s1 AS n FROM r),
u AS (SELECT model, '0' AS "row", p0 AS precision, r0 AS recall, f1_0 AS f1, s0 AS support FROM f
      UNION ALL SELECT model, '1', p1, r1, f1_1, s1 FROM f
      UNION ALL SELECT model, 'accuracy', NULL, NULL, CASE WHEN n = 0 THEN 0 ELSE CAST(tp + tn AS DOUBLE) / n END, n FROM f
      UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n FROM f
      UNION ALL SELECT model, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f1_0 * s0 + f1_1 * s1) / n, n FROM f)
SELECT model, "row", ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM u""")
def classification_report(spark, sf):
    cm = M.confusion(S(spark, sf), ["model"], threshold=0.5, op=">=")
    return r6(M.classification_report(cm, ["model"]))


# ------------------------------------------------------------------ M4 / M7 / M8
@register("auroc", "M4", views=("scored",), oracle=f"""
WITH {points_sql('scored', 'model, repeat, fold')}, {auc_sql('model, repeat, fold')}
SELECT model, repeat, fold, ROUND(auc, 6) AS auc FROM auc""")
def auroc(spark, sf):
    return r6(M.auroc(S(spark, sf), ["model", "repeat", "fold"]))


@register("roc_curve", "M7", views=("scored",), oracle=f"""
WITH {points_sql('scored', 'model, split')}
SELECT model, split, CAST('Infinity' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
FROM pts GROUP BY model, split
UNION ALL
SELECT model, split, score AS threshold, ROUND(CAST(fps AS DOUBLE) / N, 6) AS fpr, ROUND(CAST(tps AS DOUBLE) / P, 6) AS tpr
FROM pts WHERE hi_pos IS NULL OR lo_pos IS NULL OR lo_pos <> pos OR lo_neg <> neg""")
def roc_curve(spark, sf):
    return r6(M.roc_curve(S(spark, sf), ["model", "split"]))


@register("pr_curve", "M8", views=("scored",), oracle=f"""
WITH {points_sql('scored', 'model')}
SELECT model, score AS threshold,
       ROUND(CASE WHEN tps + fps = 0 THEN 0 ELSE CAST(tps AS DOUBLE) / (tps + fps) END, 6) AS precision,
       ROUND(CASE WHEN P = 0 THEN 1 ELSE CAST(tps AS DOUBLE) / P END, 6) AS recall FROM pts
UNION ALL
SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM pts""")
def pr_curve(spark, sf):
    return r6(M.pr_curve(S(spark, sf), ["model"]))


# ------------------------------------------------------------------ M9 - M14
def grid_sql(g: TH.Grid) -> str:
    return (f"(SELECT CAST(i AS INTEGER) AS i, CAST({g.start} + i * {g.step} AS DOUBLE) / CAST({g.denom} AS DOUBLE) "
            f"AS threshold FROM range(0, {g.count}) r(i))")


def sweep_sql(src: str, keys: str, g: TH.Grid, op: str) -> str:
    on = " AND ".join(f"s.{k.strip()} = k.{k.strip()}" for k in keys.split(","))
    kk = ", ".join(f"k.{k.strip()}" for k in keys.split(","))
    return f"""keys AS (SELECT DISTINCT {keys} FROM {src}),
grid AS (SELECT {kk}, t.i, t.threshold FROM keys k, {grid_sql(g)} t),
cm AS (SELECT {", ".join(f"g.{k.strip()}" for k in keys.split(","))}, g.i, g.threshold,
          SUM(CASE WHEN s.score {op} g.threshold AND s.y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
          SUM(CASE WHEN s.score {op} g.threshold AND s.y = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
          SUM(CASE WHEN NOT (s.score {op} g.threshold) AND s.y = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
          SUM(CASE WHEN NOT (s.score {op} g.threshold) AND s.y = 0 THEN 1 ELSE 0 END)::BIGINT AS tn
       FROM grid g JOIN {src} s ON {on.replace('k.', 'g.')}
       GROUP BY ALL)"""


@register("threshold_sweep", "M9", views=("scored",), oracle=f"""
WITH {sweep_sql('scored', 'model', TH.GRID_A, '>')}
SELECT model, i, threshold, tp, fp, fn, tn, {rates_sql()} FROM cm""")
def threshold_sweep(spark, sf):
    return r6(TH.threshold_sweep(S(spark, sf), ["model"], TH.GRID_A, ">"))


@register("threshold_sweep_inclusive", "M9", views=("scored",), oracle=f"""
WITH {sweep_sql('scored', 'model, split', TH.GRID_B, '>=')}
SELECT model, split, i, threshold, tp, fp, fn, tn, {rates_sql()} FROM cm""")
def threshold_sweep_inclusive(spark, sf):
    return r6(TH.threshold_sweep(S(spark, sf), ["model", "split"], TH.GRID_B, ">="))


@register("best_f1_threshold", "M10", views=("scored",), oracle=f"""
WITH {sweep_sql('scored', 'model', TH.GRID_A, '>')},
m AS (SELECT model, threshold,
             CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1 FROM cm),
top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rk FROM m)
SELECT model, CASE WHEN f1 > 0 THEN threshold ELSE {dsql(0.5)} END AS best_threshold, ROUND(f1, 6) AS best_f1
FROM top WHERE rk = 1""")
def best_f1_threshold(spark, sf):
    sw = TH.threshold_sweep(S(spark, sf), ["model"], TH.GRID_A, ">")
    return r6(TH.best_f1_threshold(sw, ["model"]))


TRAINVAL = "(SELECT * FROM scored WHERE split IN ('train', 'val'))"


@register("pr_best_f1_threshold", "M11 U1", views=("scored",), oracle=f"""
WITH tv AS {TRAINVAL}, {points_sql('tv', 'model')},
m AS (SELECT model, score AS threshold,
             CASE WHEN tps + fps = 0 THEN 0 ELSE CAST(tps AS DOUBLE) / (tps + fps) END AS p,
             CAST(tps AS DOUBLE) / P AS r FROM pts),
f AS (SELECT model, threshold, 2 * p * r / (p + r + 1e-10) AS f1 FROM m),
top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rk FROM f)
SELECT model, threshold, ROUND(f1, 6) AS f1 FROM top WHERE rk = 1""")
def pr_best_f1_threshold(spark, sf):
    tv = S(spark, sf).where(F.col("split").isin("train", "val"))
    return r6(TH.pr_best_f1_threshold(tv, ["model"]))


@register("youden_threshold", "M12", views=("scored",), oracle=f"""
WITH v AS (SELECT * FROM scored WHERE split = 'val'), {points_sql('v', 'model')},
roc AS (SELECT model, CAST('Infinity' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS tpr, CAST(0 AS DOUBLE) AS fpr FROM pts GROUP BY model
        UNION ALL
        SELECT model, score, CAST(tps AS DOUBLE) / P, CAST(fps AS DOUBLE) / N FROM pts
        WHERE hi_pos IS NULL OR lo_pos IS NULL OR lo_pos <> pos OR lo_neg <> neg),
top AS (SELECT *, tpr - fpr AS j, ROW_NUMBER() OVER (PARTITION BY model ORDER BY tpr - fpr DESC, threshold DESC) AS rk FROM roc)
SELECT model, threshold, ROUND(tpr, 6) AS tpr, ROUND(fpr, 6) AS fpr, ROUND(j, 6) AS j FROM top WHERE rk = 1""")
def youden_threshold(spark, sf):
    v = S(spark, sf).where(F.col("split") == "val")
    return r6(TH.youden_threshold(v, ["model"]))


def target_sql(on: str, target: float) -> str:
    col = "CAST(tps AS DOUBLE) / P" if on == "recall" else "CASE WHEN tps + fps = 0 THEN 0 ELSE CAST(tps AS DOUBLE) / (tps + fps) END"
    return f"""t_{on} AS (SELECT model, '{on}' AS target, score AS threshold, ABS({col} - {dsql(target)}) AS dist,
               ROW_NUMBER() OVER (PARTITION BY model ORDER BY ABS({col} - {dsql(target)}), score) AS rk FROM pts)"""


@register("target_threshold", "M13", views=("scored",), oracle=f"""
WITH tv AS {TRAINVAL}, {points_sql('tv', 'model')}, {target_sql('recall', 0.75)}, {target_sql('precision', 0.8)}
SELECT model, target, threshold, ROUND(dist, 6) AS dist FROM t_recall WHERE rk = 1
UNION ALL SELECT model, target, threshold, ROUND(dist, 6) FROM t_precision WHERE rk = 1""")
def target_threshold(spark, sf):
    tv = S(spark, sf).where(F.col("split").isin("train", "val"))
    pr = M.pr_curve(tv, ["model"])
    a = TH.target_threshold(tv, ["model"], 0.75, "recall", pr=pr).select(
        "model", F.lit("recall").alias("target"), "threshold", "dist")
    b = TH.target_threshold(tv, ["model"], 0.8, "precision", pr=pr).select(
        "model", F.lit("precision").alias("target"), "threshold", "dist")
    return r6(a.unionByName(b))


@register("evaluate_thresholds", "M14 M11 M13", views=("scored",), oracle=f"""
WITH tv AS {TRAINVAL}, {points_sql('tv', 'model')}, {target_sql('recall', 0.75)}, {target_sql('precision', 0.8)},
m AS (SELECT model, score AS threshold,
             CASE WHEN tps + fps = 0 THEN 0 ELSE CAST(tps AS DOUBLE) / (tps + fps) END AS p, CAST(tps AS DOUBLE) / P AS r FROM pts),
f AS (SELECT model, threshold, ROW_NUMBER() OVER (PARTITION BY model ORDER BY 2 * p * r / (p + r + 1e-10) DESC, threshold) AS rk FROM m),
th AS (SELECT DISTINCT model, 'default' AS name, {dsql(0.5)} AS threshold FROM scored
       UNION ALL SELECT model, 'best_f1', threshold FROM f WHERE rk = 1
       UNION ALL SELECT model, 'recall_0.75', threshold FROM t_recall WHERE rk = 1
       UNION ALL SELECT model, 'precision_0.80', threshold FROM t_precision WHERE rk = 1),
cm AS (SELECT t.model, t.name, t.threshold,
          SUM(CASE WHEN s.score > t.threshold AND s.y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
          SUM(CASE WHEN s.score > t.threshold AND s.y = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
          SUM(CASE WHEN s.score <= t.threshold AND s.y = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
          SUM(CASE WHEN s.score <= t.threshold AND s.y = 0 THEN 1 ELSE 0 END)::BIGINT AS tn
       FROM th t JOIN (SELECT * FROM scored WHERE split = 'test') s ON s.model = t.model GROUP BY ALL)
SELECT model, name, threshold, tp, fp, fn, tn, {rates_sql()} FROM cm""")
def evaluate_thresholds(spark, sf):
    s = S(spark, sf)
    tv = s.where(F.col("split").isin("train", "val"))
    test = s.where(F.col("split") == "test")
    pr = M.pr_curve(tv, ["model"])
    named = (pr.select("model").distinct().select("model", F.lit("default").alias("name"),
                                                  F.lit(0.5).alias("threshold"))
             .unionByName(TH.pr_best_f1_threshold(tv, ["model"], pr=pr).select(
                 "model", F.lit("best_f1").alias("name"), "threshold"))
             .unionByName(TH.target_threshold(tv, ["model"], 0.75, "recall", pr=pr)
                          .select("model", F.lit("recall_0.75").alias("name"), "threshold"))
             .unionByName(TH.target_threshold(tv, ["model"], 0.8, "precision", pr=pr)
                          .select("model", F.lit("precision_0.80").alias("name"), "threshold")))
    return r6(TH.evaluate_thresholds(test, named, ["model"], op=">"))


# ------------------------------------------------------------------ M15 / M16 / W4 / U2
@register("compare_splits", "M15", views=("scored",), oracle=f"""
WITH cm AS (SELECT model, split, {cm_sql('>')} FROM scored GROUP BY model, split),
{points_sql('scored', 'model, split')}, {auc_sql('model, split')},
r AS (SELECT cm.*, auc.auc FROM cm JOIN auc USING (model, split))
SELECT model, split, tp, fp, fn, tn, {rates_sql()}, ROUND(auc, 6) AS auc, tp + fp + fn + tn AS n,
       ROUND((tp + fn) * CAST(100 AS DOUBLE) / (tp + fp + fn + tn), 6) AS positive_pct,
       ROUND(MAX(CASE WHEN split = 'val' THEN auc END) OVER (PARTITION BY model)
             - MAX(CASE WHEN split = 'test' THEN auc END) OVER (PARTITION BY model), 6) AS val_test_auc_gap
FROM r""")
def compare_splits(spark, sf):
    return r6(C.compare_splits(S(spark, sf), ["model"]))


COMPARE_MODELS_SQL = f"""
WITH cm AS (SELECT model, {cm_sql('>=')} FROM scored GROUP BY model),
{points_sql('scored', 'model')}, {auc_sql('model')},
r AS (SELECT cm.*, auc.auc, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1v
      FROM cm JOIN auc USING (model))
SELECT model, tp, fp, fn, tn, {rates_sql()}, ROUND(auc, 6) AS auc, tp + fp + fn + tn AS n,
       ROUND((tp + fn) * CAST(100 AS DOUBLE) / (tp + fp + fn + tn), 6) AS positive_pct,
       CASE WHEN f1v > {dsql(C.VERDICT_BETTER)} THEN 'better' WHEN f1v > {dsql(C.VERDICT_EQUAL)} THEN 'equal' ELSE 'worse' END AS verdict,
       CAST(ROW_NUMBER() OVER (ORDER BY f1v DESC, model) AS INTEGER) AS rank
FROM r"""


@register("compare_models", "M16 W4 U2", views=("scored",), oracle=COMPARE_MODELS_SQL)
def compare_models(spark, sf):
    return r6(C.compare_models(S(spark, sf)))


# ------------------------------------------------------------------ P7 / M17 / P8
@register("sigmoid_bce", "P7 M17 E10", views=("scored",), oracle=f"""
WITH z AS (SELECT model, y, score * 10 - 5 AS z FROM scored),
w AS (SELECT model, SQRT(CAST(SUM(1 - y) AS DOUBLE) / SUM(y)) AS pw FROM scored GROUP BY model),
l AS (SELECT z.model, y, z.z, w.pw,
             GREATEST(-z.z, 0) + LN(1 + EXP(-ABS(z.z))) AS sp_neg,
             GREATEST(z.z, 0) + LN(1 + EXP(-ABS(z.z))) AS sp_pos,
             1 / (1 + EXP(-z.z)) AS prob FROM z JOIN w USING (model))
SELECT model, ROUND(AVG(prob), 6) AS mean_prob, ROUND(MAX(pw), 6) AS pos_weight,
       ROUND(AVG(pw * y * sp_neg + (1 - y) * sp_pos), 6) AS weighted_bce,
       ROUND(AVG(y * sp_neg + (1 - y) * sp_pos), 6) AS bce
FROM l GROUP BY model""")
def sigmoid_bce(spark, sf):
    """Mean probability and losses of every model's logits."""
    s = S(spark, sf).withColumn("z", F.col("score") * 10 - 5)
    return r6(losses.weighted_bce(s, ["model"], "z", extra=(F.avg(sigmoid("z")).alias("mean_prob"),)))


@register("write_read_report", "S10 M16", views=("scored",), oracle=COMPARE_MODELS_SQL)
def write_read_report(spark, sf):
    """The model comparison written as a CSV report and read back with its schema."""
    import uuid
    from tally.session import checkpoint_dir
    from tally.sources import sinks
    rep = compare_models(spark, sf)
    path = f"{checkpoint_dir(spark).rstrip('/')}/reports/{uuid.uuid4().hex}"
    sinks.write_report(rep, path)
    return spark.read.schema(rep.schema).option("header", True).csv(path)
