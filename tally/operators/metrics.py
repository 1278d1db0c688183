"""Evaluation operators over a scored table (M1-M8).

Input: one row per prediction with a 0/1 label and a score, plus any group
keys (model, repeat, fold, split...). Threshold metrics are one grouped
aggregate (partial aggregation map-side, one tiny shuffle). Rank-based outputs
(AUC, ROC and PR curves) first collapse rows to distinct (keys, score) groups
and then use ``ordered.running_counts`` — exact cumulative counts without
funnelling a group through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.exprs import safe_div
from tally.operators.clean import binarize
from tally.operators.ordered import running_counts


def confusion(df: DataFrame, keys: list[str], score: str = "score", label: str = "y",
              threshold: float | Column = 0.5, op: str = ">=", pred: str | None = None) -> DataFrame:
    """M1: tp, fp, fn, tn per group (from a score and threshold, or a ready 0/1 ``pred`` column)."""
    p = F.col(pred) if pred else binarize(score, threshold, op)
    y = F.col(label)
    return df.groupBy(*keys).agg(
        F.sum(((p == 1) & (y == 1)).cast("long")).alias("tp"),
        F.sum(((p == 1) & (y == 0)).cast("long")).alias("fp"),
        F.sum(((p == 0) & (y == 1)).cast("long")).alias("fn"),
        F.sum(((p == 0) & (y == 0)).cast("long")).alias("tn"),
    )


def rate_columns(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    """M3 + M5 from confusion counts; every zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in (tp, fp, fn, tn))
    prec = safe_div(tp, tp + fp)
    rec = safe_div(tp, tp + fn)
    return {
        "accuracy": safe_div(tp + tn, tp + fp + fn + tn),
        "precision": prec,
        "recall": rec,
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        "specificity": safe_div(tn, tn + fp),
        "npv": safe_div(tn, tn + fn),
    }


def with_rates(cm: DataFrame, names: tuple[str, ...] = ("accuracy", "precision", "recall", "f1")) -> DataFrame:
    r = rate_columns()
    return cm.withColumns({n: r[n] for n in names})


def binary_metrics(df: DataFrame, keys: list[str], score: str = "score", label: str = "y",
                   threshold: float = 0.5, op: str = ">=") -> DataFrame:
    """M3: accuracy, precision, recall, F1 (+ the confusion counts)."""
    return with_rates(confusion(df, keys, score, label, threshold, op))


def clinical_rates(cm: DataFrame) -> DataFrame:
    """M5: sensitivity, specificity, PPV, NPV from confusion counts."""
    r = rate_columns()
    return cm.withColumns({"sensitivity": r["recall"], "specificity": r["specificity"],
                           "ppv": r["precision"], "npv": r["npv"]})


def normalized_confusion(cm: DataFrame, keys: list[str]) -> DataFrame:
    """M2: long form (true, pred, count, share of the true-class row)."""
    def cell(t, p, c, tot):
        return F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"), F.col(c).alias("count"),
                        (F.col(tot[0]) + F.col(tot[1])).alias("row_total"))

    cells = F.array(cell(0, 0, "tn", ("tn", "fp")), cell(0, 1, "fp", ("tn", "fp")),
                    cell(1, 0, "fn", ("fn", "tp")), cell(1, 1, "tp", ("fn", "tp")))
    x = cm.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    return x.withColumn("share", safe_div("count", "row_total")).drop("row_total")


def classification_report(cm: DataFrame, keys: list[str]) -> DataFrame:
    """M6: per-class precision/recall/F1/support, then accuracy, macro avg and weighted avg rows."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p1, r1 = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    p0, r0 = safe_div(tn, tn + fn), safe_div(tn, tn + fp)
    f1_1 = safe_div(2 * p1 * r1, p1 + r1)
    f1_0 = safe_div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    acc = safe_div(tp + tn, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support"))

    rows = F.array(
        row("0", p0, r0, f1_0, s0),
        row("1", p1, r1, f1_1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", safe_div(p0 * s0 + p1 * s1, n), safe_div(r0 * s0 + r1 * s1, n),
            safe_div(f1_0 * s0 + f1_1 * s1, n), n),
    )
    return cm.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


# ---------------------------------------------------------------- rank-based
def score_groups(df: DataFrame, keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Distinct (keys, score) with positive / negative counts — the input of every curve."""
    return df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"),
    )


def curve_points(df: DataFrame, keys: list[str], score: str = "score", label: str = "y",
                 neighbours: bool = False, parts: int | None = None) -> DataFrame:
    """Per distinct score: pos, neg, tps/fps (counts with score >= s), P and N of the group."""
    g = score_groups(df, keys, score, label)
    r = running_counts(g, keys, "score", ["pos", "neg"], parts=parts, neighbours=neighbours)
    out = r.withColumns({
        "P": F.col("tot_pos"), "N": F.col("tot_neg"),
        "tps": F.col("tot_pos") - F.col("cum_pos") + F.col("pos"),
        "fps": F.col("tot_neg") - F.col("cum_neg") + F.col("neg"),
    })
    return out.drop("tot_pos", "tot_neg")


def auroc_from_points(pts: DataFrame, keys: list[str]) -> DataFrame:
    """M4 from curve points: sum pos * (negatives below + half the tied) / (P * N); one class -> NULL."""
    below = F.col("N") - F.col("fps")
    s = F.sum(F.col("pos").cast("double") * (below.cast("double") + F.col("neg").cast("double") / 2))
    return pts.groupBy(*keys).agg(
        (s / (F.max("P").cast("double") * F.max("N").cast("double"))).alias("_auc"),
        F.max("P").alias("_P"), F.max("N").alias("_N"),
    ).select(*keys, F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_auc")).alias("auc"))


def auroc(df: DataFrame, keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """M4: exact ROC AUC per group; ties count one half."""
    return auroc_from_points(curve_points(df, keys, score, label), keys)


def roc_curve(df: DataFrame, keys: list[str], score: str = "score", label: str = "y",
              drop_intermediate: bool = True) -> DataFrame:
    """M7: (threshold, fpr, tpr) per group, with the (+inf, 0, 0) start point.

    ``drop_intermediate`` keeps the first and last points and every point where
    the curve changes direction (second difference of fps or tps non-zero).
    """
    pts = curve_points(df, keys, score, label, neighbours=True)
    if drop_intermediate:
        keep = (F.col("prev_pos").isNull() | F.col("next_pos").isNull()
                | (F.col("prev_pos") != F.col("pos")) | (F.col("prev_neg") != F.col("neg")))
        pts = pts.where(keep)
    body = pts.select(*keys, F.col("score").alias("threshold"),
                      safe_div("fps", "N").alias("fpr"), safe_div("tps", "P").alias("tpr"))
    start = pts.select(*keys).distinct().select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(body)


def pr_curve(df: DataFrame, keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """M8: (threshold, precision, recall) per distinct score, plus the closing (NULL, 1, 0) point."""
    pts = curve_points(df, keys, score, label)
    body = pts.select(*keys, F.col("score").alias("threshold"),
                      safe_div("tps", F.col("tps") + F.col("fps")).alias("precision"),
                      F.when(F.col("P") == 0, F.lit(1.0)).otherwise(safe_div("tps", "P")).alias("recall"))
    close = pts.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return body.unionByName(close)
