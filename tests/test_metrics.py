"""Evaluation operators: goldens, hand-made edge cases and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from tally.operators import metrics as M
from tally.operators import thresholds as TH

# Confusion counts behind the published comparison table (pooled 3 x 10 folds,
# score >= 0.5); M3 must give the published accuracy / precision / recall / F1.
GOLDEN = {
    "XGBoost": ((544, 1054, 203, 3599), (0.7672, 0.3404, 0.7282, 0.4640)),
    "LightGBM": ((427, 678, 320, 3975), (0.8152, 0.3864, 0.5716, 0.4611)),
    "CatBoost": ((568, 1130, 179, 3523), (0.7576, 0.3345, 0.7604, 0.4646)),
    "RandomForest": ((348, 540, 399, 4113), (0.8261, 0.3919, 0.4659, 0.4257)),
    "LogisticRegression": ((595, 1216, 152, 3437), (0.7467, 0.3285, 0.7965, 0.4652)),
    "SVM": ((72, 51, 675, 4602), (0.8656, 0.5854, 0.0964, 0.1655)),
}


def scored_df(spark, rows, keys=("g",)):
    cols = [*keys, "y", "score"]
    return spark.createDataFrame(rows, cols)


def test_golden_binary_metrics(spark):
    rows = [(m, *cm) for m, (cm, _) in GOLDEN.items()]
    cm = spark.createDataFrame(rows, "model string, tp long, fp long, fn long, tn long")
    got = {r["model"]: r for r in M.with_rates(cm).collect()}
    for m, (_, want) in GOLDEN.items():
        r = got[m]
        assert (round(r["accuracy"], 4), round(r["precision"], 4), round(r["recall"], 4), round(r["f1"], 4)) == want


def test_confusion_threshold_ops(spark):
    df = scored_df(spark, [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.7), ("a", 0, 0.2)])
    ge = M.confusion(df, ["g"], threshold=0.5, op=">=").first()
    gt = M.confusion(df, ["g"], threshold=0.5, op=">").first()
    assert (ge.tp, ge.fp, ge.fn, ge.tn) == (2, 1, 0, 1)
    assert (gt.tp, gt.fp, gt.fn, gt.tn) == (1, 0, 1, 2)


def test_no_predicted_positives_precision_zero(spark):
    df = scored_df(spark, [("a", 1, 0.1), ("a", 0, 0.2)])
    r = M.binary_metrics(df, ["g"], threshold=0.5).first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0 and r.accuracy == 0.5


def test_auc_all_tied_is_half(spark):
    df = scored_df(spark, [("a", i % 2, 0.3) for i in range(10)])
    assert M.auroc(df, ["g"]).first().auc == pytest.approx(0.5)


def test_auc_one_class_is_null(spark):
    df = scored_df(spark, [("a", 1, 0.1 * i) for i in range(5)])
    assert M.auroc(df, ["g"]).first().auc is None


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_brute_force_and_negation(spark):
    rows = [(((i * 37) % 11) % 2, ((i * 13) % 17) / 17.0) for i in range(200)]
    df = scored_df(spark, [("a", y, s) for y, s in rows])
    auc = M.auroc(df, ["g"]).first().auc
    assert auc == pytest.approx(brute_auc(rows), abs=1e-12)
    neg = M.auroc(df.withColumn("score", -F.col("score")), ["g"]).first().auc
    assert neg == pytest.approx(1 - auc, abs=1e-12)


def test_auc_partition_invariance(spark):
    rows = [("a" if i % 3 else "b", (i * 7) % 2, ((i * 31) % 23) / 23.0) for i in range(300)]
    df = scored_df(spark, rows)
    one = {r.g: r.auc for r in M.auroc(df.repartition(1), ["g"]).collect()}
    seven = {r.g: r.auc for r in M.auroc(df.repartition(7), ["g"]).collect()}
    for k in one:
        assert one[k] == pytest.approx(seven[k], abs=1e-12)
        sub = [(y, s) for g, y, s in rows if g == k]
        assert one[k] == pytest.approx(brute_auc(sub), abs=1e-12)


def test_roc_area_equals_auc(spark):
    rows = [(((i * 37) % 11) % 2, ((i * 13) % 17) / 17.0) for i in range(200)]
    df = scored_df(spark, [("a", y, s) for y, s in rows])
    roc = sorted(((r.fpr, r.tpr) for r in M.roc_curve(df, ["g"]).collect()))
    area = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(roc, roc[1:]))
    assert area == pytest.approx(M.auroc(df, ["g"]).first().auc, abs=1e-12)
    assert any(math.isinf(r.threshold) for r in M.roc_curve(df, ["g"]).collect())


def test_roc_drop_intermediate(spark):
    # scores 0.9..0.6 all positive, then negatives: collinear points dropped
    rows = [("a", 1, 0.9), ("a", 1, 0.8), ("a", 1, 0.7), ("a", 0, 0.3), ("a", 0, 0.2)]
    pts = M.roc_curve(scored_df(spark, rows), ["g"]).collect()
    th = sorted(r.threshold for r in pts)
    assert th == [0.2, 0.7, 0.9, float("inf")]


def test_pr_curve_closing_point(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.8), ("a", 1, 0.4)]
    pr = {r.threshold: (r.precision, r.recall) for r in M.pr_curve(scored_df(spark, rows), ["g"]).collect()}
    assert pr[None] == (1.0, 0.0)
    assert pr[0.4] == pytest.approx((2 / 3, 1.0))
    assert pr[0.9] == pytest.approx((1.0, 0.5))


def test_sweep_equals_confusion(spark):
    rows = [("a", (i * 7) % 2, ((i * 31) % 101) / 100.0) for i in range(400)]
    df = scored_df(spark, rows)
    sw = {r.i: r for r in TH.sweep_counts(df, ["g"], TH.GRID_A, ">").collect()}
    for i in (0, 17, 40, 84):
        t = TH.GRID_A.values()[i]
        cm = M.confusion(df, ["g"], threshold=t, op=">").first()
        assert (sw[i].tp, sw[i].fp, sw[i].fn, sw[i].tn) == (cm.tp, cm.fp, cm.fn, cm.tn)
    swb = {r.i: r for r in TH.sweep_counts(df, ["g"], TH.GRID_B, ">=").collect()}
    for i in (0, 33, 99):
        t = TH.GRID_B.values()[i]
        cm = M.confusion(df, ["g"], threshold=t, op=">=").first()
        assert (swb[i].tp, swb[i].fp) == (cm.tp, cm.fp)


def test_best_f1_default_when_no_positive_f1(spark):
    df = scored_df(spark, [("a", 1, 0.05), ("a", 0, 0.02)])
    sw = TH.threshold_sweep(df, ["g"], TH.GRID_A, ">")
    assert TH.best_f1_threshold(sw, ["g"]).first().best_threshold == 0.5


def test_losses_by_hand(spark):
    from tally.operators import losses
    rows = [("a", 2.0, 1), ("a", -1.0, 0), ("a", 0.5, 0), ("b", 800.0, 0), ("b", -800.0, 1), ("c", 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, z double, y int")

    def plain(z, y, w=1.0):
        return w * math.log1p(math.exp(-z)) if y else math.log1p(math.exp(z))

    got = {r.g: r for r in losses.weighted_bce(df, ["g"], "z", extra=(F.count("*").alias("n"),)).collect()}
    w = math.sqrt(2.0)
    assert got["a"].n == 3 and got["a"].pos_weight == pytest.approx(w)
    assert got["a"].bce == pytest.approx(sum(plain(z, y) for g, z, y in rows if g == "a") / 3)
    assert got["a"].weighted_bce == pytest.approx(sum(plain(z, y, w) for g, z, y in rows if g == "a") / 3)
    assert got["b"].bce == pytest.approx(800.0) and got["c"].weighted_bce is None and got["c"].bce == pytest.approx(plain(1.0, 0))
    assert losses.weighted_bce(df, [], "z").columns == ["pos_weight", "weighted_bce", "bce"]
    masked = {r.g: r for r in losses.masked_bce(df, ["g"], "z", "y", F.col("z") > 0).collect()}
    assert masked["a"].n_real == 2 and masked["a"].loss == pytest.approx((plain(2.0, 1) + plain(0.5, 0)) / 2)
    nan = spark.createDataFrame([(0.9, 1, True), (float("nan"), 1, True), (0.2, 0, True), (0.7, 0, False)], "s double, y int, v boolean")
    r = losses.slice_metrics(nan, "s", "y", "v").first()
    assert (r.n_valid, r.n_nan_dropped, r.tp, r.fp, r.fn, r.tn, r.auc) == (2, 1, 1, 0, 0, 1, 1.0)
