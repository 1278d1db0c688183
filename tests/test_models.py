"""Models: fitted scorers beat a constant scorer; sinks and the experiment runner."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tally.operators import metrics as M
from tally.plans import q_models
from tally.sources import sinks

SF = "/root/testdata/sf0.001"


def test_logistic_beats_constant(spark):
    scored = q_models.model_logistic(spark, SF).withColumn("g", F.lit("lr"))
    auc = M.auroc(scored, ["g"]).first().auc
    assert auc is not None and auc > 0.55


def test_random_forest_beats_constant(spark):
    scored = q_models.model_random_forest(spark, SF).withColumn("g", F.lit("rf"))
    assert M.auroc(scored, ["g"]).first().auc > 0.55


def test_metrics_and_report_sinks(spark):
    d = tempfile.mkdtemp()
    m = spark.createDataFrame([("lr", 0.5)], "model string, f1 double")
    sinks.write_metrics(m, os.path.join(d, "m"))
    sinks.write_report(m, os.path.join(d, "r"))
    assert spark.read.json(os.path.join(d, "m")).first().f1 == 0.5
    assert spark.read.option("header", True).csv(os.path.join(d, "r")).first().model == "lr"


def test_run_dispatch():
    exp = sinks.Experiment("ml", data="risk", model="xgboost_baseline", params={"n_estimators": 10})
    seen = {}
    out = sinks.run(exp, {"ml": lambda e, path: seen.setdefault("path", path)}, "/out")
    assert out == "/out/xgboost_baseline_risk_default"
    assert json.loads(sinks.config_json(exp))["experiment_type"] == "ml"
    try:
        sinks.run(sinks.Experiment("nope", "d", "m"), {}, "/out")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_gbt_early_stopping_history(spark):
    h = sorted(q_models.model_gbt_early_stopping(spark, SF).collect(), key=lambda r: r.iteration)
    best, stop = h[0].best_iteration, h[0].stop_iteration
    losses = [r.val_loss for r in h]
    assert len(h) <= 500 and [r.iteration for r in h] == list(range(1, len(h) + 1))
    # the first iteration of least loss; the fit ends 50 trees after it, or with the last tree
    assert losses[best - 1] == min(losses) and losses.index(min(losses)) == best - 1
    assert (stop, len(h)) == (best + 50, best + 50) if stop else len(h) == 500


def test_svm_platt_probabilities(spark):
    s = q_models.model_svm_platt(spark, SF)
    r = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert 0.0 <= r.lo <= r.hi <= 1.0
    assert M.auroc(s.withColumn("g", F.lit("svm")), ["g"]).first().auc > 0.55
