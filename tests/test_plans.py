"""Plan shape of every catalogue query (models excluded): no cartesian products, no
nested-loop joins, no row-at-a-time Python UDFs; scans read only the needed columns."""

import re

import pytest

import __spark_entry__ as E
from tally.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
MODEL_QUERIES = {"model_logistic", "model_gbt", "model_random_forest", "model_svm_platt", "model_mlp",
                 "model_comparison", "model_svm_rbf", "random_search", "nested_cv", "evaluate_experiment", "model_gbt_early_stopping", "model_catboost",
                 "logistic_coefficients", "logistic_predictions", "sigmoid_calibration", "run_experiment"}
NAMES = sorted(n for n in QUERIES if n not in MODEL_QUERIES)


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for n in NAMES:
        df = E.queries()[n](spark, SF)
        out[n] = df._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_pairs_products(plans):
    bad = {n: p for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert not bad, sorted(bad)


def test_no_row_python_udfs(plans):
    bad = [n for n, p in plans.items() if "BatchEvalPython" in p]
    assert not bad, bad


def test_confusion_scan_is_pruned(plans):
    p = plans["confusion_matrix"]
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all("o_orderdate" not in s and "c_name" not in s for s in schemas)


FEW_VALUES = {"y", "model", "fold", "repeat", "split", "class", "_g", "segment", "priority", "status", "flag_a", "label", "_level", "param"}
CLASS_QUERIES = ["risk_split_balance", "stratified_kfold", "holdout_from_fold", "split_image_folder", "study_split",
                 "stratified_split_72_8_20", "histogram_density", "boxplot_stats", "sigmoid_bce", "label_encode", "image_manifest", "ordered_target_statistics", "param_value_distribution"]


@pytest.mark.parametrize("name", CLASS_QUERIES)
def test_rows_are_not_joined_on_a_few_values(spark, name):
    """With broadcasts off, no join has keys that a few values (classes, folds, models) would carry."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    keys = [set(re.findall(r"(\w+)#", m)) for m in re.findall(r"SortMergeJoin(?:\(skew=true\))? \[([^\]]*)\]", plan)]
    assert not [k for k in keys if k and k <= FEW_VALUES], keys


def test_a_cluster_session_needs_a_shared_folder():
    from tally.session import checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
