"""Model fitting and scoring (L1-L7), with the reference's parameter mapping.

Every fitted model scores into the common scored shape (id, y, score), so the
evaluation operators apply unchanged. Class weights are a weight column (E10).
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators import linear, network, trees
from tally.operators.encode import with_weight


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """P5: feature columns -> one ML vector (NULLs must be imputed first)."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


def logistic(C: float = 1.0, weight_sum: float | None = None, label: str = "y", weight: str | None = "weight",
             max_iter: int = 100) -> LogisticRegression:
    """L1: sklearn C maps to regParam = 1 / (C * sum of weights); no standardisation (liblinear has none)."""
    reg = 1.0 / (C * weight_sum) if weight_sum else 0.0
    lr = LogisticRegression(labelCol=label, regParam=reg, elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter)
    return lr.setWeightCol(weight) if weight else lr


# Defaults of the three boosters and of the forest, by the names of ``trees.Spec``.
DEFAULTS = {
    "xgboost": {"growth": "depth", "n_trees": 100, "learning_rate": 0.3, "max_depth": 6, "min_weight": 1.0, "reg_lambda": 1.0},
    "lightgbm": {"growth": "leaf", "n_trees": 100, "learning_rate": 0.1, "max_depth": None, "num_leaves": 31, "min_rows": 20, "min_weight": 1e-3, "start": "average"},
    "catboost": {"growth": "oblivious", "n_trees": 1000, "learning_rate": 0.03, "max_depth": 6, "reg_lambda": 3.0},
    "random_forest": {"growth": "forest", "n_trees": 100, "max_depth": None, "node_features": "sqrt", "pos_weight": "balanced"},
}
# The libraries' parameter names and what they set.
TREE_PARAMS = {
    "n_estimators": "n_trees", "iterations": "n_trees", "learning_rate": "learning_rate", "max_depth": "max_depth", "depth": "max_depth",
    "num_leaves": "num_leaves", "min_child_samples": "min_rows", "min_samples_leaf": "min_rows", "min_samples_split": "min_split",
    "min_child_weight": "min_weight", "reg_lambda": "reg_lambda", "l2_leaf_reg": "reg_lambda", "reg_alpha": "reg_alpha", "gamma": "min_gain",
    "min_split_gain": "min_gain", "colsample_bytree": "colsample", "feature_fraction": "colsample", "subsample": "subsample",
    "bagging_fraction": "subsample", "bagging_freq": "subsample_every", "max_features": "node_features",
}
# Names that change nothing here: the loss is logistic, weights and seeds are arguments.
NO_EFFECT = {"objective", "eval_metric", "loss_function", "use_label_encoder", "random_state", "n_jobs", "verbose", "class_weight", "probability", "scale_pos_weight"}


def _check(params: dict, known: set[str], what: str) -> None:
    unknown = sorted(params.keys() - known - NO_EFFECT)
    if unknown:
        raise ValueError(f"unknown {what} parameters: {', '.join(unknown)}")


def tree_spec(kind: str, params: dict, patience: int | None = None, seed: int = 42, held_out: int | None = None) -> trees.Spec:
    """L2 / L3: settings of a booster or forest from the library's parameters; unknown keys raise.

    A depth of None or below 1 is no limit. As in the library, the leaf-wise booster draws rows only with
    ``bagging_freq``.
    """
    _check(params, TREE_PARAMS.keys(), kind)
    values = {**DEFAULTS[kind], **{TREE_PARAMS[k]: v for k, v in params.items() if k in TREE_PARAMS}}
    if values["max_depth"] is not None and values["max_depth"] < 1:
        values["max_depth"] = None
    if kind == "lightgbm" and not params.get("bagging_freq"):
        values.update(subsample=1.0, subsample_every=1)
    return trees.Spec(**values, patience=patience, seed=seed, held_out=held_out)


def linear_spec(kind: str, params: dict, train: DataFrame, cols: list[str], held_out: int | None = None, landmarks: tuple | None = None,
                id_col: str = "id") -> linear.LinearSpec:
    """L1 / L4: settings of a logistic regression or an SVM from the library's parameters; unknown keys raise.

    The logistic regression penalises its intercept, the SVM doesn't. Kernels are mapped by
    ``landmarks`` (by default the first of ``train`` in a seeded order).
    """
    if kind == "logistic":
        _check(params, {"C", "max_iter", "solver"}, kind)
        return linear.LinearSpec(C=params.get("C", 1.0), max_iter=params.get("max_iter", 100), held_out=held_out)
    _check(params, {"C", "kernel", "gamma", "degree"}, kind)
    name, kernel = params.get("kernel", "rbf"), None
    if name != "linear":
        kernel = linear.Kernel(name, linear.gamma_of(train, cols, params.get("gamma", "scale")), params.get("degree", 3), landmarks or linear.landmarks(train, cols, id_col=id_col))
    return linear.LinearSpec(loss="hinge", C=params.get("C", 1.0), penalised=False, kernel=kernel, held_out=held_out)


def estimator(kind: str, params: dict, train: DataFrame, cols: list[str], label: str = "y", seed: int = 42, patience: int | None = None):
    """An estimator by model kind and the reference's parameter names.

    Returns (estimator, feature columns, prepare), where ``prepare`` adds the feature
    columns to a frame (kernel features for an SVM, otherwise nothing).
    """
    same = lambda df: df
    if kind in DEFAULTS:
        return tree_spec(kind, params, patience, seed), cols, same
    if kind in ("logistic", "svm"):
        return linear_spec(kind, params, train, cols), cols, same
    if kind == "mlp":
        _check(params, {"hidden", "epochs", "batch", "learning_rate", "decay", "dropout", "pos_weight"}, kind)
        return network.NetworkSpec(**{k: tuple(v) if k == "hidden" else v for k, v in params.items() if k not in NO_EFFECT}, patience=patience, seed=seed), cols, same
    raise ValueError(f"unknown model {kind!r}")


def fit(estimator, train: DataFrame, feature_cols: list[str], label: str = "y", id_col: str = "id", val: DataFrame | None = None):
    """Assemble + estimator as one PipelineModel, or a ``TreeModel`` or ``LinearModel`` of their settings.

    ``val`` holds the validation rows for early stopping of boosted trees.
    """
    if isinstance(estimator, trees.Spec):
        cols = [id_col, label, *feature_cols]
        rows = train.select(*cols, F.lit(trees.TRAIN).alias("_part"))
        if val is not None:
            rows = rows.unionByName(val.select(*cols, F.lit(trees.VALIDATE).alias("_part")))
        return trees.fit_many(trees.prepare(rows, feature_cols, label, id_col, part="_part"), [estimator])[0]
    if isinstance(estimator, network.NetworkSpec):
        return network.fit(train, feature_cols, estimator, val, label, id_col)
    if isinstance(estimator, linear.LinearSpec):
        return linear.fit_many(linear.prepare(train, feature_cols, label, id_col), [estimator])[0]
    asm = VectorAssembler(inputCols=feature_cols, outputCol=estimator.getFeaturesCol(), handleInvalid="error")
    return Pipeline(stages=[asm, estimator]).fit(train)


def predict(model, df: DataFrame, id_col: str = "id", label: str = "y", keep: list[str] | None = None) -> DataFrame:
    """Scored rows (id, y, score = P(class 1)); SVM-like models give their margin as score."""
    if isinstance(model, (trees.TreeModel, linear.LinearModel, network.NetworkModel)):
        return model.predict(df, [id_col, label, *(keep or [])])
    out = model.transform(df)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    else:
        score = vector_to_array("rawPrediction")[1]
    return out.select(id_col, label, *(keep or []), score.alias("score"))


SIGMOID = linear.LinearSpec(weights="none", targets="smoothed", penalty=0.0)


def platt(scored: DataFrame, label: str = "y", id_col: str = "id") -> linear.LinearModel:
    """Sigmoid of an SVM margin ``score``, fitted to smoothed targets by Newton steps."""
    return linear.fit_many(linear.prepare(scored, ["score"], label, id_col), [SIGMOID])[0]


def platt_out_of_fold(spec: linear.LinearSpec, train: DataFrame, feature_cols: list[str], k: int = 5, label: str = "y",
                      id_col: str = "id", seed: int = 42) -> linear.LinearModel:
    """L5 as the library does it: margins for calibration come from k-fold out-of-fold fits.

    Each fold's rows are scored by a model fitted on the other folds (stratified
    folds, R4; all fits in one pass); the sigmoid is fitted on the union of those margins.
    """
    from tally.operators.splits import stratified_kfold
    from tally.session import checkpoint_dir
    checkpoint_dir(train.sparkSession)
    folded = stratified_kfold(train, label, id_col, k=k, seed=seed).checkpoint(eager=True)
    models = linear.fit_many(linear.prepare(folded, feature_cols, label, id_col, fold="fold"), [replace(spec, held_out=f) for f in range(k)])
    parts = [m.margins(folded.where(F.col("fold") == f), [id_col, label]) for f, m in enumerate(models)]
    return platt(reduce(DataFrame.unionByName, parts), label, id_col)


def calibrate(sigmoid: linear.LinearModel, scored: DataFrame) -> DataFrame:
    """``scored`` with probabilities in place of its margins."""
    return sigmoid.predict(scored, [c for c in scored.columns if c != "score"])


def weighted(df: DataFrame, label: str = "y") -> DataFrame:
    """Balanced class weights of ``df`` as column 'weight' (E10)."""
    return with_weight(df, label, "weight")


def loss_history(model: trees.TreeModel, spark: SparkSession, run: str = "gbt") -> DataFrame:
    """Validation loss after every tree of a boosted model, as a history (run, iteration, val_loss)."""
    return spark.createDataFrame([(run, i, v) for i, v in enumerate(model.losses, 1)], "run string, iteration int, val_loss double")
