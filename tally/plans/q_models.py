"""Catalogue: model fitting, scoring and search (rows-only checks; properties in tests)."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import functions as F

from tally.operators import compare as C
from tally.operators import models as MD
from tally.operators import encode, experiments, linear, search, trees
from tally.operators.encode import Prep
from tally.operators.history import early_stopping
from tally.plans import fixtures as fx
from tally.plans.q_metrics import r6
from tally.plans.q_prep import split_risk
from tally.plans.presets import GRIDS, NESTED, PRESETS, SEARCH, SPACES
from tally.plans.registry import register
from tally.plans.sqlparts import stratified_split_ctes
from tally.session import checkpoint_dir
from tally.sources.tables import Tables

NUM = ["amount", "balance"]
CAT = ["segment", "status"]


def prepared_splits(spark, sf):
    """Split + prep, materialised once (as the reference writes its split files) before any fitting.

    Iterative fits and cross-validation then read the checkpoint instead of
    re-running impute / rank / encode lineage on every pass.
    """
    train, _, test, feats = prepared_three(spark, sf)
    return train, test, feats


def prepared_three(spark, sf):
    """As ``prepared_splits``, with the validation split."""
    checkpoint_dir(spark)
    s = split_risk(spark, sf).select("id", "split", "y", "flag_a", *NUM, *CAT).checkpoint(eager=True)
    prep = Prep(numeric=NUM, categorical=CAT).fit(s.where(F.col("split") == "train"))
    p = prep.transform(s)
    feats = [c for c in p.columns if c not in ("id", "split", "y")]
    train = MD.weighted(p.where(F.col("split") == "train")).checkpoint(eager=True)
    return train, p.where(F.col("split") == "val"), p.where(F.col("split") == "test"), feats


@register("model_logistic", "L1 L7 E8 E10")
def model_logistic(spark, sf):
    """Logistic regression with C = 1 on all features: scores of the test split."""
    train, test, feats = prepared_splits(spark, sf)
    return r6(MD.predict(MD.fit(MD.linear_spec("logistic", {"C": 1.0}, train, feats), train, feats), test))


def newton_sql(rows: str, group: list[str], features: list[str], target: str, weight: str, penalty: float, steps: int) -> str:
    """CTEs ending in ``w``: ``group`` and weights w0.. of ``features`` after so many Newton steps from zero.

    The system of two or three unknowns is solved by determinants; each step carries the weights that it
    starts from, so that no step is computed twice.
    """
    n = len(features)
    keys = "".join(f"{g}, " for g in group)
    out = [f"w_0 AS (SELECT DISTINCT {keys}{', '.join(f'CAST(0 AS DOUBLE) AS w{i}' for i in range(n))} FROM {rows})"]
    for k in range(steps):
        z = " + ".join(f"w{i} * r.{f}" for i, f in enumerate(features))
        on = " AND ".join(f"r.{g} = w_{k}.{g}" for g in group) or "TRUE"
        p = "(1 / (1 + EXP(-z)))"
        sums = [f"SUM({weight} * ({p} - {target}) * {f}) + {penalty} * ANY_VALUE(w{i}) AS g{i}" for i, f in enumerate(features)]
        sums += [f"SUM({weight} * {p} * (1 - {p}) * {features[i]} * {features[j]}) + {penalty if i == j else 0.0} AS h{i}{j}" for i in range(n) for j in range(i, n)]
        out.append(f"s_{k} AS (SELECT {keys}{', '.join(f'ANY_VALUE(w{i}) AS w{i}' for i in range(n))}, {', '.join(sums)} FROM (SELECT r.*, {', '.join(f'w{i}' for i in range(n))}, {z} AS z FROM {rows} r JOIN w_{k} ON {on}) GROUP BY {', '.join(group) or '()'})")
        if n == 2:
            d = "(h00 * h11 - h01 * h01)"
            new = [f"w0 - (h11 * g0 - h01 * g1) / {d}", f"w1 - (h00 * g1 - h01 * g0) / {d}"]
        else:
            d = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
            new = [f"w0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / {d}",
                   f"w1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / {d}",
                   f"w2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / {d}"]
        out.append(f"w_{k + 1} AS (SELECT {keys}{', '.join(f'{x} AS w{i}' for i, x in enumerate(new))} FROM s_{k})")
    out.append(f"w AS (SELECT * FROM w_{steps})")
    return ",\n".join(out)


RISK_TWO = f"""
rows_ AS (
  SELECT id, y, CAST(1 AS DOUBLE) AS one, (amount - AVG(amount) OVER ()) / STDDEV_POP(amount) OVER () AS x1, CAST(flag_a AS DOUBLE) AS x2,
         CAST(COUNT(*) OVER () AS DOUBLE) / (2 * COUNT(*) OVER (PARTITION BY y)) AS c
  FROM risk_raw),
{newton_sql('rows_', [], ['x1', 'x2', 'one'], 'y', 'c', 1.0, 9)}"""


def _two_features(spark, sf):
    """The patient rows with a scaled amount and a flag, and the logistic regression (C = 1) on them."""
    r = encode.standard_scale(fx.risk_raw(Tables(spark, sf)).select("id", "y", "amount", "flag_a"), ["amount"])
    return r, MD.fit(MD.linear_spec("logistic", {"C": 1.0}, r, ["amount", "flag_a"]), r, ["amount", "flag_a"])


@register("logistic_coefficients", "L1", views=("risk_raw",), oracle=f"""
WITH {RISK_TWO}
SELECT 'amount' AS feature, ROUND(w0, 6) AS weight FROM w UNION ALL SELECT 'flag_a', ROUND(w1, 6) FROM w UNION ALL SELECT 'intercept', ROUND(w2, 6) FROM w""")
def logistic_coefficients(spark, sf):
    """Weights of a logistic regression whose intercept is penalised, balanced classes, C = 1."""
    _, m = _two_features(spark, sf)
    return r6(spark.createDataFrame([*zip(m.columns, map(float, m.weights)), ("intercept", m.intercept)], "feature string, weight double"))


@register("logistic_predictions", "L1 L7", views=("risk_raw",), oracle=f"""
WITH {RISK_TWO}
SELECT id, y, ROUND(1 / (1 + EXP(-(w0 * x1 + w1 * x2 + w2))), 6) AS score FROM rows_, w""")
def logistic_predictions(spark, sf):
    """Probabilities of that logistic regression for every row."""
    r, m = _two_features(spark, sf)
    return r6(MD.predict(m, r))


@register("sigmoid_calibration", "L5", views=("scored",), oracle=f"""
WITH rows_ AS (
  SELECT model, score - 0.5 AS x, CAST(1 AS DOUBLE) AS one, CAST(1 AS DOUBLE) AS c,
         CASE WHEN y = 1 THEN (SUM(y) OVER p + 1) / CAST(SUM(y) OVER p + 2 AS DOUBLE) ELSE 1 / CAST(SUM(1 - y) OVER p + 2 AS DOUBLE) END AS t
  FROM scored WHERE repeat = 1 WINDOW p AS (PARTITION BY model)),
{newton_sql('rows_', ['model'], ['x', 'one'], 't', 'c', 0.0, 12)}
SELECT model, ROUND(w0, 6) AS slope, ROUND(w1, 6) AS intercept FROM w""")
def sigmoid_calibration(spark, sf):
    """Sigmoids of three models' margins (score - 0.5), fitted to smoothed targets; all three in one pass."""
    s = fx.scored(Tables(spark, sf)).where("repeat = 1")
    s = s.select("id", "model", "y", (F.col("score") - 0.5).alias("score"), F.substring("model", 2, 9).cast("int").alias("number"))
    names = {r.number: r.model for r in s.select("model", "number").distinct().collect()}
    fitted = linear.fit_many(linear.prepare(s, ["score"], fold="number"), [dataclasses.replace(MD.SIGMOID, only=n) for n in sorted(names)])
    return r6(spark.createDataFrame([(names[n], float(m.weights[0]), m.intercept) for n, m in zip(sorted(names), fitted)], "model string, slope double, intercept double"))


@register("model_gbt", "L2 L7")
def model_gbt(spark, sf):
    """The tuned boosting preset: up to 500 trees, stopped after 50 without a better validation loss."""
    model, _, test, _, _ = _preset(spark, sf, "xgboost_tuned")
    return r6(MD.predict(model, test))


def _preset(spark, sf, name):
    """Fit a named preset on train, boosters with early stopping on the validation split."""
    kind, params, training = PRESETS[name]
    train, val, test, feats = prepared_three(spark, sf)
    est, cols, prepare = MD.estimator(kind, params, train, feats, patience=training.get("early_stopping_rounds"))
    return MD.fit(est, prepare(train), cols, val=prepare(val) if training.get("early_stopping_rounds") else None), prepare(train), prepare(test), cols, est


@register("model_catboost", "L2 L7")
def model_catboost(spark, sf):
    """The tuned oblivious preset on ordered target statistics of the categories, with early stopping; scores of the test split."""
    kind, params, training = PRESETS["catboost_tuned"]
    s = split_risk(spark, sf).select("id", "split", "y", "flag_a", *NUM, *CAT)
    train, rest = s.where(F.col("split") == "train"), s.where(F.col("split") != "train")
    fitted = encode.ordered_target_statistics(train, CAT)
    rest = encode.target_statistics(rest, CAT, train)
    feats = ["flag_a", *NUM, *CAT]
    spec = MD.tree_spec(kind, params, training["early_stopping_rounds"])
    return r6(MD.predict(MD.fit(spec, fitted, feats, val=rest.where(F.col("split") == "val")), rest.where(F.col("split") == "test")))


@register("model_random_forest", "L3 L7")
def model_random_forest(spark, sf):
    model, _, test, _, _ = _preset(spark, sf, "rf_tuned")
    return r6(MD.predict(model, test))


@register("model_svm_platt", "L4 L5 L7")
def model_svm_platt(spark, sf):
    """The linear preset with out-of-fold Platt calibration (five folds, as the library)."""
    model, train, test, cols, est = _preset(spark, sf, "svm_tuned")
    return r6(MD.calibrate(MD.platt_out_of_fold(est, train, cols, k=5), MD.predict(model, test)))


@register("model_svm_rbf", "L4 L7")
def model_svm_rbf(spark, sf):
    """The RBF preset: hinge loss on a kernel map of 256 landmarks, gamma = 'auto'."""
    model, _, test, _, _ = _preset(spark, sf, "svm_baseline")
    return r6(MD.predict(model, test))


@register("model_mlp", "L6 L7 M17")
def model_mlp(spark, sf):
    """The network preset: weighted mini-batches, patience on the validation split; scores of the test split."""
    kind, params, training = PRESETS["tabular_deep_baseline"]
    train, val, test, feats = prepared_three(spark, sf)
    est, _, _ = MD.estimator(kind, params, train, feats, patience=training["patience"])
    return r6(MD.predict(MD.fit(est, train, feats, val=val), test))


@register("model_comparison", "L1 L2 L3 L4 L5 M16 W4")
def model_comparison(spark, sf):
    """Fit the presets of the six models on train, pool their test scores, compare (>= 0.5) and rank by F1.

    The tree models share one set of binned rows and are fitted together; boosters stop early on the validation split.
    """
    train, val, test, feats = prepared_three(spark, sf)
    cols = ["id", "y", *feats]
    rows = train.select(*cols, F.lit(trees.TRAIN).alias("part")).unionByName(val.select(*cols, F.lit(trees.VALIDATE).alias("part")))
    names = ["xgboost_tuned", "lightgbm_baseline", "catboost_tuned", "rf_tuned"]
    specs = [MD.tree_spec(kind, params, training.get("early_stopping_rounds")) for kind, params, training in map(PRESETS.get, names)]
    fitted = trees.fit_many(trees.prepare(rows, feats, part="part"), specs)
    parts = [MD.predict(m, test).withColumn("model", F.lit(n)) for n, m in zip(names, fitted)]
    for name, kind, params in (("LogisticRegression", "logistic", {"C": 1.0}), ("svm_tuned", *PRESETS["svm_tuned"][:2])):
        est, cols, prepare = MD.estimator(kind, params, train, feats)
        scored = MD.predict(MD.fit(est, prepare(train), cols), prepare(test))
        if kind == "svm":
            scored = MD.calibrate(MD.platt_out_of_fold(est, prepare(train), cols, k=5), scored)
        parts.append(scored.withColumn("model", F.lit(name)))
    return r6(C.compare_models(functools.reduce(lambda x, y: x.unionByName(y), parts)))


@register("random_search", "L8 R4")
def random_search(spark, sf):
    """The reference's search: for each of its five models 50 draws of its space, F1 over five folds."""
    train, _, feats = prepared_splits(spark, sf)
    found = [search.search_models(train, feats, kind, space, n_iter=SEARCH["n_iter"], k=SEARCH["cv"], seed=42)[0]
             .select(F.lit(kind).alias("model"), "*") for kind, space in SPACES.items()]
    return r6(functools.reduce(lambda x, y: x.unionByName(y), found))


@register("nested_cv", "L9 R4 E8 E10 U2")
def nested_cv(spark, sf):
    """The reference's six grids, 3 repeats x 10 outer x 3 inner folds: pooled out-of-fold scores, compared per model."""
    from tally.plans.q_prep import numeric_risk
    from tally.operators import clean
    r = clean.impute(numeric_risk(spark, sf), {"balance": "median"}).select("id", "y", "flag_a", *NUM, *CAT)
    scored, _ = search.nested_cv(r, NUM, CAT, ["flag_a"], GRIDS, **NESTED, seed=42)
    return r6(C.compare_models(scored))


EVALUATED = f"""
{stratified_split_ctes('risk_raw', name='sp')},
m AS (SELECT AVG(amount) AS mu, STDDEV_POP(amount) AS sd FROM sp WHERE split = 'train'),
all_ AS (SELECT id, split, y, CAST(1 AS DOUBLE) AS one, (amount - mu) / sd AS x1, CASE WHEN status = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS x2 FROM sp, m),
rows_ AS (SELECT *, CAST(COUNT(*) OVER () AS DOUBLE) / (2 * COUNT(*) OVER (PARTITION BY y)) AS c FROM all_ WHERE split = 'train'),
{newton_sql('rows_', [], ['x1', 'x2', 'one'], 'y', 'c', 1.0, 9)},
p AS (SELECT y, 1 / (1 + EXP(-(w0 * x1 + w1 * x2 + w2))) > 0.5 AS hit FROM all_, w WHERE split = 'test'),
k AS (SELECT COUNT(*) FILTER (hit AND y = 1) AS tp, COUNT(*) FILTER (hit AND y = 0) AS fp, COUNT(*) FILTER (NOT hit AND y = 1) AS fn, COUNT(*) FILTER (NOT hit AND y = 0) AS tn FROM p)"""


@register("evaluate_experiment", "L10 E8 L1 L7 S8 S9", views=("risk_raw",), oracle=f"""
WITH {EVALUATED}
SELECT tp, fp, fn, tn, ROUND((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, ROUND(tp / CAST(tp + fp AS DOUBLE), 6) AS precision,
       ROUND(tp / CAST(tp + fn AS DOUBLE), 6) AS recall FROM k""")
def evaluate_experiment(spark, sf):
    """Fit preparation and logistic regression on train and save both; load them, prepare and score test, write the metrics, read them back."""
    import uuid
    from tally.operators.splits import stratified_split
    from tally.sources import sinks
    path = f"{checkpoint_dir(spark).rstrip('/')}/experiments/{uuid.uuid4().hex}"
    rows = fx.risk_raw(Tables(spark, sf)).withColumn("status", F.when(F.col("status") == "O", "b").otherwise("a"))
    s = stratified_split(rows, "y", "id", 0.2, 0.1, seed=42).select("id", "split", "y", "amount", "status").checkpoint(eager=True)
    train = s.where(F.col("split") == "train")
    prep = Prep(numeric=["amount"], categorical=["status"]).fit(train)
    prep.save(train, f"{path}/prep")
    ready = prep.transform(train)
    feats = [c for c in ready.columns if c not in ("id", "split", "y")]
    MD.fit(MD.linear_spec("logistic", {"C": 1.0}, ready, feats), ready, feats).save(spark, f"{path}/model")
    scored = MD.predict(linear.load(spark, f"{path}/model"), Prep.load(spark, f"{path}/prep").transform(s.where(F.col("split") == "test")))
    sinks.write_metrics(C.report(scored, [], 0.5, ">"), f"{path}/metrics")
    found = spark.read.schema("tp long, fp long, fn long, tn long, accuracy double, precision double, recall double").json(f"{path}/metrics")
    return r6(found)


@register("model_gbt_early_stopping", "L2 W2")
def model_gbt_early_stopping(spark, sf):
    """The tuned boosting preset with early stopping on the validation split: its loss history, and where the callback stops."""
    model, _, _, _, _ = _preset(spark, sf, "xgboost_tuned")
    hist = MD.loss_history(model, spark)
    stop = early_stopping(hist, "run", "iteration", "val_loss", patience=50, mode="min", tie="count").first()
    return r6(hist.withColumns({"stop_iteration": F.lit(stop["stop_epoch"]).cast("int"), "best_iteration": F.lit(stop["best_epoch"]).cast("int")}))


@register("run_experiment", "S11 L4 L6 L8")
def run_experiment(spark, sf):
    """One experiment of each type (ml, dl, tuning) with its preset or the whole search, metrics written and read back."""
    import uuid
    from tally.sources import sinks

    what = experiments.handlers(experiments.Data(*prepared_three(spark, sf)), PRESETS, SPACES, SEARCH)
    root = f"{checkpoint_dir(spark).rstrip('/')}/experiments/{uuid.uuid4().hex}"
    runs = [sinks.Experiment("ml", "risk", "svm_tuned"), sinks.Experiment("dl", "risk", "tabular_deep_baseline"), sinks.Experiment("tuning", "risk", "svm")]
    return r6(functools.reduce(lambda x, y: x.unionByName(y), [sinks.run(e, what, root) for e in runs]))
