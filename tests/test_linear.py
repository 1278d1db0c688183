"""Linear and kernel models against exact solutions, and many fits against single ones."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.operators import linear as L
from tally.operators import models as MD


def rows(seed, n=500, d=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = ((x**2).sum(1) + 0.7 * rng.normal(size=n) > d).astype(float)
    return L.Block(x, y, np.arange(n) % 4), L.Totals({f: (int((np.arange(n) % 4 == f).sum()), int(y[np.arange(n) % 4 == f].sum())) for f in range(4)}, d)


def solve(block, totals, spec):
    steps = L.newton(spec, totals.dim(spec))
    ask = next(steps)
    while True:
        try:
            ask = steps.send(block.sums(spec, totals, ask))
        except StopIteration as done:
            return done.value[0]


def exact_dual(k, y, c):
    """Decision values of the SVM with kernel matrix ``k`` and bounds ``c``: pairs of largest violation, to 1e-6."""
    s = 2 * y - 1
    a, g = np.zeros(len(y)), -np.ones(len(y))
    q = k * s[:, None] * s
    for _ in range(200_000):
        up = np.where(((s > 0) & (a < c)) | ((s < 0) & (a > 0)), -s * g, -np.inf)
        low = np.where(((s > 0) & (a > 0)) | ((s < 0) & (a < c)), -s * g, np.inf)
        i, j = int(up.argmax()), int(low.argmin())
        if up[i] - low[j] < 1e-6:
            break
        step = (up[i] - low[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c[i] - a[i] if s[i] > 0 else a[i], a[j] if s[j] > 0 else c[j] - a[j])
        a[i] += s[i] * step
        a[j] -= s[j] * step
        g += q[:, i] * s[i] * step - q[:, j] * s[j] * step
    return k @ (a * s) + (up[i] + low[j]) / 2


@pytest.mark.parametrize("name, gamma, c", [("rbf", 0.5, 1.0), ("rbf", 0.2, 10.0), ("poly", 0.3, 1.0)])
def test_kernel_svm_close_to_the_exact_dual(name, gamma, c):
    block, totals = rows(1)
    kernel = L.Kernel(name, gamma, 2, tuple(map(tuple, block.x)))  # all rows are landmarks
    spec = L.LinearSpec(loss="hinge", C=c, penalised=False, kernel=kernel)
    w = solve(block, totals, spec)
    got = block.features(kernel) @ w
    neg, pos = totals.of(spec)
    bounds = c * np.where(block.y == 1, len(block.y) / (2 * pos), len(block.y) / (2 * neg))
    want = exact_dual(kernel.values(block.x, block.x), block.y, bounds)
    assert np.abs(got - want).max() < 0.02 and np.corrcoef(got, want)[0, 1] > 0.9999
    assert ((got > 0) == (want > 0)).mean() > 0.99


def test_fewer_landmarks_come_near():
    block, totals = rows(2)
    values = []
    for n in (500, 150):
        kernel = L.Kernel("rbf", 0.3, 3, tuple(map(tuple, block.x[:n])))
        spec = L.LinearSpec(loss="hinge", penalised=False, kernel=kernel)
        values.append(block.features(kernel) @ solve(block, totals, spec))
    assert ((values[0] > 0) == (values[1] > 0)).mean() > 0.97


def test_gradient_is_that_of_the_objective():
    block, totals = rows(3)
    rng = np.random.default_rng(3)
    for spec, width in ((L.LinearSpec(), 1.0), (L.LinearSpec(targets="smoothed", weights="none"), 1.0), (L.LinearSpec(loss="hinge", held_out=1), 0.3)):
        w, d = rng.normal(size=(2, 4))
        h = 1e-5
        up, down = (block.sums(spec, totals, L.Ask(w + t * d, w + t * d, np.zeros(4), width)) for t in (h, -h))
        here = block.sums(spec, totals, L.Ask(w, w, d, width))
        assert np.isclose((up.losses[0] - down.losses[0]) / (2 * h), here.gradient @ d, rtol=1e-4)
        assert np.allclose((up.gradient - down.gradient) / (2 * h), here.gram @ d, rtol=0.02, atol=0.02 * np.abs(here.gram @ d).max())
        assert np.isclose(here.losses[1], block.sums(spec, totals, L.Ask(w + d, w + d, d, width)).losses[0])


def test_logistic_is_stationary_with_a_penalised_intercept():
    block, totals = rows(4)
    spec = L.LinearSpec(C=0.3)
    w = solve(block, totals, spec)
    g = w + 0.3 * block.sums(spec, totals, L.Ask(w, w, w, 1.0)).gradient
    assert np.abs(g).max() < 1e-8 and w[-1] != 0


def test_separable_and_single_class_rows():
    x = np.linspace(-1, 1, 40)[:, None]
    for y in ((x[:, 0] > 0).astype(float), np.zeros(40)):
        block, totals = L.Block(x, y, np.zeros(40, int)), L.Totals({0: (40, int(y.sum()))}, 1)
        for spec in (L.LinearSpec(C=1000.0), L.LinearSpec(loss="hinge", C=1000.0, penalised=False)):
            assert ((block.features(None) @ solve(block, totals, spec) > 0) == (y == 1)).all()


def table(spark, n=900):
    df = spark.range(n).select("id", *[(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 500.0 - 1).alias(f"x{s}") for s in (1, 2)])
    return df.withColumn("y", (F.col("x1") ** 2 + F.col("x2") ** 2 + F.pmod(F.xxhash64("id", F.lit(7)), F.lit(100)) / 200.0 > 0.9).cast("int")).withColumn("fold", (F.col("id") % 3).cast("int")), ["x1", "x2"]


def test_blocks_and_passes_change_nothing(spark, monkeypatch):
    df, cols = table(spark)
    specs = [MD.linear_spec("logistic", {"C": 2.0}, df, cols, held_out=f) for f in range(3)] + [MD.linear_spec("svm", {"C": 1, "kernel": k, "gamma": "scale"}, df, cols, held_out=0) for k in ("rbf", "linear")]
    whole = L.prepare(df, cols, fold="fold")
    single = [L.fit_many(whole, [s])[0] for s in specs]
    monkeypatch.setattr(L, "BLOCK", 200)
    cut = L.prepare(df, cols, fold="fold")
    assert whole.n_blocks == 1 and cut.n_blocks > 3
    for a, b, c in zip(single, L.fit_many(whole, specs), L.fit_many(cut, specs), strict=True):
        assert (a.weights == b.weights).all() and np.allclose(a.weights, c.weights, atol=1e-4) and a.judged == b.judged
        assert sum(c.judged.values()) and abs(a.f1 - c.f1) < 0.01
    assert single[3].f1 > 0.9  # the classes are a disc and what is around it
    got = single[3].predict(df.where("fold = 0"), ["y"]).select("y", (F.col("score") > 0).cast("int").alias("h")).groupBy("y", "h").count().collect()
    assert {(r.y, r.h): r["count"] for r in got}.get((1, 1), 0) == single[3].judged["tp"]


def test_sigmoid_of_margins(spark):
    df, cols = table(spark)
    spec = MD.linear_spec("svm", {"C": 1.0}, df, cols)
    model = MD.fit(spec, df, cols)
    sigmoid = MD.platt_out_of_fold(spec, df, cols, k=3)
    p = MD.calibrate(sigmoid, MD.predict(model, df))
    assert p.columns == ["id", "y", "score"] and sigmoid.weights[0] > 0
    r = p.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("m"), F.avg("y").alias("y")).first()
    assert 0 <= r.lo < 0.2 < 0.8 < r.hi <= 1 and abs(r.m - r.y) < 0.1


def test_unknown_names_and_bad_rows_raise(spark):
    df, cols = table(spark, 30)
    for kind, params in (("svm", {"kernell": "rbf"}), ("logistic", {"c": 1})):
        with pytest.raises(ValueError):
            MD.linear_spec(kind, params, df, cols)
    with pytest.raises(Exception, match="NULL"):
        L.prepare(df.withColumn("x1", F.lit(None).cast("double")), cols)
    with pytest.raises(ValueError):
        L.fit_many(dataclasses.replace(L.prepare(df, cols), totals=L.Totals({0: (30, 10)}, L.MAX_DIM + 1)), [L.LinearSpec()])


def test_saved_models_and_preparations_score_the_same(spark, tmp_path):
    from tally.operators.encode import Prep
    df, cols = table(spark)
    df = df.withColumn("c", F.concat(F.lit("v"), (F.col("id") % 4).cast("string"))).withColumn("n", (F.col("id") % 3).cast("int"))
    prep = Prep(numeric=["x1", "x2"], categorical=["c", "n"]).fit(df)
    prep.save(df, str(tmp_path / "prep"))
    back = Prep.load(spark, str(tmp_path / "prep"))
    new = df.withColumn("c", F.when(F.col("id") == 5, "unseen").otherwise(F.col("c")))
    assert back._levels == prep._levels == {"c": ["v0", "v1", "v2", "v3"], "n": [0, 1, 2]}
    assert back.transform(new).orderBy("id").collect() == prep.transform(new).orderBy("id").collect()
    ready = prep.transform(df)
    feats = [c for c in ready.columns if c not in ("id", "y", "fold")]
    for kind, params in (("logistic", {"C": 1.0}), ("svm", {"C": 1.0})):
        model = MD.fit(MD.linear_spec(kind, params, ready, feats), ready, feats)
        model.save(spark, str(tmp_path / kind))
        a, b = (m.predict(back.transform(df), ["id"]).orderBy("id").collect() for m in (model, L.load(spark, str(tmp_path / kind))))
        assert np.allclose([r.score for r in a], [r.score for r in b], rtol=1e-9, atol=1e-12)


def test_rows_are_whitened_only_for_the_gram_matrix(spark, monkeypatch):
    """Sums are those of mapped rows; few blocks are fitted in tasks, and passes give the same."""
    x, y = np.random.default_rng(3).normal(size=(300, 3)), np.arange(300) % 3 == 0
    kernel = L.Kernel("rbf", 0.4, 3, tuple(map(tuple, x[:40])))
    block = L.Block(x, y.astype(float), np.zeros(300, int))
    totals, spec = L.Totals({0: (300, 100)}, 3), L.LinearSpec(loss="hinge", kernel=kernel, penalised=False)
    rng = np.random.default_rng(4)
    ask = L.Ask(rng.normal(size=41), rng.normal(size=41), rng.normal(size=41), 0.7)
    got = block.sums(spec, totals, ask)
    want = L.Block(kernel.mapped(x), block.y, block.fold).sums(L.LinearSpec(loss="hinge", penalised=False), totals, ask)
    assert all(np.allclose(getattr(got, c), getattr(want, c), rtol=1e-7, atol=1e-7) for c in ("losses", "gradient", "gram", "judged"))
    assert block.cache[kernel][0].shape == (300, 40)  # the values are kept, not mapped rows

    df, cols = table(spark)
    monkeypatch.setattr(L, "BLOCK", 200)
    cut = L.prepare(df, cols, fold="fold")
    specs = [MD.linear_spec("svm", {"C": 1, "kernel": k, "gamma": "scale"}, df, cols, held_out=f) for f in range(3) for k in ("rbf", "linear")]
    jobs = []
    monkeypatch.setattr(L, "_in_passes", lambda *a, real=L._in_passes: jobs.append(1) or real(*a))
    tasks = L.fit_many(cut, specs)
    assert cut.n_blocks > 3 and not jobs
    monkeypatch.setattr(L, "WHOLE", 1)
    for a, b in zip(tasks, L.fit_many(cut, specs), strict=True):
        assert np.allclose(a.weights, b.weights, atol=1e-4) and abs(a.f1 - b.f1) < 0.01
    assert jobs


def test_fits_of_one_kernel_share_their_products(monkeypatch):
    """Scores and gradients of many fits come from one pass over the kernel values, and are those of each fit alone."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    block = L.Block(x, (x[:, 0] > 0.4).astype(float), np.arange(300) % 3)
    totals = L.Totals({f: (100, int(block.y[block.fold == f].sum())) for f in range(3)}, 3)
    for kernel in (L.Kernel("rbf", 0.5, 3, tuple(map(tuple, x[:40]))), None):
        dim = 40 if kernel else 3
        asks = []
        for i, (loss, held_out, only) in enumerate((("hinge", 0, None), ("hinge", 2, None), ("logistic", None, None), ("hinge", None, 1))):
            w, d = rng.normal(size=dim + 1), rng.normal(size=dim + 1) * (i != 1)
            asks.append((L.LinearSpec(loss=loss, kernel=kernel, held_out=held_out, only=only), L.Ask(w + d if i < 3 else 2 * w, w, d, 0.7)))
        calls = []
        monkeypatch.setattr(L.Kernel, "values", lambda self, *a, real=L.Kernel.values: calls.append(1) or real(self, *a))
        block.cache = {}
        got = block.many(asks, totals)
        assert len(calls) == (2 if kernel else 0)  # of the rows, and of the landmarks
        monkeypatch.undo()
        f, c = block.features(kernel), np.where(block.y == 1, 150 / block.y.sum(), 150 / (300 - block.y.sum()))
        for (spec, ask), s in zip(asks, got, strict=True):
            alone = block.sums(spec, totals, ask)
            assert all(np.allclose(getattr(s, k), getattr(alone, k)) for k in ("losses", "gradient", "gram", "judged"))
        first, second = L.slopes(asks[2][0], f @ asks[2][1].weights, block.y, 0.7)
        assert np.allclose(got[2].gradient, f.T @ (c * first)) and np.allclose(got[2].gram, (f * (c * second)[:, None]).T @ f)
        z = f @ asks[0][1].weights
        assert got[0].judged.tolist()[:2] == [100, ((z > 0) & (block.y == 1) & (block.fold == 0)).sum()]
