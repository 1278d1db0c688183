"""Histogram trees against brute force, and many fits against single ones."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.operators import models as MD
from tally.operators import trees as T


def data(seed, n=160, bins=(5, 3, 2, 8)):
    rng = np.random.default_rng(seed)
    columns = np.stack([rng.integers(0, b, n) for b in bins]).astype(np.uint8)
    y = (rng.random(n) < 0.15 + 0.5 * (columns[0] > 2) * (columns[2] == 1)).astype(float)
    block = T.Block(columns, y, T._mixed(np.arange(n), seed), np.arange(n) % 3, np.zeros(n, int))
    folds = {f: (int((block.fold == f).sum()), int(y[block.fold == f].sum())) for f in range(3)}
    return block, T.Totals(n, folds, T.Layout(list(bins)))


def score(g, h, spec):
    g = np.sign(g) * max(abs(g) - spec.reg_alpha, 0)
    return g * g / (h + spec.reg_lambda) if h + spec.reg_lambda > 0 else 0.0


def brute_gains(block, rows, g, h, spec, bins):
    """Gain of every allowed (feature, cut) for the rows of a node."""
    out = {}
    for f, b in enumerate(bins):
        for cut in range(b - 1):
            left = rows[block.columns[f, rows] <= cut]
            right = rows[block.columns[f, rows] > cut]
            if len(left) < max(1, spec.min_rows) or len(right) < max(1, spec.min_rows) or min(h[left].sum(), h[right].sum()) < spec.min_weight:
                continue
            gain = sum(score(g[x].sum(), h[x].sum(), spec) for x in (left, right)) - score(g[rows].sum(), h[rows].sum(), spec)
            if gain > 1e-6 and gain >= spec.min_gain:
                out[f, cut] = gain
    return out


def best_of(gains):
    """The highest gain; of equal ones the first feature and lowest cut."""
    top = max(gains.values())
    return min(k for k, v in gains.items() if v >= top - 1e-12)


def first_tree(block, totals, spec):
    trees, _, _ = T._fit_in_block(block, 0, spec, totals)
    block.committed(0, spec, totals, [])
    g, h, _ = block.gradients(0, spec, totals, 0)
    block.scores.clear()
    return trees[0], g, h


def leaves(tree, block):
    node = tree.route(block.columns)
    return {n: np.flatnonzero(node == n) for n in np.unique(node)}


SPECS = [T.Spec(n_trees=1, reg_lambda=1.0), T.Spec(n_trees=1, reg_lambda=0.5, reg_alpha=1.5, min_gain=0.4), T.Spec(n_trees=1, min_rows=12, min_weight=2.5), T.Spec(n_trees=1, reg_lambda=3.0, pos_weight="none", start="average")]


@pytest.mark.parametrize("spec", SPECS)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels_against_brute_force(spec, seed):
    block, totals = data(seed)
    tree, g, h = first_tree(block, totals, T.Spec(**{**spec.__dict__, "max_depth": 3}))

    def check(node, rows, depth):
        gains = brute_gains(block, rows, g, h, spec, totals.layout.bins) if depth < 3 else {}
        assert np.allclose(tree.sums[node], [g[rows].sum(), h[rows].sum(), len(rows)], atol=1e-9)
        if tree.left[node] < 0:
            assert not gains
            return
        f, cut = best_of(gains)
        assert (tree.feature[node], tree.bin[node]) == (f, cut)
        down = block.columns[f, rows] <= cut
        check(tree.left[node], rows[down], depth + 1)
        check(tree.left[node] + 1, rows[~down], depth + 1)

    check(0, np.arange(len(block.y)), 0)
    value = tree.values(spec)[tree.route(block.columns)]
    for rows in leaves(tree, block).values():
        shrunk = np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - spec.reg_alpha, 0)
        assert np.allclose(value[rows], -0.1 * shrunk / (h[rows].sum() + spec.reg_lambda))


@pytest.mark.parametrize("num_leaves, depth", [(2, None), (5, None), (9, None), (9, 3), (4, 2), (31, None)])
@pytest.mark.parametrize("seed", [4, 5])
def test_leaf_wise_growth_is_greedy(num_leaves, depth, seed):
    block, totals = data(seed, 300)
    spec = T.Spec(growth="leaf", n_trees=1, num_leaves=num_leaves, max_depth=depth, min_rows=5)
    tree, g, h = first_tree(block, totals, spec)
    open_leaves, done = [(np.arange(len(block.y)), 0)], []
    while len(open_leaves) + len(done) < num_leaves:  # split the open leaf of the highest gain, one by one
        options = [(max(x.values()), -i, best_of(x)) for i, (rows, d) in enumerate(open_leaves) if depth is None or d < depth for x in [brute_gains(block, rows, g, h, spec, totals.layout.bins)] if x]
        if not options:
            break
        _, i, (f, cut) = max(options)
        rows, d = open_leaves.pop(-i)
        down = block.columns[f, rows] <= cut
        open_leaves += [(rows[down], d + 1), (rows[~down], d + 1)]
    want = {tuple(rows.tolist()) for rows, _ in open_leaves}
    assert {tuple(rows.tolist()) for rows in leaves(tree, block).values()} == want
    if num_leaves < 10 and depth is None:
        assert len(want) == num_leaves


@pytest.mark.parametrize("seed", [6, 7])
def test_oblivious_trees_against_brute_force(seed):
    block, totals = data(seed)
    spec = T.Spec(growth="oblivious", n_trees=1, max_depth=3, reg_lambda=2.0)
    tree, g, h = first_tree(block, totals, spec)
    groups, node = [np.arange(len(block.y))], [0]
    for _ in range(3):
        total = {}
        for f, cut in itertools.chain.from_iterable(((f, c) for c in range(b - 1)) for f, b in enumerate(totals.layout.bins)):
            parts = [(rows, rows[block.columns[f, rows] <= cut], rows[block.columns[f, rows] > cut]) for rows in groups]
            if any(len(a) and len(b) for _, a, b in parts):
                total[f, cut] = sum(score(g[a].sum(), h[a].sum(), spec) + score(g[b].sum(), h[b].sum(), spec) - score(g[r].sum(), h[r].sum(), spec) for r, a, b in parts)
        f, cut = best_of(total)
        assert {(tree.feature[n], tree.bin[n]) for n in node} == {(f, cut)}
        node = [c for n in node for c in (tree.left[n], tree.left[n] + 1)]
        groups = [x for rows in groups for x in (rows[block.columns[f, rows] <= cut], rows[block.columns[f, rows] > cut])]
    assert (tree.left[node] < 0).all()


def test_forest_trees_grow_until_pure():
    block, totals = data(8, 400, (200, 90, 2, 8))
    spec = T.Spec(growth="forest", n_trees=6, max_depth=None, node_features="sqrt")
    trees, _, judged = T._fit_in_block(block, 0, spec, totals)
    assert max(len(t.left) for t in trees) > 60 and judged["n"] == 0
    for i, t in enumerate(trees):
        wy, w, seen = block.gradients(0, spec, totals, i)
        node = t.route(block.columns)
        for n in np.unique(node[seen]):
            rows = np.flatnonzero((node == n) & seen)
            same = (block.columns[:, rows] == block.columns[:, rows[:1]]).all()
            assert same or wy[rows].sum() in (0.0, w[rows].sum())  # pure, or nothing left to split by
        assert 0.55 < seen.mean() < 0.72  # Poisson(1): 1 - 1/e of the rows
    assert len({tuple(t.feature) for t in trees}) == 6
    limited = T.Spec(growth="forest", n_trees=4, max_depth=None, min_split=30, min_rows=4)
    for i, t in enumerate(T._fit_in_block(block, 0, limited, totals)[0]):
        rows = t.sums[:, 2]
        inner = t.left >= 0
        assert (rows[inner] >= 30).all() and (rows >= 4).all()
        assert rows[~inner].sum() == block.gradients(0, limited, totals, i)[2].sum()


def test_draws_of_rows_and_features():
    block, totals = data(9, 2000)
    spec = T.Spec(n_trees=4, subsample=0.6, subsample_every=2, colsample=0.5)
    seen = [block.committed(0, spec, totals, []) or block.gradients(0, spec, totals, t)[2] for t in range(4)]
    assert (seen[0] == seen[1]).all() and (seen[0] != seen[2]).any() and abs(seen[0].mean() - 0.6) < 0.05
    block.scores.clear()
    trees, _, _ = T._fit_in_block(block, 0, spec, totals)
    for t in trees:
        assert len(set(t.feature[t.left >= 0].tolist())) <= 2


def table(spark, n=1500):
    df = spark.range(n).select("id", *[(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(m)) * 0.5).alias(f"x{s}") for s, m in ((1, 400), (2, 3), (3, 2), (4, 90))])
    p = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(100))
    return df.withColumn("y", (p < F.when(F.col("x1") > 130, 55).otherwise(12)).cast("int")).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(3)).cast("int")), ["x1", "x2", "x3", "x4"]


def same(a, b):
    return len(a.trees) == len(b.trees) and all((s.feature == t.feature).all() and (s.bin == t.bin).all() and (s.left == t.left).all() and (s.sums == t.sums).all() for s, t in zip(a.trees, b.trees, strict=True)) and a.judged == b.judged and a.losses == b.losses


def test_blocks_and_lockstep_change_nothing(spark, monkeypatch):
    """Fits of all kinds together over many blocks equal fits one by one on one block, to the last bit."""
    df, cols = table(spark)
    specs = [T.Spec(n_trees=7, max_depth=3, reg_lambda=1.0, subsample=0.8, colsample=0.8, held_out=0), T.Spec(n_trees=5, max_depth=2, held_out=1, patience=2), T.Spec(growth="leaf", num_leaves=6, max_depth=None, n_trees=4, start="average", held_out=2),
             T.Spec(growth="oblivious", n_trees=3, max_depth=3, reg_lambda=3.0), T.Spec(growth="forest", n_trees=6, max_depth=None, node_features="sqrt", pos_weight="balanced", held_out=0)]
    whole = T.prepare(df, cols, fold="fold")
    assert whole.n_blocks == 1
    single = [T.fit_many(whole, [s])[0] for s in specs]
    together = T.fit_many(whole, specs)
    monkeypatch.setattr(T, "BLOCK", 400)
    monkeypatch.setattr(T, "CHECKPOINT", 3)
    cut = T.prepare(df, cols, fold="fold")
    assert cut.n_blocks > 3
    lockstep = T.fit_many(cut, specs)
    for a, b, c in zip(single, together, lockstep, strict=True):
        assert same(a, b) and same(a, c) and a.trees


def test_judged_rows_are_scored_as_predictions(spark):
    df, cols = table(spark)
    spec = T.Spec(n_trees=20, max_depth=3, held_out=1)
    model = T.fit_many(T.prepare(df, cols, fold="fold"), [spec])[0]
    got = model.predict(df.where("fold = 1"), ["y"]).agg(F.sum(((F.col("score") > 0.5) & (F.col("y") == 1)).cast("int")), F.sum(((F.col("score") > 0.5) & (F.col("y") == 0)).cast("int")), F.sum(((F.col("score") <= 0.5) & (F.col("y") == 1)).cast("int"))).first()
    assert tuple(got) == (model.judged["tp"], model.judged["fp"], model.judged["fn"]) and model.f1 > 0.3


def test_save_and_load(spark, tmp_path):
    df, cols = table(spark, 300)
    for kind, params in (("lightgbm", {"n_estimators": 3}), ("random_forest", {"n_estimators": 3, "max_depth": None})):
        model = T.fit_many(T.prepare(df, cols), [MD.tree_spec(kind, params)])[0]
        model.save(spark, str(tmp_path / kind))
        back = T.load(spark, str(tmp_path / kind))
        assert back.spec == model.spec and back.start == model.start
        assert [r.score for r in back.predict(df, ["id"]).orderBy("id").collect()] == [r.score for r in model.predict(df, ["id"]).orderBy("id").collect()]


def test_early_stopping(spark):
    df, cols = table(spark)
    model = MD.fit(T.Spec(n_trees=60, learning_rate=0.5, max_depth=6, patience=4), df.where("fold > 0"), cols, val=df.where("fold = 0"))
    best = int(np.argmin(model.losses)) + 1
    assert len(model.trees) == best and len(model.losses) == best + 4 < 60


def test_parameter_names():
    s = MD.tree_spec("lightgbm", {"n_estimators": 10, "num_leaves": 20, "max_depth": -1, "subsample": 0.7, "reg_alpha": 0.5, "min_child_samples": 7})
    assert (s.growth, s.num_leaves, s.max_depth, s.subsample, s.reg_alpha, s.min_rows) == ("leaf", 20, None, 1.0, 0.5, 7)
    assert MD.tree_spec("lightgbm", {"bagging_fraction": 0.8, "bagging_freq": 5}).subsample_every == 5
    assert MD.tree_spec("catboost", {"iterations": 5, "depth": 4, "l2_leaf_reg": 7}).reg_lambda == 7
    assert MD.tree_spec("random_forest", {"max_depth": None, "min_samples_split": 5}).min_split == 5
    with pytest.raises(ValueError):
        MD.tree_spec("xgboost", {"n_estimatorz": 1})


def test_null_features_raise(spark):
    df, cols = table(spark, 50)
    with pytest.raises(Exception, match="NULL"):
        T.prepare(df.withColumn("x1", F.when(F.col("id") > 3, F.col("x1"))), cols)


def test_constant_and_single_class_tables(spark):
    df = spark.range(30).select("id", F.lit(1.0).alias("x1"), F.lit(0).alias("y"))
    for kind in MD.DEFAULTS:
        model = MD.fit(MD.tree_spec(kind, {"n_estimators": 2} if kind != "catboost" else {"iterations": 2}), df, ["x1"])
        assert all(r.score <= 0.5 for r in model.predict(df, ["id"]).collect())


def test_a_table_of_few_blocks_is_fitted_in_tasks(spark, monkeypatch):
    """Up to WHOLE blocks' rows there is no job for every level; beyond, sums come the same by shuffle and on the driver."""
    df, cols = table(spark)
    specs = [T.Spec(n_trees=5, max_depth=3, reg_lambda=1.0), T.Spec(growth="forest", n_trees=5, max_depth=4)]
    monkeypatch.setattr(T, "BLOCK", 600)
    few = T.prepare(df, cols, fold="fold")
    assert few.n_blocks == 1
    monkeypatch.setattr(T, "BLOCK", 300)
    cut = T.prepare(df, cols, fold="fold")
    assert cut.n_blocks > 3
    jobs = []
    monkeypatch.setattr(T, "_in_passes", lambda *a, real=T._in_passes: jobs.append(1) or real(*a))
    want = T.fit_many(few, specs)
    assert not jobs
    for size in (T.SMALL, 0):
        monkeypatch.setattr(T, "SMALL", size)
        assert all(same(a, b) for a, b in zip(want, T.fit_many(cut, specs), strict=True))
    assert len(jobs) == 2


def test_a_table_that_a_task_can_hold_is_one_block(spark, monkeypatch):
    """By rows and by bytes: 200,000 rows of few features need no job for every level, wide ones and more rows are cut into small blocks."""
    df = spark.range(200_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(50))).alias("x1"), (F.col("id") % 2).alias("y"))
    assert T.prepare(df, ["x1"]).n_blocks == 1
    monkeypatch.setattr(T, "HELD", 200_000 * 33 - 1)
    assert T.prepare(df, ["x1"]).n_blocks >= 200_000 / T.CUT
    monkeypatch.undo()
    df, cols = table(spark)
    monkeypatch.setattr(T, "CUT", 300)
    assert T.prepare(df, cols).n_blocks == 1
    monkeypatch.setattr(T, "BLOCK", 499)
    assert T.prepare(df, cols).n_blocks > T.WHOLE


def test_a_forest_alone_grows_many_trees_in_a_pass(spark, monkeypatch):
    """A single forest's passes don't grow with every four trees; dense and sparse sums are merged alike."""
    df, cols = table(spark)
    monkeypatch.setattr(T, "BLOCK", 300)
    data = T.prepare(df, cols)
    assert data.n_blocks > T.WHOLE
    passes = []
    monkeypatch.setattr(T._Sent, "unpersist", lambda self, real=T._Sent.unpersist: passes.append(1) or real(self))
    model, = T.fit_many(data, [T.Spec(growth="forest", n_trees=16, max_depth=3, node_features="sqrt")])
    assert len(model.trees) == 16 and len(passes) <= 5
    rng = np.random.default_rng(0)
    for step in (1, 1000):
        a, b = ((np.sort(rng.choice(200, 90, replace=False)) * step, rng.integers(1, 9, (90, 3)).astype(float)) for _ in range(2))
        keys, sums = T._merged(a, b)
        want = {}
        for k, v in [*zip(a[0], a[1]), *zip(b[0], b[1])]:
            want[int(k)] = want.get(int(k), 0) + v
        assert keys.tolist() == sorted(want) and np.array_equal(sums, np.array([want[k] for k in sorted(want)]))
    assert len(T._merged((np.zeros(0, np.int64), np.zeros((0, 3))), (np.zeros(0, np.int64), np.zeros((0, 3))))[0]) == 0


def test_fits_of_fewer_trees_are_beginnings(spark, monkeypatch):
    """Fits that differ in the number of trees are made once, and equal fits by themselves."""
    df, cols = table(spark)
    data_ = T.prepare(df, cols, fold="fold")
    specs = [T.Spec(n_trees=n, max_depth=3, subsample=0.8, held_out=1) for n in (3, 7, 7)] + [T.Spec(growth="forest", n_trees=n, max_depth=4, held_out=0) for n in (6, 2)] \
        + [T.Spec(growth="leaf", n_trees=n, num_leaves=5, max_depth=None, held_out=0) for n in (2, 4)] + [T.Spec(n_trees=4, max_depth=2, patience=2, held_out=1)] * 2
    alone = [T.fit_many(data_, [s])[0] for s in specs]
    tasks = []
    real = data_.spark.sparkContext.parallelize
    monkeypatch.setattr(data_.spark.sparkContext, "parallelize", lambda x, n: tasks.append(n) or real(x, n))
    got = T.fit_many(data_, specs)
    assert tasks == [4]
    for a, b in zip(alone, got, strict=True):
        assert same(a, b) and a.losses == b.losses and a.judged == b.judged


GROWN = [T.Spec(n_trees=4, max_depth=4, reg_lambda=1.0, held_out=1), T.Spec(n_trees=4, max_depth=4, subsample=0.7, held_out=0), T.Spec(growth="leaf", n_trees=4, num_leaves=9, max_depth=5, min_rows=5, held_out=1),
         T.Spec(growth="oblivious", n_trees=4, max_depth=4, reg_lambda=2.0, held_out=2), T.Spec(growth="forest", n_trees=4, max_depth=4, node_features="sqrt", held_out=0)]


@pytest.mark.parametrize("spec", GROWN)
def test_of_two_children_one_is_counted(spec, monkeypatch):
    """Rows go into sums once a tree and then at most half of them a level; the sums are those of counting all rows."""
    block, totals = data(11, 3000, (40, 3, 2, 30))
    trees, losses, judged = T._fit_in_block(block, 0, spec, totals)
    monkeypatch.setattr(T, "KEPT", 0)
    plain = T._fit_in_block(block, 0, spec, totals)
    assert (losses, judged) == plain[1:] and all(np.array_equal(a.sums, b.sums) and np.array_equal(a.left, b.left) and np.array_equal(a.bin, b.bin) for a, b in zip(trees, plain[0], strict=True))
    monkeypatch.undo()
    counted = []
    monkeypatch.setattr(np, "bincount", lambda x, weights=None, n=0, real=np.bincount: counted.append(len(x)) or real(x, weights, n))
    T._fit_in_block(block, 0, spec, totals)
    each = 3 * len(totals.layout.bundles)  # gradient, hessian and rows of each bundle
    asks = counted[::each]
    rows = max(asks)
    assert sum(asks) > rows and all(n <= rows / 2 for n in asks if n < 0.8 * rows)
    assert sum(n >= 0.8 * rows for n in asks) == spec.n_trees


@pytest.mark.parametrize("spec", GROWN)
def test_rows_of_a_finished_tree_are_known(spec, monkeypatch):
    """Boosting in a task sends no training row through a tree again; scores are those of the trees from the root."""
    block, totals = data(12, 3000, (40, 3, 2, 30))
    again = []
    monkeypatch.setattr(T.Tree, "route", lambda self, columns, at=None, *x, real=T.Tree.route: (at is None and again.append(columns.shape[1])) or real(self, columns, at, *x))
    trees, _, judged = T._fit_in_block(block, 0, spec, totals)
    out = block.fold == spec.held_out
    assert again == ([out.sum()] * spec.n_trees if spec.forest else [])
    s = np.full(out.sum(), totals.start(spec))
    for t in trees:
        s += t.values(spec)[t.route(block.columns[:, out])]
    hit = s > spec.n_trees / 2 if spec.forest else s > 0
    y = block.y[out] == 1
    assert (judged["n"], judged["tp"], judged["fp"], judged["fn"]) == (out.sum(), (hit & y).sum(), (hit & ~y).sum(), (~hit & y).sum())
    assert any((t.left >= 0).sum() > 3 for t in trees)


def test_fits_of_a_search_hand_on_no_trees(spark, monkeypatch):
    """A search sends scores to the driver, however large the trees are; they equal those of fits that keep their trees."""
    import pickle

    from tally.operators import search

    df, cols = table(spark)
    draws = [("random_forest", {"n_estimators": n, "max_depth": None}) for n in (3, 5)] + [("xgboost", {"n_estimators": n, "max_depth": 3}) for n in (3, 6)] + [("lightgbm", {"n_estimators": 4})]
    specs = [MD.tree_spec(*d, held_out=f) for d in draws for f in range(3)] + [T.Spec(n_trees=30, learning_rate=0.9, patience=2, held_out=1)] * 2
    wide = T.prepare(df, cols, fold="fold")
    monkeypatch.setattr(T, "BLOCK", 300)
    cut = T.prepare(df, cols, fold="fold")
    assert wide.n_blocks == 1 and cut.n_blocks > 3
    kept = T.fit_many(wide, specs)
    for data_ in (wide, cut):
        bare = T.fit_many(data_, specs, keep=False)
        assert [(m.judged, m.losses) for m in bare] == [(m.judged, m.losses) for m in kept]
        assert not any(m.trees for m in bare) and all(m.trees for m in kept)
    monkeypatch.undo()
    sent = []
    monkeypatch.setattr(T, "_in_tasks", lambda *a, real=T._in_tasks: sent.append(real(*a)) or sent[-1])
    scores = search.cross_validate(df.drop("fold"), cols, draws, 3)
    assert len(scores) == 5 and all(len(s) == 3 for s in scores) and max(map(max, scores)) > 0
    assert max(len(pickle.dumps(x)) for some in sent for x in some) < 1000


def test_training_rows_stand_first(spark):
    """A fit with a validation split takes a block's rows as they stand, without a copy; labels travel as small numbers, if they are."""
    import pickle

    df, cols = table(spark, 300)
    data_ = T.prepare(df.withColumn("part", (F.col("id") % 3 == 0).cast("int")), cols, part="part")
    block = T._block(bytes(data_.blocks().first()["block"]))
    n, columns, y, _, judged = block.rows(None)
    assert n == 200 and columns is block.columns and (block.part[:n] == T.TRAIN).all() and (block.part[n:] == T.VALIDATE).all()
    assert np.array_equal(np.concatenate([y, judged]), block.y) and y.sum() == df.where("id % 3 > 0 and y = 1").count()
    copy = pickle.loads(pickle.dumps(block))
    assert copy.y.dtype == np.float64 and np.array_equal(copy.y, block.y) and block.__getstate__()["y"].dtype == np.int8
    block.y = block.y + 0.5
    assert np.array_equal(pickle.loads(pickle.dumps(block)).y, block.y)


def test_few_rows_in_many_blocks_are_fitted_in_tasks(spark, monkeypatch):
    """However a session deals out rows, a table that a task can hold needs no job for every level."""
    df, cols = table(spark)
    specs = [T.Spec(n_trees=4, max_depth=3, reg_lambda=1.0, held_out=1)]
    want = T.fit_many(T.prepare(df, cols, fold="fold"), specs)
    monkeypatch.setattr(T, "BLOCK", 300)
    cut = T.prepare(df, cols, fold="fold")
    monkeypatch.undo()
    assert cut.n_blocks > 3
    monkeypatch.setattr(T, "_in_passes", None)
    assert all(same(a, b) for a, b in zip(want, T.fit_many(cut, specs), strict=True))
