"""Cleaning, encoding, splitting: hand-worked values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.operators import clean, encode, ordered, resample, splits


def test_exclude_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("Other",), (None,)], "g string")
    assert sorted(r.g or "" for r in clean.exclude_value(df, "g", "Other").collect()) == ["", "a"]


def test_to_numeric(spark):
    df = spark.createDataFrame([("1.5",), ("N/A",), (None,), ("x",)], "v string")
    got = [r.v for r in clean.to_numeric(df, "v").collect()]
    assert got == [1.5, None, None, None]


def test_exact_median_even_and_odd(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v double")
    assert ordered.exact_quantiles(df, [], "v", [0.5]).first().q == 2.5
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 3)], "v double")
    q = {r.p: r.q for r in ordered.exact_quantiles(df, [], "v", [0.25, 0.5, 0.75]).collect()}
    assert q == {0.25: 2.0, 0.5: 3.0, 0.75: 4.0}


def test_quantiles_many_partitions(spark):
    vals = [float((i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(7)
    q = ordered.exact_quantiles(df, [], "v", [0.1, 0.5, 0.9], parts=5).collect()
    s = sorted(vals)
    for r in q:
        h = (len(s) - 1) * r.p
        lo = math.floor(h)
        want = s[lo] + (h - lo) * (s[min(lo + 1, len(s) - 1)] - s[lo])
        assert r.q == pytest.approx(want)


def test_impute_median_mode(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, "b"), (4.0, None), (2.0, "a")], "x double, c string")
    out = clean.impute(df, {"x": "median", "c": "mode"}).collect()
    assert [r.x for r in out] == [1.0, 2.5, 3.0, 4.0, 2.0]
    assert [r.c for r in out][3] == "a"  # tie a/b -> smallest


def test_label_encode_numeric_order(spark):
    df = spark.createDataFrame([(10,), (2,), (1,), (2,)], "v int")
    assert [r.v for r in encode.label_encode(df, ["v"]).collect()] == [2, 1, 0, 1]
    # distributed path gives the same codes
    assert sorted((r.v, r.code) for r in encode.label_codes(df, "v").collect()) == [(1, 0), (2, 1), (10, 2)]


def test_align_unseen_level_gives_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("c",), ("b",)], "c string")
    lv = encode.levels(train, "c")
    rows = encode.one_hot(test, "c", lv).collect()
    assert [(r.c_a, r.c_b) for r in rows] == [(0, 0), (0, 1)]
    rows = encode.one_hot(test, "c", lv, drop_first=True).collect()
    assert [r.c_b for r in rows] == [0, 1] and "c_a" not in rows[0].asDict()


def test_zero_variance_divides_by_one(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "k double, v double")
    rows = encode.standard_scale(df, ["k", "v"]).collect()
    assert [r.k for r in rows] == [0.0, 0.0]
    assert [r.v for r in rows] == [-1.0, 1.0]  # population std = 1


def test_split_worked_example(spark):
    # n = 1800, 249 positives -> test 360 (50 pos), val 180 (25 pos)
    rows = [(i, 1 if i < 249 else 0) for i in range(1800)]
    df = spark.createDataFrame(rows, "id long, y int")
    s = splits.stratified_split(df, "y", "id", 0.2, 0.1, seed=42)
    c = {(r.split, r.y): r["count"] for r in s.groupBy("split", "y").count().collect()}
    assert c[("test", 1)] + c[("test", 0)] == 360 and c[("test", 1)] == 50
    assert c[("val", 1)] + c[("val", 0)] == 180 and c[("val", 1)] == 25
    assert s.select("id").distinct().count() == 1800


def test_split_partition_invariance(spark):
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y int")
    a = {r.id: r.split for r in splits.stratified_split(df.repartition(1), "y", "id").collect()}
    b = {r.id: r.split for r in splits.stratified_split(df.repartition(7), "y", "id").collect()}
    assert a == b


def test_kfold_round_robin_counts(spark):
    rows = [(i, 1 if i < 23 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, y int")
    f = splits.stratified_kfold(df, "y", "id", k=10, seed=1)
    c = {(r.fold, r.y): r["count"] for r in f.groupBy("fold", "y").count().collect()}
    # sorted labels: 77 zeros then 23 ones; position j -> fold j % 10
    for fold in range(10):
        assert c.get((fold, 0), 0) == len([j for j in range(77) if j % 10 == fold])
        assert c.get((fold, 1), 0) == len([j for j in range(77, 100) if j % 10 == fold])


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    r = encode.class_weights(df, "y").first()
    assert r.scale_pos_weight == 3.0 and r.sqrt_pos_weight == pytest.approx(math.sqrt(3))
    assert r.weight_pos == 2.0 and r.weight_neg == pytest.approx(4 / 6)


def test_clean_vector(spark):
    df = spark.createDataFrame([([1.0, float("nan"), float("inf"), float("-inf")],)], "v array<double>")
    assert df.select(clean.clean_vector("v").alias("v")).first().v == [1.0, 0.0, 0.0, 0.0]


def test_knn_exact_vs_brute_force(spark):
    rng = np.random.default_rng(5)
    X = np.round(rng.normal(size=(120, 3)), 1)  # coarse values: many distance ties
    df = spark.createDataFrame([(i, [float(x) for x in X[i]]) for i in range(120)], "id long, v array<double>")
    got = {(r.id, r.nn_rank): r.nn_id for r in resample.knn(df, "id", "v", 3, k=4).collect()}
    for i in range(120):
        d = sorted((float(np.sum((X[i] - X[j]) ** 2)), j) for j in range(120) if j != i)
        assert [got[(i, r + 1)] for r in range(4)] == [j for _, j in d[:4]]


def test_smote_parity_and_segments(spark):
    rows = [(i, float(i % 13), float((i * 7) % 5), 1 if i % 5 == 0 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = resample.smote(df, "y", "id", ["a", "b"], k=3, seed=1)
    c = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert c[0] == c[1] == 160
    pts = {r.id: np.array([r.a, r.b]) for r in df.where("y = 1").collect()}
    nn = {(r.id, r.nn_id) for r in resample.knn(df.where("y = 1").select(
        "id", F.array("a", "b").alias("v")), "id", "v", 2, k=3).collect()}
    for r in out.where("synthetic").collect():
        assert (r.base_id, r.nn_id) in nn and 0 <= r.gap < 1
        want = pts[r.base_id] + r.gap * (pts[r.nn_id] - pts[r.base_id])
        assert np.allclose([r.a, r.b], want)


def _points(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_knn_with_duplicates_outlier_and_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(resample, "CELL", 16)
    rng = np.random.default_rng(5)
    cases = [np.vstack([np.ones((12, 2)), rng.normal(size=(8, 2))]),  # most points equal
             np.vstack([rng.normal(size=(60, 3)), [[1e9, 0, 0]]]), rng.normal(size=(150, 20)),
             np.vstack([rng.integers(0, 2, (80, 4)).astype(float)])]
    for x in cases:
        got = {(r.id, r.nn_rank): (r.nn_id, r.dist2) for r in resample.knn(_points(spark, x), "id", "v", x.shape[1], k=5).collect()}
        for i, v in enumerate(x):
            d = np.zeros(len(x))
            for j in range(x.shape[1]):
                d += np.square(x[:, j] - v[j])
            want = sorted((d[j], j) for j in range(len(x)) if j != i)[:5]
            assert [got[i, r] for r in range(1, 6)] == [(j, dj) for dj, j in want]


def test_knn_visits_stay_level(spark, monkeypatch):
    """Four times the points: about as many candidates for each."""
    monkeypatch.setattr(resample, "CELL", 64)
    rng = np.random.default_rng(6)
    for dim in (2, 6):
        per = []
        for n in (1500, 6000):
            stats = {}
            resample.knn(_points(spark, rng.normal(size=(n, dim))), "id", "v", dim, k=5, stats=stats)
            per.append(stats["visits"] / n * n / stats["cells"])
        assert per[1] < 2 * per[0], (dim, per)


def test_cells_answer_with_what_is_near_enough():
    """A visited cell gives no rows beyond the bound of the vector that visits it, ties by id, never the vector itself."""
    import pyarrow as pa
    there = pa.table({"of": [1] * 5, "node": [4, 3, 2, 9, 1], "v": [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [5.0, 0.0], [2.0, 0.0]]})
    asks = pa.table({"node": [4, 7, 8], "v": [[0.0, 0.0], [5.0, 1.0], [9.0, 9.0]], "far": [4.0, np.inf, 1.0], "cell": [1] * 3})
    got = resample.nearest_in_cell(asks, there, 2, 2).to_pylist()
    assert [(r["node"], r["other"], r["dist2"]) for r in got] == [(4, 2, 1.0), (4, 3, 1.0), (7, 9, 1.0), (7, 1, 10.0)]
    assert resample.nearest_in_cell(asks[:0], there, 2, 2).num_rows == resample.nearest_in_cell(asks, there[:0], 2, 2).num_rows == 0


def _brute_knn(x, k):
    out = {}
    for i in range(len(x)):
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += np.square(x[:, j] - x[i, j])
        near = np.lexsort((np.arange(len(x)), d))
        out.update({(i, r + 1): (int(o), d[o]) for r, o in enumerate(near[near != i][:k])})
    return out


def test_knn_cells_are_cut_until_small(spark, monkeypatch):
    """A sample for four cells only: they are cut again, and the largest cell stays level."""
    monkeypatch.setattr(resample, "SAMPLE", 16)
    monkeypatch.setattr(resample, "CELL", 24)
    monkeypatch.setattr(resample, "FAN", 4)
    monkeypatch.setattr(resample, "PICK", 64)
    rng = np.random.default_rng(7)
    even = [rng.normal(size=(n, 2)) for n in (600, 2400)]
    lumps = np.vstack([rng.normal(size=(250, 2)) * 1e-6, [[5, 5], [5, 6]], np.c_[np.zeros(150), np.arange(150)]])
    visits = []
    for x in (*even, lumps):
        stats = {}
        got = resample.knn(_points(spark, x), "id", "v", 2, k=5, stats=stats).collect()
        assert {(r.id, r.nn_rank): (r.nn_id, r.dist2) for r in got} == _brute_knn(x, 5)
        assert stats["points"] == len(x) and stats["largest"] <= 48
        visits.append(stats["visits"] / len(x))
    assert visits[1] < 1.5 * visits[0]


def test_too_few_points_raise(spark):
    with pytest.raises(ValueError, match="3 points are too few for 5"):
        resample.knn(_points(spark, np.eye(3)), "id", "v", 3, k=5)


def test_unseen_level_raises(spark):
    fit, df = spark.createDataFrame([("a",), ("b",)], "c string"), spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    with pytest.raises(Exception, match="value not among the fitted levels: z"):
        encode.label_encode(df, ["c"], fit).collect()
    assert sorted((r.c for r in encode.label_encode(df, ["c"], fit, strict=False).collect()), key=str) == [0, None, None]


def test_one_hot_vector(spark):
    fit = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    df = spark.createDataFrame([("a",), ("c",), ("z",), (None,)], "c string")
    got = sorted(((r.c, r.c_hot.size, r.c_hot.position) for r in encode.one_hot_vector(df, "c", fit, drop_first=True).collect()), key=str)
    assert got == sorted([("a", 2, None), ("c", 2, 1), ("z", 2, None), (None, 2, None)], key=str)


def test_quantiles_of_a_tied_value(spark):
    """80 % of the rows hold one value: one row after counting."""
    x = np.concatenate([np.zeros(8000), np.random.default_rng(7).normal(size=2000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    from tally.operators.ordered import exact_quantiles
    got = {r.p: r.q for r in exact_quantiles(df, [], "x", [0.05, 0.5, 0.93]).collect()}
    for p in got:
        assert abs(got[p] - np.quantile(x, p)) < 1e-12


def test_codes_of_many_levels_without_hot_join_keys(spark):
    """Beyond the lookup's levels: frequent ones are looked up, the rest joined; the same codes as ranks."""
    from tally.operators import encode
    n = 4000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("v"), (F.col("id") % 900).cast("string"))).alias("c"))
    levels = sorted({r.c for r in df.collect() if r.c is not None})
    assert len(levels) > encode.MAX_LOOKUP
    want = {r.id: None if r.c is None else levels.index(r.c) for r in df.collect()}
    assert {r.id: r.c for r in encode.label_encode(df, ["c"]).collect()} == want
    assert encode.label_encode(df, ["c"]).columns == ["id", "c"]
    some = df.where("id % 900 < 450 or c = 'hot'")
    got = encode.label_encode(df, ["c"], fit=some, strict=False).where("c is not null").count()
    assert got == df.join(some.select("c").distinct(), "c", "left_semi").count()
    with pytest.raises(Exception, match="not among the fitted levels"):
        encode.label_encode(df, ["c"], fit=some).collect()
    hot = encode.one_hot_vector(df, "c").collect()
    assert all((r.c_hot.position, r.c_hot.size) == (want[r.id], len(levels)) for r in hot)


def test_keyed_values_raise_beyond_their_bound(spark):
    from tally.functions import exprs
    table = spark.range(exprs.MAX_KEYS + 1).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    with pytest.raises(Exception, match="more than"):
        spark.range(2).select(F.col("id").alias("k")).select(exprs.keyed_values(table, ["k"], ["v"])["v"]).collect()


def test_target_statistics_use_earlier_rows_only(spark):
    import hashlib

    from tally.operators import encode
    rows = [(i, ["a", "b", None][i % 3 if i % 5 else 0], int(i % 4 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, c string, y int")
    order = sorted(rows, key=lambda r: (hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), str(r[0])))
    seen, want = {}, {}
    for i, c, y in order:
        n, p = seen.get(c, (0, 0))
        want[i] = (p + 0.5) / (n + 1)
        seen[c] = n + 1, p + y
    assert {r.id: r.c for r in encode.ordered_target_statistics(df, ["c"]).collect()} == pytest.approx(want)
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "new")], "id long, c string")
    got = {r.id: r.c for r in encode.target_statistics(new, ["c"], df).collect()}
    assert got == pytest.approx({1: (seen["a"][1] + 0.5) / (seen["a"][0] + 1), 2: (seen[None][1] + 0.5) / (seen[None][0] + 1), 3: 0.5})
