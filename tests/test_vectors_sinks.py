"""Vector operators (properties) and sink round trips."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.operators import vectors
from tally.sources import sinks


def resize_array(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Separable (bi/tri)linear resize of an n-d array."""
    out = a.astype(np.float64)
    for axis, n_out in enumerate(shape):
        lo, hi, w = vectors._linear_axis(out.shape[axis], n_out)
        a_lo = np.take(out, lo, axis=axis)
        a_hi = np.take(out, hi, axis=axis)
        wshape = [1] * out.ndim
        wshape[axis] = n_out
        w = w.reshape(wshape)
        out = a_lo * (1 - w) + a_hi * w
    return out


def test_resize_constant_and_identity():
    a = np.full((4, 4, 4), 0.3)
    assert np.allclose(resize_array(a, (7, 5, 9)), 0.3)
    b = np.arange(27, dtype=float).reshape(3, 3, 3)
    assert np.allclose(resize_array(b, (3, 3, 3)), b)


def test_augment_deterministic_and_flip():
    img = np.arange(64, dtype=float).reshape(8, 8)
    a = vectors.augment_one(img, vectors._rng(1, 5, 0))
    b = vectors.augment_one(img, vectors._rng(1, 5, 0))
    assert a.shape == (8, 8) and np.array_equal(a, b)
    assert np.array_equal(img[:, ::-1][:, ::-1], img)


class _Drawn:
    """A generator whose coin flips are given and whose other draws come from numpy."""

    def __init__(self, *flips):
        self.flips, self.rng = list(flips), np.random.default_rng(4)

    def random(self):
        return self.flips.pop(0)

    def __getattr__(self, name):
        return getattr(self.rng, name)


def test_augment_each_transform():
    img = np.full((100, 100, 3), 128.0)
    assert np.array_equal(vectors.augment_one(img, _Drawn(1, 1, 1, 1, 1)), img)
    ramp = np.arange(100.0)[None, :, None] + np.zeros((100, 1, 3))
    assert np.array_equal(vectors.augment_one(ramp, _Drawn(0, 1, 1, 1, 1)), ramp[:, ::-1])
    assert np.allclose(vectors.augment_one(img, _Drawn(1, 0, 1, 1, 1)), img)  # the border is mirrored, nothing turns black
    noise = vectors.augment_one(img, _Drawn(1, 1, 1, 0, 1)) - img
    assert 9 < noise.var() < 55 and abs(np.corrcoef(noise[..., 0].ravel(), noise[..., 1].ravel())[0, 1]) < 0.05
    holes = (vectors.augment_one(img, _Drawn(1, 1, 1, 1, 0)) == 0).all(2)
    assert 64 <= holes.sum() <= 8 * 100
    small = vectors.augment_one(np.full((4, 4), 9.0), _Drawn(1, 0, 0, 0, 0))
    assert small.shape == (4, 4) and (small == 0).all()  # a hole as large as the image


def test_rotation_against_loops():
    rng = np.random.default_rng(3)
    img = rng.uniform(0, 9, (7, 5))
    got, t = vectors._rotate(img, 12.0), np.radians(12.0)
    pad = np.pad(img, 4, mode="reflect")
    for y in range(7):
        for x in range(5):
            sy, sx = np.cos(t) * (y - 3) + np.sin(t) * (x - 2) + 3, -np.sin(t) * (y - 3) + np.cos(t) * (x - 2) + 2
            a, b = int(np.floor(sy)), int(np.floor(sx))
            part = pad[a + 4:a + 6, b + 4:b + 6]
            fy, fx = sy - a, sx - b
            assert np.isclose(got[y, x], (1 - fy) * ((1 - fx) * part[0, 0] + fx * part[0, 1]) + fy * ((1 - fx) * part[1, 0] + fx * part[1, 1]))


def test_normalize_channels(spark):
    df = spark.createDataFrame([(1, [0.0, 255.0]), (2, []), (3, None)], "id long, px array<double>")
    n = vectors.normalize_image(vectors.to_channels("px"), [0.5, 0.25, 0.0], [0.5, 0.25, 1.0])
    got = {r.id: r.n for r in df.select("id", n.alias("n")).collect()}
    assert got == {1: [-1.0, -1.0, 0.0, 1.0, 3.0, 1.0], 2: [], 3: None}
    with pytest.raises(ValueError, match="2 means and 1 deviations"):
        vectors.normalize_image("px", [0.5, 0.5], [1.0])


def test_experiments_by_type(spark, tmp_path):
    from tally.operators import experiments
    from tally.sources import sinks
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    rows = [(i, int(v[0] + 0.3 * rng.normal() > 0), *map(float, v), 1.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, weight double")
    data = experiments.Data(df.where("id < 200"), df.where("id between 200 and 249"), df.where("id >= 250"), ["a", "b"])
    presets = {"tree": ("xgboost", {"n_estimators": 20, "max_depth": 2}, {"early_stopping_rounds": 5}), "net": ("mlp", {"hidden": [4], "epochs": 30}, {"patience": 10})}
    what = experiments.handlers(data, presets, {"svm": {"C": [1, 10], "kernel": ["linear"]}}, {"n_iter": 50, "cv": 3})
    runs = [sinks.Experiment("ml", "d", "tree"), sinks.Experiment("dl", "d", "net"), sinks.Experiment("tuning", "d", "svm")]
    for e in runs:
        m = sinks.run(e, what, str(tmp_path)).collect()
        assert len(m) == 1 and m[0].n == 50 and m[0].auc > 0.85 and m[0].experiment == e.key
        assert (tmp_path / e.key / "metrics").is_dir()
    assert spark.read.option("header", True).csv(str(tmp_path / runs[2].key / "trials")).count() == 2
    with pytest.raises(ValueError, match="no model of type 'dl'"):
        sinks.run(sinks.Experiment("dl", "d", "tree"), what, str(tmp_path))
    with pytest.raises(ValueError, match="unknown experiment_type"):
        sinks.run(sinks.Experiment("other", "d", "tree"), what, str(tmp_path))


def test_augment_images_partition_independent(spark):
    rows = [(i, [float(j) for j in range(64)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, px array<double>")
    a = {r.id: r.augmented for r in vectors.augment_images(df.repartition(1), "id", "px", 8, 3).collect()}
    b = {r.id: r.augmented for r in vectors.augment_images(df.repartition(5), "id", "px", 8, 3).collect()}
    assert a == b


def test_rff_kernel_error(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(30, 2)) * 0.5
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, x array<double>")
    z = {r.id: np.array(r.z) for r in
         df.select("id", vectors.rbf_features("x", 2, n_features=2000, gamma=0.5, seed=1).alias("z")).collect()}
    errs = [abs(z[i] @ z[j] - math.exp(-0.5 * np.sum((pts[i] - pts[j]) ** 2))) for i in range(30) for j in range(30)]
    assert max(errs) < 0.15


def test_write_splits_round_trip(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "id long, split string")
    sinks.write_splits(df, os.path.join(d, "s"))
    back = sinks.read_split(spark, os.path.join(d, "s"), "train")
    assert sorted(r.id for r in back.collect()) == [1, 3]


def test_read_table_csv_na_tokens(spark):
    from pyspark.sql import types as T
    from tally.sources.tables import read_table
    d = tempfile.mkdtemp()
    p = os.path.join(d, "t.csv")
    with open(p, "w") as fh:
        fh.write("id,bmi,g\n1,N/A,a\n2,30.5,NA\n3,,b\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("bmi", T.DoubleType()),
                           T.StructField("g", T.StringType())])
    rows = read_table(spark, p, schema).collect()
    assert [(r.id, r.bmi, r.g) for r in rows] == [(1, None, "a"), (2, 30.5, None), (3, None, "b")]


def test_streaming_confusion_matches_batch(spark):
    from tally.streaming.metrics import start_memory_sink, streaming_confusion
    d = tempfile.mkdtemp()
    src = os.path.join(d, "in")
    rows = [("a", i % 2, (i % 10) / 10.0) for i in range(50)]
    spark.createDataFrame(rows, "g string, y int, score double").write.parquet(src)
    stream = spark.readStream.schema("g string, y int, score double").parquet(src)
    q = start_memory_sink(streaming_confusion(stream, ["g"]), "cm_stream", os.path.join(d, "ck"))
    q.processAllAvailable()
    got = spark.sql("SELECT * FROM cm_stream").first()
    q.stop()
    tp = sum(1 for _, y, s in rows if y == 1 and s >= 0.5)
    assert got.tp == tp


def test_resize_volume_distributed_matches_numpy(spark):
    rng = np.random.default_rng(2)
    vols = {1: rng.random((5, 4, 4)), 2: rng.random((3, 4, 4))}
    rows = [(s, z, [float(x) for x in v[z].ravel()]) for s, v in vols.items() for z in range(v.shape[0])]
    df = spark.createDataFrame(rows, "study_id long, z int, plane array<double>")
    got = vectors.resize_volumes_long(df, "study_id", "z", "plane", side=4, size=6).collect()
    for s, v in vols.items():
        want = np.clip(resize_array(v, (6, 6, 6)), 0, 1)
        have = np.stack([np.array(r.plane).reshape(6, 6) for r in sorted((r for r in got if r.study_id == s),
                                                                         key=lambda r: r.z)])
        assert np.allclose(have, want, atol=1e-12)


def test_read_image_folder_labels_sorted_classes(spark):
    from tally.sources import images
    root = tempfile.mkdtemp()
    for cls, n in (("ill", 2), ("normal", 3)):
        os.makedirs(os.path.join(root, cls))
        for i in range(n):
            with open(os.path.join(root, cls, f"{i}.png"), "wb") as fh:
                fh.write(bytes([i, 1, 2]))
    m = images.read_image_folder(spark, root, pattern="*.png").collect()
    assert len(m) == 5
    assert {r["class"]: r.label for r in m} == {"ill": 0, "normal": 1}
    linked, missing = images.link_records(
        spark.createDataFrame([(m[0].path,), ("/nope/x.png",)], "path string"),
        spark.createDataFrame([(r.path,) for r in m], "path string"))
    assert sorted(r.found for r in linked.collect()) == [False, True]
    assert [r.path for r in missing.collect()] == ["/nope/x.png"]


def test_save_load_state_round_trip(spark):
    from tally.operators import encode, models as MD
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(60)], "id long, x double, y int")
    codes = encode.code_table(df, ["y"])
    model = MD.fit(MD.logistic(1.0, None, weight=None), df, ["x"])
    sinks.save_state({"codes": codes}, model, os.path.join(d, "state"))
    tables, back = sinks.load_state(spark, os.path.join(d, "state"), ["codes"])
    assert sorted(tuple(r) for r in tables["codes"].collect()) == sorted(tuple(r) for r in codes.collect())
    a = [r.score for r in MD.predict(model, df).orderBy("id").collect()]
    b = [r.score for r in MD.predict(back, df).orderBy("id").collect()]
    assert a == b


def test_align_columns_raw_frames(spark):
    from tally.operators import encode
    val = spark.createDataFrame([(1, 1, 0)], "id int, c_a int, c_z int")
    out = encode.align_columns(val, ["id", "c_a", "c_b"])
    assert out.columns == ["id", "c_a", "c_b"] and tuple(out.first()) == (1, 1, 0)


def test_tensor_sketch_estimates_the_polynomial_kernel(spark):
    """Errors of inner products of sketches stay within the bound of their variance, in few and in many dimensions."""
    from tally.operators import vectors
    for dim, n_out, degree, coef0 in ((5, 512, 3, 0.0), (50, 512, 3, 1.0), (50, 512, 2, 0.0)):
        rng = np.random.default_rng(dim)
        x = rng.normal(size=(30, dim)) / np.sqrt(dim)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
        got = vectors.tensor_sketch(df, "v", dim, n_out, degree, gamma=0.7, coef0=coef0, seed=3).orderBy("id").collect()
        z = np.array([r.sketch for r in got])
        kernel = (0.7 * x @ x.T + coef0) ** degree
        norm = np.sqrt(np.outer(kernel.diagonal(), kernel.diagonal()))
        error = (z @ z.T - kernel) / norm
        assert z.shape == (30, n_out) and np.sqrt((error**2).mean()) < 3 * np.sqrt(3**degree / n_out) and abs(error.mean()) < 0.1
        few = np.array([r.sketch for r in vectors.tensor_sketch(df, "v", dim, 32, degree, gamma=0.7, coef0=coef0, seed=3).orderBy("id").collect()])
        assert ((few @ few.T - kernel) ** 2 / norm**2).mean() > (error**2).mean()
    odd = spark.createDataFrame([(1, None), (2, [1.0, 2.0])], "id int, v array<double>")
    assert [r.sketch is None for r in vectors.tensor_sketch(odd, "v", 2, 4).orderBy("id").collect()] == [True, False]
    with pytest.raises(Exception, match="components"):
        vectors.tensor_sketch(odd, "v", 3, 4).collect()


def test_augmented_images_are_handed_on_in_small_batches(spark, monkeypatch):
    """The same images whatever the batch, and never a whole input batch of them at once."""
    df = spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.lit(48)), lambda i: ((i * 7 + F.col("id")) % 5).cast("double")).alias("px")).coalesce(1)
    got = {r.id: r.augmented for r in vectors.augment_images(df, "id", "px", side=4, seed=3, channels=3, top=4.0).collect()}
    for r in df.collect():
        want = vectors.augment_one(np.array(r.px).reshape(4, 4, 3), vectors._rng(3, r.id, 0), 4.0).ravel()
        assert np.array_equal(got[r.id], want)
    monkeypatch.setattr(vectors, "IMAGES", 7)
    sizes = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: sizes.extend(b.num_rows for b in f(self.toArrow().to_batches())) or self)
    vectors.augment_images(df, "id", "px", side=4, seed=3, channels=3, top=4.0)
    assert sizes == [7] * 5 + [5]
