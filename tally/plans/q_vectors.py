"""Catalogue: image paths, image tiles and fused vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import splits, studies, vectors
from tally.plans import fixtures as fx
from tally.plans.q_metrics import r6
from tally.plans.q_prep import R
from tally.plans.q_studies import ordered, planes
from tally.plans.registry import register
from tally.sources import images
from tally.sources.tables import Tables

ROOT = "/data/raw"


def IP(spark, sf):
    return fx.image_paths(Tables(spark, sf))


@register("resolve_image_path", "S4", views=("image_paths",), oracle=f"""
SELECT id, '{ROOT}/' || replace(image_path, chr(92), '/') AS path FROM image_paths""")
def resolve_image_path(spark, sf):
    return IP(spark, sf).select("id", images.resolve_path(ROOT, "image_path").alias("path"))


@register("image_manifest", "S2 E1", views=("image_paths",), oracle="""
WITH m AS (SELECT id, string_split(replace(image_path, chr(92), '/'), '/')[-2] AS class FROM image_paths)
SELECT id, class, CAST(DENSE_RANK() OVER (ORDER BY class) - 1 AS INTEGER) AS label FROM m""")
def image_manifest(spark, sf):
    m = IP(spark, sf).select("id", images.class_of("image_path").alias("class"))
    return images.label_classes(m).select("id", "class", "label")


@register("split_image_folder", "S3 R2", views=("image_paths",), oracle="""
WITH m AS (SELECT id, string_split(replace(image_path, chr(92), '/'), '/')[-2] AS class FROM image_paths),
c AS (SELECT class, COUNT(*) AS n, CEIL(CAST(0.2 AS DOUBLE) * COUNT(*)) AS q_test FROM m GROUP BY class),
q AS (SELECT class, q_test, CEIL(CAST(0.125 AS DOUBLE) * (n - q_test)) AS q_val FROM c),
r AS (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY class ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS rk FROM m)
SELECT CASE WHEN rk <= q_test THEN 'test' WHEN rk <= q_test + q_val THEN 'val' ELSE 'train' END AS split, r.class,
       COUNT(*) AS n, SUM(id)::BIGINT AS id_sum
FROM r JOIN q ON r.class = q.class GROUP BY ALL""")
def split_image_folder(spark, sf):
    """Per-class 70/10/20 split of the file manifest (the target layout is split/class/file)."""
    m = IP(spark, sf).select("id", images.class_of("image_path").alias("class"))
    s = splits.per_class_split(m, "class", "id", 0.2, 0.1, seed=42)
    return s.groupBy("split", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@register("link_records", "J4", views=("image_paths",), oracle=f"""
WITH rec AS (SELECT l.doc_id AS id, '{ROOT}/images/' || d.source || '/' || CAST(l.doc_id AS VARCHAR) || '.png' AS path
             FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
man AS (SELECT DISTINCT '{ROOT}/' || replace(image_path, chr(92), '/') AS path FROM image_paths)
SELECT rec.id, rec.path, man.path IS NOT NULL AS found FROM rec LEFT JOIN man ON rec.path = man.path""")
def link_records(spark, sf):
    t = Tables(spark, sf)
    rec = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit(ROOT + "/images/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                 F.lit(".png")).alias("path"))
    man = IP(spark, sf).select(images.resolve_path(ROOT, "image_path").alias("path"))
    linked, _ = images.link_records(rec, man, "path")
    return linked.select("id", "path", "found")


@register("fuse_concat", "E11", views=("tiles", "risk_raw"), oracle="""
WITH f AS (SELECT t.id, list_concat(list_transform(t.px, lambda x: CAST(x AS DOUBLE)), [r.amount, CAST(r.flag_a AS DOUBLE)]) AS v
           FROM tiles t JOIN risk_raw r ON t.id = r.id)
SELECT id, CAST(len(v) AS INTEGER) AS dim, ROUND(v[1], 6) AS first, ROUND(v[65], 6) AS amount, ROUND(v[66], 6) AS flag FROM f""")
def fuse_concat(spark, sf):
    t = fx.tiles(Tables(spark, sf))
    r = R(spark, sf).select("id", F.array(F.col("amount"), F.col("flag_a").cast("double")).alias("tab"))
    f = vectors.fuse_concat(t, r, "id", "px", "tab")
    return r6(f.select("id", F.size("fused").alias("dim"), F.col("fused")[0].alias("first"),
                       F.col("fused")[64].alias("amount"), F.col("fused")[65].alias("flag")))


@register("normalize_image", "E18", views=("tiles",), oracle="""
SELECT id, ROUND(list_sum(list_transform(px, lambda x: (CAST(x AS DOUBLE) * 255.0 / 255.0 - 0.485) / 0.229)), 6) AS norm_sum,
       ROUND(list_transform(px, lambda x: (CAST(x AS DOUBLE) * 255.0 / 255.0 - 0.485) / 0.229)[1], 6) AS first FROM tiles""")
def normalize_image(spark, sf):
    t = fx.tiles(Tables(spark, sf)).withColumn("px255", F.transform("px", lambda x: x.cast("double") * 255.0))
    n = t.select("id", vectors.normalize_image("px255", 0.485, 0.229).alias("n"))
    return r6(n.select("id", F.aggregate("n", F.lit(0.0), lambda a, b: a + b).alias("norm_sum"),
                       F.col("n")[0].alias("first")))


# The reference's channel means and deviations.
MEANS, DEVIATIONS = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]


@register("normalize_rgb", "E18", views=("tiles",), oracle=f"""
WITH n AS (SELECT id, {', '.join(f"list_transform(px, lambda x: (CAST(x AS DOUBLE) - {m}) / {s}) AS c{i}" for i, (m, s) in enumerate(zip(MEANS, DEVIATIONS)))} FROM tiles)
SELECT id, CAST(3 * len(c0) AS INTEGER) AS size, {', '.join(f"ROUND(c{i}[64], 6) AS last{i}, ROUND(list_sum(c{i}), 6) AS sum{i}" for i in range(3))} FROM n""")
def normalize_rgb(spark, sf):
    """Three-channel images normalised per channel: size, last pixel and sum of each channel."""
    t = fx.tiles(Tables(spark, sf)).select("id", vectors.to_channels(F.transform("px", lambda x: x.cast("double") * 255.0)).alias("px"))
    n = t.select("id", vectors.normalize_image("px", MEANS, DEVIATIONS).alias("n"))
    one = lambda i: F.filter("n", lambda x, k: k % 3 == i)
    return r6(n.select("id", F.size("n").alias("size"), *[c for i in range(3) for c in (
        F.col("n")[189 + i].alias(f"last{i}"), F.aggregate(one(i), F.lit(0.0), lambda a, b: a + b).alias(f"sum{i}"))]))


def _lst(v) -> str:
    return "[" + ", ".join(repr(x) for x in v) + "]"


def _resample_sql(src: str, side: int, size: int, clip: bool = False) -> str:
    """DuckDB form of the bilinear plane resample with the same constant tables."""
    idx, wts = vectors.plane_tables(side, size)
    terms = " + ".join(f"CAST({src}[(CAST({_lst(idx[t])} AS INTEGER[]))[k + 1]] AS DOUBLE) * "
                       f"(CAST({_lst(wts[t])} AS DOUBLE[]))[k + 1]" for t in range(4))
    v = f"(CAST(0 AS DOUBLE) + {terms})"
    if clip:
        v = f"LEAST(GREATEST({v}, 0.0), 1.0)"
    return f"list_transform(range({size * size}), lambda k: {v})"


def _resize_volume_sql() -> str:
    from tally.plans.q_studies import VOLUME_SQL
    zero = "list_transform(range(64), lambda i: CAST(0 AS DOUBLE))"
    return f"""WITH {VOLUME_SQL},
f AS (SELECT study_id, MIN(pos) AS first FROM x WHERE readable GROUP BY study_id),
v AS (SELECT x.study_id, x.pos - f.first AS z, CASE WHEN readable THEN plane ELSE {zero} END AS plane
      FROM x JOIN f ON x.study_id = f.study_id WHERE x.pos >= f.first
      UNION ALL SELECT DISTINCT study_id, 0, {zero} FROM x WHERE study_id NOT IN (SELECT study_id FROM f)),
d AS (SELECT study_id, COUNT(*) AS dd FROM v GROUP BY study_id),
s AS (SELECT study_id, dd, j, LEAST(GREATEST((CAST(j AS DOUBLE) + CAST(0.5 AS DOUBLE)) * (CAST(dd AS DOUBLE) / CAST(16 AS DOUBLE))
                                      - CAST(0.5 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(dd - 1 AS DOUBLE)) AS src
      FROM d, range(16) t(j)),
w AS (SELECT study_id, j, CAST(FLOOR(src) AS INTEGER) AS lo, LEAST(CAST(FLOOR(src) AS INTEGER) + 1, dd - 1) AS hi,
             src - CAST(FLOOR(src) AS INTEGER) AS wz FROM s),
b AS (SELECT w.study_id, w.j, list_transform(range(64), lambda i: a.plane[i + 1] * (1 - w.wz) + c.plane[i + 1] * w.wz) AS bl
      FROM w JOIN v a ON a.study_id = w.study_id AND a.z = w.lo JOIN v c ON c.study_id = w.study_id AND c.z = w.hi),
r AS (SELECT study_id, list_sum({_resample_sql('bl', 8, 16, clip=True)}) AS ps FROM b)
SELECT study_id, COUNT(*) AS depth, ROUND(SUM(ps), 6) AS voxel_sum FROM r GROUP BY study_id"""


@register("resize_volume", "E17 E16", views=("slices",), oracle=_resize_volume_sql())
def resize_volume(spark, sf):
    """Volumes of each study resized to 16^3: separable trilinear resize distributed by output slice."""
    from tally.session import checkpoint_dir
    checkpoint_dir(spark)
    # the resize reads the volume three times (depth, lower and upper source slice): materialise it once
    v = studies.stack_volume(ordered(spark, sf), planes(spark, sf), 64, "zero").checkpoint(eager=True)
    r = vectors.resize_volumes_long(v, "study_id", "z", "plane", side=8, size=16)
    s = r.select("study_id", F.aggregate("plane", F.lit(0.0), lambda a, b: a + b).alias("_s"))
    return s.groupBy("study_id").agg(F.count(F.lit(1)).alias("depth"), F.round(F.sum("_s"), 6).alias("voxel_sum"))


@register("resize_images", "E18", views=("tiles",), oracle=f"""
WITH r AS (SELECT id, {_resample_sql('px', 8, 16)} AS resized FROM tiles)
SELECT id, CAST(len(resized) AS INTEGER) AS n_px, ROUND(list_sum(resized), 6) AS px_sum,
       ROUND(resized[1], 6) AS first, ROUND(resized[137], 6) AS mid FROM r""")
def resize_images(spark, sf):
    t = fx.tiles(Tables(spark, sf))
    r = vectors.resize_images(t, "id", "px", side=8, size=16)
    return r6(r.select("id", F.size("resized").alias("n_px"),
                       F.aggregate("resized", F.lit(0.0), lambda a, b: a + b).alias("px_sum"),
                       F.col("resized")[0].alias("first"), F.col("resized")[136].alias("mid")))


@register("augment_images", "E19", views=("tiles",))
def augment_images(spark, sf):
    t = fx.tiles(Tables(spark, sf))
    top = 4.0  # the tiles' values as grey levels from 0 to 4, resized and with three channels
    grey = vectors.resize_images(t.withColumn("px", F.transform("px", lambda x: x + F.lit(top / 2))), "id", "px", side=8, size=32)
    rgb = grey.select("id", vectors.to_channels("resized").alias("px"))
    a = vectors.augment_images(rgb, "id", "px", side=32, seed=42, epoch=0, channels=3, top=top)
    return a.select("id", F.size("augmented").alias("n_px"),
                    F.round(F.aggregate("augmented", F.lit(0.0), lambda x, y: x + y), 6).alias("px_sum"))


def _rff_oracle() -> str:
    w, b = vectors.rff_params(2, 16, 0.5, 7)
    wl = "[" + ", ".join(repr(float(x)) for x in w.ravel()) + "]"
    bl = "[" + ", ".join(repr(float(x)) for x in b) + "]"
    z = (f"SQRT(2.0 / 16) * COS(b[k + 1] + w[k * 2 + 1] * x1 + w[k * 2 + 2] * x2)")
    return f"""WITH c AS (SELECT {wl}::DOUBLE[] AS w, {bl}::DOUBLE[] AS b),
r AS (SELECT id, amount / 1e5 AS x1, CAST(flag_a AS DOUBLE) AS x2 FROM risk_raw)
SELECT id, 16 AS n_features,
       ROUND(list_sum(list_transform(range(16), lambda k: ({z}) * ({z}))), 6) AS sq_norm
FROM r, c"""


@register("rbf_features", "E20", views=("risk_raw",), oracle=_rff_oracle())
def rbf_features(spark, sf):
    r = R(spark, sf).select("id", F.array((F.col("amount") / 1e5), F.col("flag_a").cast("double")).alias("x"))
    z = r.select("id", vectors.rbf_features("x", dim=2, n_features=16, gamma=0.5, seed=7).alias("z"))
    return z.select("id", F.size("z").alias("n_features"),
                    F.round(F.aggregate("z", F.lit(0.0), lambda a, b: a + b * b), 6).alias("sq_norm"))


def _sketch_oracle(dim=64, n=32, degree=3, seed=5):
    """Count sketches of the tile's pixels, folded one into another place by place (circular convolution)."""
    at, sign = vectors.sketch_params(dim + 1, n, degree, seed)
    values = ", ".join(f"({d}, {j}, {at[d, j]}, {sign[d, j]:.1f})" for d in range(degree) for j in range(dim))
    return f"""
WITH h(d, j, place, sign) AS (VALUES {values}),
x AS (SELECT id, UNNEST(range(0, 64)) AS j, CAST(UNNEST(px) AS DOUBLE) AS v FROM tiles),
c AS (SELECT id, d, place, SUM(v * sign) AS s FROM x JOIN h USING (j) GROUP BY ALL),
p AS (SELECT a.id, (a.place + b.place) % {n} AS place, SUM(a.s * b.s) AS s FROM c a JOIN c b ON a.id = b.id AND a.d = 0 AND b.d = 1 GROUP BY ALL),
q AS (SELECT a.id, (a.place + b.place) % {n} AS place, SUM(a.s * b.s) AS s FROM p a JOIN c b ON a.id = b.id AND b.d = 2 GROUP BY ALL),
k AS (SELECT id, UNNEST(range(0, {n})) AS place FROM tiles)
SELECT k.id, CAST(k.place AS INT) AS place, ROUND(COALESCE(s, 0), 6) + 0 AS value FROM k LEFT JOIN q ON q.id = k.id AND q.place = k.place"""


@register("tensor_sketch", "E20", views=("tiles",), oracle=_sketch_oracle())
def tensor_sketch(spark, sf):
    """Cubic kernel features of every tile by sketched tensor powers: all 32 numbers of each."""
    t = vectors.tensor_sketch(fx.tiles(Tables(spark, sf)).select("id", "px"), "px", 64, n_out=32, degree=3, seed=5)
    return t.select("id", F.posexplode("sketch").alias("place", "value")).select("id", "place", (F.round("value", 6) + F.lit(0.0)).alias("value"))
