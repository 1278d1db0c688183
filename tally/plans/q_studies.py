"""Catalogue: study index, feature stores, sequences, volumes and study-level evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import compare as C
from tally.operators import losses, splits, studies
from tally.plans import fixtures as fx
from tally.plans.q_metrics import r6
from tally.plans.registry import register
from tally.sources.tables import Tables

MAX_LEN = 60


def SL(spark, sf):
    return fx.slices(Tables(spark, sf))


def ordered(spark, sf):
    return studies.order_slices(SL(spark, sf))


def stores(spark, sf):
    t = Tables(spark, sf)
    o = studies.order_slices(fx.slices(t))
    v = t.embeddings.select("vec_id", F.col("embedding").alias("px"))
    a = studies.feature_store(o, v, 1, 26)
    b = studies.feature_store(o, v, 27, 19, drop_last=F.col("study_id") % 3)
    c = studies.feature_store(o, v, 46, 19, drop_last=F.col("study_id") % 2)
    return o, a, b, c


ORDERED_SQL = """o AS (SELECT s.*, CAST(ROW_NUMBER() OVER (PARTITION BY study_id ORDER BY z_pos, slice_id) - 1 AS INTEGER) AS pos,
              COUNT(*) OVER (PARTITION BY study_id) AS n_slices FROM slices s)"""
STORES_SQL = ORDERED_SQL + """,
sa AS (SELECT o.study_id, o.pos, e.embedding[1:26] AS vec FROM o JOIN embeddings e ON o.vec_id = e.vec_id),
sb AS (SELECT o.study_id, o.pos, e.embedding[27:45] AS vec FROM o JOIN embeddings e ON o.vec_id = e.vec_id
       WHERE o.pos < o.n_slices - o.study_id % 3),
sc AS (SELECT o.study_id, o.pos, e.embedding[46:64] AS vec FROM o JOIN embeddings e ON o.vec_id = e.vec_id
       WHERE o.pos < o.n_slices - o.study_id % 2),
m AS (SELECT sa.study_id, sa.pos, list_concat(sa.vec, sb.vec, sc.vec) AS vec
      FROM sa JOIN sb ON sa.study_id = sb.study_id AND sa.pos = sb.pos JOIN sc ON sa.study_id = sc.study_id AND sa.pos = sc.pos)"""


@register("order_slices", "E14 J2 S6", views=("slices",), oracle=f"""
WITH {ORDERED_SQL}
SELECT study_id, pos, slice_id, n_slices FROM o""")
def order_slices(spark, sf):
    return ordered(spark, sf).select("study_id", "pos", "slice_id", "n_slices")


@register("feature_store", "S5", views=("slices",), oracle=f"""
WITH {STORES_SQL}
SELECT study_id, pos, CAST(len(vec) AS INTEGER) AS dim, vec[1] AS first FROM sb""")
def feature_store(spark, sf):
    _, _, b, _ = stores(spark, sf)
    return b.select("study_id", "pos", F.size("vec").alias("dim"), F.col("vec")[0].alias("first"))


@register("merge_slice_features", "E12 J1 U3 P6 A8", views=("slices",), oracle=f"""
WITH {STORES_SQL},
lab AS (SELECT study_id, MAX(label) AS label FROM slices GROUP BY study_id)
SELECT m.study_id, m.pos, CAST(len(vec) AS INTEGER) AS dim, vec[1] AS first, vec[64] AS last, lab.label
FROM m JOIN lab ON m.study_id = lab.study_id""")
def merge_slice_features(spark, sf):
    o, a, b, c = stores(spark, sf)
    m = studies.merge_stores([a, b, c])
    lab = studies.study_label(o).select("study_id", "label")
    return m.join(lab, "study_id").select("study_id", "pos", F.size("vec").alias("dim"),
                                          F.col("vec")[0].cast("float").alias("first"),
                                          F.col("vec")[63].cast("float").alias("last"), "label")


@register("pad_sequence", "E13 D8", views=("slices",), oracle=f"""
WITH {STORES_SQL},
j AS (SELECT m.study_id, m.pos, o.label, m.vec FROM m JOIN o ON m.study_id = o.study_id AND m.pos = o.pos WHERE m.pos < {MAX_LEN}),
g AS (SELECT study_id, COUNT(*) AS n, list(CAST(label AS FLOAT) ORDER BY pos) AS l, list(CAST(len(vec) AS INTEGER) ORDER BY pos) AS d
      FROM j GROUP BY study_id)
SELECT study_id, CAST(n AS INTEGER) AS n_real, list_resize(l, {MAX_LEN}, CAST(0 AS FLOAT)) AS labels,
       list_resize(d, {MAX_LEN}, 64) AS feat_dims,
       list_concat(list_resize([CAST(1 AS FLOAT)], CAST(n AS INTEGER), CAST(1 AS FLOAT)), list_resize([CAST(0 AS FLOAT)], {MAX_LEN} - CAST(n AS INTEGER), CAST(0 AS FLOAT))) AS loss_mask,
       list_concat(list_resize([false], CAST(n AS INTEGER), false), list_resize([true], {MAX_LEN} - CAST(n AS INTEGER), true)) AS padding_mask
FROM g""")
def pad_sequence(spark, sf):
    o, a, b, c = stores(spark, sf)
    m = studies.merge_stores([a, b, c]).join(o.select("study_id", "pos", "label"), ["study_id", "pos"])
    p = studies.pad_sequences(m, MAX_LEN, value_cols=("label",), vec_col="vec", dim=64)
    return p.select("study_id", "n_real", F.col("labels"), F.transform("features", lambda v: F.size(v)).alias("feat_dims"),
                    "loss_mask", "padding_mask")


@register("study_label", "A8", views=("slices",), oracle="""
SELECT study_id, MAX(label) AS label, COUNT(*) AS n_slices FROM slices GROUP BY study_id""")
def study_label(spark, sf):
    return studies.study_label(SL(spark, sf))


@register("study_score", "A9 P8", views=("slices",), oracle="""
SELECT study_id, ROUND(MAX(slice_score), 6) AS score, MAX(label) AS y,
       CASE WHEN MAX(slice_score) > 0.5 THEN 1 ELSE 0 END AS pred FROM slices GROUP BY study_id""")
def study_score(spark, sf):
    return r6(studies.study_score(SL(spark, sf)))


@register("study_metrics", "M20 M1 M3 M4", views=("slices",), oracle="""
WITH s AS (SELECT study_id, MAX(slice_score) AS score, MAX(label) AS y FROM slices GROUP BY study_id),
cm AS (SELECT SUM(CASE WHEN score > 0.5 AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
              SUM(CASE WHEN score > 0.5 AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
              SUM(CASE WHEN score <= 0.5 AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
              SUM(CASE WHEN score <= 0.5 AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS tn FROM s),
g AS (SELECT score, SUM(y) AS pos, SUM(1 - y) AS neg FROM s GROUP BY score),
c AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             SUM(pos) OVER () AS P, SUM(neg) OVER () AS N FROM g),
auc AS (SELECT CASE WHEN MAX(P) > 0 AND MAX(N) > 0 THEN SUM(pos * (below + neg / 2.0)) / (MAX(P) * MAX(N)) END AS auc FROM c)
SELECT tp, fp, fn, tn,
       ROUND(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy,
       ROUND(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
       ROUND(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
       ROUND(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1,
       ROUND(auc, 6) AS auc, tp + fp + fn + tn AS n, ROUND((tp + fn) * 100.0 / (tp + fp + fn + tn), 6) AS positive_pct
FROM cm, auc""")
def study_metrics(spark, sf):
    s = studies.study_score(SL(spark, sf))
    return r6(C.report(s, [], threshold=0.5, op=">"))


@register("slice_metrics", "M19", views=("slices",), oracle=f"""
WITH {ORDERED_SQL},
v AS (SELECT * FROM o WHERE pos < {MAX_LEN}),
ok AS (SELECT * FROM v WHERE NOT isnan(slice_score)),
cm AS (SELECT SUM(CASE WHEN slice_score > 0.5 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
              SUM(CASE WHEN slice_score > 0.5 AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
              SUM(CASE WHEN slice_score <= 0.5 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
              SUM(CASE WHEN slice_score <= 0.5 AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS tn FROM ok),
g AS (SELECT slice_score AS score, SUM(label) AS pos, SUM(1 - label) AS neg FROM ok GROUP BY slice_score),
c AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             SUM(pos) OVER () AS P, SUM(neg) OVER () AS N FROM g),
auc AS (SELECT SUM(pos * (below + neg / 2.0)) / (MAX(P) * MAX(N)) AS auc FROM c)
SELECT (SELECT COUNT(*) FROM ok) AS n_valid, (SELECT COUNT(*) FROM v) - (SELECT COUNT(*) FROM ok) AS n_nan_dropped,
       tp, fp, fn, tn,
       ROUND(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy,
       ROUND(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
       ROUND(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
       ROUND(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1,
       ROUND(auc, 6) AS auc
FROM cm, auc""")
def slice_metrics(spark, sf):
    """Metrics over real (unpadded) slice positions; NaN predictions are dropped and counted."""
    return r6(losses.slice_metrics(ordered(spark, sf), "slice_score", "label", F.col("pos") < MAX_LEN))


@register("masked_bce", "M18 M17", views=("slices",), oracle=f"""
WITH {ORDERED_SQL},
l AS (SELECT study_id, slice_score * 10 - 5 AS z, label, CASE WHEN pos < {MAX_LEN} THEN 1.0 ELSE 0.0 END AS mask FROM o)
SELECT study_id, ROUND(SUM((label * (GREATEST(-z, 0) + LN(1 + EXP(-ABS(z)))) + (1 - label) * (GREATEST(z, 0) + LN(1 + EXP(-ABS(z))))) * mask)
                     / (SUM(mask) + 1e-8), 6) AS loss,
       CAST(SUM(mask) AS BIGINT) AS n_real
FROM l GROUP BY study_id""")
def masked_bce(spark, sf):
    """Loss of every study over its real positions."""
    return r6(losses.masked_bce(ordered(spark, sf), ["study_id"], F.col("slice_score") * 10 - 5, "label", F.col("pos") < MAX_LEN))


@register("study_split", "R3 A8", views=("slices",), oracle="""
WITH s AS (SELECT study_id, MAX(label) AS label FROM slices GROUP BY study_id),
cc AS (SELECT label, COUNT(*) AS c FROM s GROUP BY label),
a AS (SELECT *, CAST(c AS DOUBLE) / SUM(c) OVER () * CAST(SUM(c) OVER () - CEIL(CAST(0.3 AS DOUBLE) * SUM(c) OVER ()) AS DOUBLE) AS cont,
             SUM(c) OVER () - CEIL(CAST(0.3 AS DOUBLE) * SUM(c) OVER ()) AS draws FROM cc),
b AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cont - FLOOR(cont) DESC, label) AS rk, draws - SUM(FLOOR(cont)) OVER () AS need FROM a),
q1 AS (SELECT label, c, c - (CAST(FLOOR(cont) AS BIGINT) + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS q_temp FROM b),
a2 AS (SELECT *, CAST(q_temp AS DOUBLE) / SUM(q_temp) OVER () * CAST(SUM(q_temp) OVER () - CEIL(CAST(0.5 AS DOUBLE) * SUM(q_temp) OVER ()) AS DOUBLE) AS cont,
              SUM(q_temp) OVER () - CEIL(CAST(0.5 AS DOUBLE) * SUM(q_temp) OVER ()) AS draws FROM q1),
b2 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cont - FLOOR(cont) DESC, label) AS rk, draws - SUM(FLOOR(cont)) OVER () AS need FROM a2),
q AS (SELECT label, q_temp, q_temp - (CAST(FLOOR(cont) AS BIGINT) + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS q_test FROM b2),
r AS (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.label ORDER BY md5('42|' || CAST(study_id AS VARCHAR)), study_id) AS rk FROM s)
SELECT CASE WHEN rk <= q_test THEN 'test' WHEN rk <= q_temp THEN 'val' ELSE 'train' END AS split, r.label,
       COUNT(*) AS n, SUM(study_id)::BIGINT AS id_sum
FROM r JOIN q ON r.label = q.label GROUP BY ALL""")
def study_split(spark, sf):
    s = studies.study_label(SL(spark, sf))
    x = splits.stratified_shuffle_split(s, "label", "study_id", 0.3, 0.5, seed=42)
    return x.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("study_id").alias("id_sum"))


# Fixture choice: embeddings with label 3 play the unreadable image files.
def planes(spark, sf):
    e = Tables(spark, sf).embeddings
    return e.select("vec_id", studies.rescale_window("embedding", 1000.0, -500.0).alias("plane"),
                    (F.col("label") != 3).alias("readable"))


VOLUME_SQL = ORDERED_SQL + """,
pl AS (SELECT vec_id, list_transform(embedding, lambda x: (LEAST(GREATEST(CAST(x AS DOUBLE) * 1000.0 - 500.0, -1000.0), 400.0) + 1000.0) / 1400.0) AS plane,
              label <> 3 AS readable FROM embeddings),
x AS (SELECT o.study_id, o.pos, pl.plane, COALESCE(pl.readable, false) AS readable FROM o LEFT JOIN pl ON o.vec_id = pl.vec_id)"""


@register("stack_volume", "E16 E15", views=("slices",), oracle=f"""
WITH {VOLUME_SQL},
f AS (SELECT study_id, MIN(pos) AS first FROM x WHERE readable GROUP BY study_id),
k AS (SELECT x.study_id, x.pos - f.first AS z, CASE WHEN readable THEN list_sum(plane) ELSE 0.0 END AS s FROM x JOIN f ON x.study_id = f.study_id WHERE x.pos >= f.first)
SELECT study_id, CAST(z AS INTEGER) AS z, ROUND(s, 6) AS plane_sum FROM k
UNION ALL SELECT DISTINCT study_id, 0, 0.0 FROM x WHERE study_id NOT IN (SELECT study_id FROM f)""")
def stack_volume(spark, sf):
    v = studies.stack_volume(ordered(spark, sf), planes(spark, sf), 64, "zero")
    return r6(v.select("study_id", "z", F.aggregate("plane", F.lit(0.0), lambda a, b: a + b).alias("plane_sum")))


@register("stack_volume_skip", "E16 E15", views=("slices",), oracle=f"""
WITH {VOLUME_SQL},
k AS (SELECT study_id, ROW_NUMBER() OVER (PARTITION BY study_id ORDER BY pos) - 1 AS z, list_sum(plane) AS s FROM x WHERE readable)
SELECT study_id, CAST(z AS INTEGER) AS z, ROUND(s, 6) AS plane_sum FROM k
UNION ALL SELECT DISTINCT study_id, 0, 0.0 FROM x WHERE study_id NOT IN (SELECT study_id FROM k)""")
def stack_volume_skip(spark, sf):
    v = studies.stack_volume(ordered(spark, sf), planes(spark, sf), 64, "skip")
    return r6(v.select("study_id", "z", F.aggregate("plane", F.lit(0.0), lambda a, b: a + b).alias("plane_sum")))
