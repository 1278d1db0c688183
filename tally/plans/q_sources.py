"""Catalogue: sources and sinks as round trips through written files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tally.operators import clean, encode
from tally.plans import fixtures as fx
from tally.plans.q_metrics import COMPARE_MODELS_SQL, compare_models
from tally.plans.q_prep import CATS
from tally.plans.registry import ORACLE, register
from tally.session import checkpoint_dir
from tally.sources import images, sinks, tables
from tally.sources.tables import Tables


def _path(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}/{uuid.uuid4().hex}"


@register("read_csv", "S1", views=("risk_raw",), oracle="""
SELECT id, TRY_CAST(CASE WHEN id % 11 = 3 OR balance_txt = 'N/A' THEN NULL ELSE balance_txt END AS DOUBLE) AS balance,
       CASE WHEN id % 13 = 5 THEN NULL ELSE segment END AS segment FROM risk_raw""")
def read_csv(spark, sf):
    """A CSV file with several spellings of missing values, read with a schema."""
    r = fx.risk_raw(Tables(spark, sf))
    path = _path(spark, "csv")
    spelt = F.element_at(F.array(*[F.lit(t) for t in ("NA", "null", "-nan", "#N/A", "")]), (F.col("id") % 5 + 1).cast("int"))
    r.select("id", F.when(F.col("id") % 11 == 3, spelt).otherwise(F.col("balance_txt")).alias("balance"),
             F.when(F.col("id") % 13 == 5, F.lit("None")).otherwise(F.col("segment")).alias("segment"),
             ).write.option("header", True).csv(path)
    schema = spark.createDataFrame([], "id long, balance double, segment string").schema
    return tables.read_table(spark, path, schema, "csv")


@register("image_folder", "S2 S3", views=("image_paths",), oracle="""
WITH m AS (SELECT id, string_split(replace(image_path, chr(92), '/'), '/')[-2] AS class FROM image_paths),
c AS (SELECT class, COUNT(*) AS n, CEIL(CAST(0.2 AS DOUBLE) * COUNT(*)) AS q_test FROM m GROUP BY class),
q AS (SELECT class, q_test, CEIL(CAST(0.125 AS DOUBLE) * (n - q_test)) AS q_val FROM c),
r AS (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY class ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS rk FROM m),
f AS (SELECT r.id, CASE WHEN rk <= q_test THEN 'test' WHEN rk <= q_test + q_val THEN 'val' ELSE 'train' END AS split, r.class FROM r JOIN q ON r.class = q.class),
l AS (SELECT class, CAST(DENSE_RANK() OVER (ORDER BY class) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT class FROM f))
SELECT split, class, label, COUNT(*) AS n FROM f JOIN l USING (class) GROUP BY ALL""")
def image_folder(spark, sf):
    """Every class split 70/10/20, written as files in folders ``split/class`` and listed again with their content."""
    p = fx.image_paths(Tables(spark, sf)).select("id", images.class_of("image_path").alias("class"))
    root = _path(spark, "folder")
    images.split_folder(p.withColumn("value", F.col("id")), root)
    found = images.read_image_folder(spark, root, with_content=True, pattern="part-*")
    lines = F.length(F.regexp_replace(F.col("content").cast("string"), "[^\\n]", ""))
    folder = lambda c: F.regexp_replace(c, "^.*=", "")
    out = found.select(folder(images.class_of("path", 3)).alias("split"), folder(F.col("class")).alias("class"), "label", lines.alias("n"))
    return out.groupBy("split", "class", "label").agg(F.sum("n").alias("n"))


@register("state_round_trip", "S8 E1", views=("risk_raw",), oracle=None)
def state_round_trip(spark, sf):
    """Label codes saved as fitted state and loaded again."""
    r = fx.risk_raw(Tables(spark, sf))
    path = _path(spark, "state")
    sinks.save_state({"codes": encode.code_table(r, CATS)}, None, path)
    loaded, _ = sinks.load_state(spark, path, ["codes"], with_model=False)
    return loaded["codes"]


ORACLE["state_round_trip"] = ORACLE["label_code_table"]


@register("write_read_metrics", "S9 M16", views=("scored",), oracle=COMPARE_MODELS_SQL)
def write_read_metrics(spark, sf):
    """The model comparison written as JSON lines and read back."""
    rep = compare_models(spark, sf)
    path = _path(spark, "metrics")
    sinks.write_metrics(rep, path)
    return spark.read.schema(rep.schema).json(path)


@register("clean_vectors", "P6", views=("tiles",), oracle="""
SELECT id, CASE WHEN id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE ROUND(CAST(px[1] AS DOUBLE), 6) END AS v0,
       CASE WHEN id % 3 = 1 THEN CAST(0 AS DOUBLE) ELSE ROUND(CAST(px[2] AS DOUBLE), 6) END AS v1, ROUND(CAST(px[3] AS DOUBLE), 6) AS v2
FROM tiles""")
def clean_vectors(spark, sf):
    """Vectors with NaN and infinite components."""
    t = fx.tiles(Tables(spark, sf))
    k = F.col("id") % 3
    bad = F.when((k == 0), F.lit(float("nan"))), F.when(k == 1, F.when(F.col("id") % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    px = F.transform("px", lambda x, i: F.when((i == 0) & (k == 0), bad[0]).when((i == 1) & (k == 1), bad[1]).otherwise(x.cast("double")))
    v = t.select("id", clean.clean_vector(px).alias("v"))
    return v.select("id", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(3)])


@register("align_frame", "E4 U3", views=("risk_raw",), oracle="""
SELECT id, amount, CAST(0 AS INTEGER) AS absent, status FROM risk_raw""")
def align_frame(spark, sf):
    """A raw frame forced to the columns of another: missing ones are 0, extra ones go."""
    return encode.align_columns(fx.risk_raw(Tables(spark, sf)), ["id", "amount", "absent", "status"])
