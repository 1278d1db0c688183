"""Fixture views: the reference's input shapes built from the driver tables.

Each function maps the TPC-H-like driver tables onto one input the reference
consumes (patient table, pooled predictions, epoch history, study slices, trial
records, labelled documents, image tiles, image paths). The same definitions,
as SQL text, are inlined as CTEs in the DuckDB oracle (``plans/views_sql.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.sources.tables import Tables

# Fixed values of the `scored` fixture: model name, salt k and positive boost.
SCORED_MODELS = (("m1", 1, 29), ("m2", 2, 20), ("m3", 3, 8))
SCORED_REPEATS = (1, 2, 3)


def risk_raw(t: Tables) -> DataFrame:
    """Patient-file stand-in: categoricals, a flag, a clean and a dirty numeric, target y."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    c = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    k = F.col("o_orderkey")
    cutoff = F.when(F.col("o_totalprice") > 375000, 28).otherwise(9)
    return o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("id"),
        F.col("c_mktsegment").alias("segment"),
        F.when(k % 997 == 0, F.lit("Other")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
        (k % 2).cast("int").alias("flag_a"),
        F.col("o_totalprice").alias("amount"),
        F.when(k % 25 == 0, F.lit(None).cast("string"))
        .when(k % 40 == 1, F.lit("N/A"))
        .otherwise(F.round(F.col("c_acctbal") * 100).cast("bigint").cast("string"))
        .alias("balance_txt"),
        F.when((k * 37) % 100 < cutoff, 1).otherwise(0).alias("y"),
    )


def scored(t: Tables) -> DataFrame:
    """Pooled predictions: 3 models x 3 repeats per risk row, 10 folds, 3 splits.

    The 9x fan-out is a generator (explode of a literal array), not a join.
    """
    combos = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(k).alias("k"), F.lit(b).alias("boost"), F.lit(r).alias("rep"))
        for (m, k, b) in SCORED_MODELS for r in SCORED_REPEATS
    ])
    fold = (F.floor(F.col("id") / F.lit(100.0)).cast("int") % 10)
    base = risk_raw(t).select("id", "y").select("id", "y", F.explode(combos).alias("c"))
    return base.select(
        "id",
        F.col("c.model").alias("model"),
        F.col("c.rep").alias("repeat"),
        fold.alias("fold"),
        F.when(fold < 7, "train").when(fold == 7, "val").otherwise("test").alias("split"),
        "y",
        (((F.col("id") * 37 + F.col("c.k") * 13 + F.col("c.rep") * 7) % 71 + F.col("y") * F.col("c.boost"))
         .cast("double") / F.lit(100.0)).alias("score"),
    )


def history(t: Tables) -> DataFrame:
    """Epoch history: one row per (run, epoch)."""
    e = t.events
    return (
        e.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").cast("int").alias("epoch"))
        .agg(
            F.round(F.avg("value"), 6).alias("val_loss"),
            F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("val_auc"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def slices(t: Tables) -> DataFrame:
    """Study index: one row per slice with its position, label, score and feature id."""
    e = t.events
    return e.select(
        F.col("user_id").alias("study_id"),
        F.col("event_id").alias("slice_id"),
        F.col("ts").alias("z_pos"),
        F.when(F.col("value") > 245, 1).otherwise(0).alias("label"),
        F.when(F.col("value") > 490, F.lit(1.0)).otherwise(F.col("value") / 490).alias("slice_score"),
        (F.col("event_id") % t.embeddings.select(F.count(F.lit(1))).scalar()).alias("vec_id"),
    )


def trials(t: Tables) -> DataFrame:
    """Best-parameter records: one row per (model, run)."""
    p = t.part
    return p.select(
        F.col("p_brand").alias("model"),
        F.col("p_partkey").cast("int").alias("run"),
        (F.floor(F.col("p_partkey") / F.lit(10.0)).cast("int") % 3 + 1).alias("repeat"),
        F.col("p_type").alias("param_a"),
        (F.col("p_size") % 3).cast("string").alias("param_b"),
    )


def fits(t: Tables) -> DataFrame:
    """Training times: one row per fit with its model and seconds (models m1 and m2 only)."""
    return t.lineitem.select(F.concat(F.lit("m"), (F.col("l_linenumber") % 2 + 1).cast("string")).alias("model"),
                             F.col("l_orderkey").alias("fit"), F.col("l_quantity").alias("seconds"))


def doc_risk(t: Tables) -> DataFrame:
    """Second labelled table (documents with real toxicity labels)."""
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    lab = t.labels.select("doc_id", "toxic", "quality")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"), "lang", "source", "n_chars", F.col("toxic").alias("y"), "quality")


def tiles(t: Tables) -> DataFrame:
    """8x8 one-channel images (64 floats) with a label."""
    e = t.embeddings
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("px"),
                    F.when(F.col("label") == 0, 1).otherwise(0).alias("y"))


def image_paths(t: Tables) -> DataFrame:
    """Backslash-separated relative image paths; the class is the directory name."""
    d = t.documents
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("images\\"), F.col("source"), F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".png"))
        .alias("image_path"),
    )
