"""Catalogue: profiling of the patient table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import clean, profile
from tally.plans import fixtures as fx
from tally.plans.q_metrics import r6
from tally.plans.q_prep import FILLED_SQL, numeric_risk
from tally.plans.registry import register
from tally.sources.tables import Tables


def filled(spark, sf):
    return clean.impute(numeric_risk(spark, sf), {"balance": "median"})


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std,
       ROUND(MIN({c}), 6) AS min, ROUND(MAX({c}), 6) AS max, ROUND(quantile_cont({c}, 0.25), 6) AS q25,
       ROUND(quantile_cont({c}, 0.5), 6) AS q50, ROUND(quantile_cont({c}, 0.75), 6) AS q75 FROM nf"""


@register("describe", "A1", views=("risk_raw",), oracle=f"""
WITH {FILLED_SQL}
{_describe_sql('amount')} UNION ALL {_describe_sql('balance')} UNION ALL {_describe_sql('CAST(flag_a AS DOUBLE)').replace("'CAST(flag_a AS DOUBLE)'", "'flag_a'")}""")
def describe(spark, sf):
    return r6(profile.describe(filled(spark, sf), ["amount", "balance", "flag_a"]))


@register("info", "A2", views=("risk_raw",), oracle="""
SELECT 0 AS position, 'id' AS "column", 'bigint' AS dtype, COUNT(id) AS non_null, COUNT(*) AS rows FROM risk_raw
UNION ALL SELECT 1, 'segment', 'string', COUNT(segment), COUNT(*) FROM risk_raw
UNION ALL SELECT 2, 'priority', 'string', COUNT(priority), COUNT(*) FROM risk_raw
UNION ALL SELECT 3, 'status', 'string', COUNT(status), COUNT(*) FROM risk_raw
UNION ALL SELECT 4, 'flag_a', 'int', COUNT(flag_a), COUNT(*) FROM risk_raw
UNION ALL SELECT 5, 'amount', 'double', COUNT(amount), COUNT(*) FROM risk_raw
UNION ALL SELECT 6, 'balance_txt', 'string', COUNT(balance_txt), COUNT(*) FROM risk_raw
UNION ALL SELECT 7, 'y', 'int', COUNT(y), COUNT(*) FROM risk_raw""")
def info(spark, sf):
    from tally.plans.q_prep import R
    return profile.info(R(spark, sf))


@register("value_counts", "A3", views=("risk_raw",), oracle="""
SELECT priority, COUNT(*) AS count, ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 6) AS share
FROM risk_raw GROUP BY priority""")
def value_counts(spark, sf):
    from tally.plans.q_prep import R
    return r6(profile.value_counts(R(spark, sf), "priority"))


@register("class_ratio", "A3", views=("risk_raw",), oracle="""
SELECT y, COUNT(*) AS count, ROUND(COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 6) AS share
FROM risk_raw GROUP BY y""")
def class_ratio(spark, sf):
    from tally.plans.q_prep import R
    return r6(profile.value_counts(R(spark, sf), "y"))


@register("document_classes", "E10 L1", views=("doc_risk",), oracle="""
WITH c AS (SELECT lang, COUNT(*) AS n, SUM(y)::BIGINT AS n_pos FROM doc_risk GROUP BY lang)
SELECT lang, n, n_pos, n - n_pos AS n_neg, ROUND(CAST(n - n_pos AS DOUBLE) / n_pos, 6) AS scale_pos_weight,
       ROUND(SQRT(CAST(n - n_pos AS DOUBLE) / n_pos), 6) AS sqrt_pos_weight,
       ROUND(n / (CAST(2 AS DOUBLE) * (n - n_pos)), 6) AS weight_neg, ROUND(n / (CAST(2 AS DOUBLE) * n_pos), 6) AS weight_pos
FROM c""")
def document_classes(spark, sf):
    """Class weights of the second labelled table (documents with real labels) by language."""
    from tally.operators import encode
    return r6(encode.class_weights(fx.doc_risk(Tables(spark, sf)), "y", ["lang"]))


@register("crosstab", "A4", views=("risk_raw",), oracle="""
SELECT segment, SUM(CASE WHEN y = 0 THEN 1 ELSE 0 END)::BIGINT AS y_0, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END)::BIGINT AS y_1
FROM risk_raw GROUP BY segment""")
def crosstab(spark, sf):
    from tally.plans.q_prep import R
    return profile.crosstab(R(spark, sf), "segment", "y", [0, 1])


def _hist_sql(bins: int, keyed: bool) -> str:
    k = "y, " if keyed else ""
    part = "PARTITION BY y" if keyed else ""
    return f"""h0 AS (SELECT {k}amount AS v, MIN(amount) OVER ({part}) AS lo, MAX(amount) OVER ({part}) AS hi,
                 COUNT(*) OVER ({part}) AS n FROM nf),
h1 AS (SELECT {k}lo, hi, n, CASE WHEN hi = lo THEN 0 ELSE LEAST(CAST(FLOOR((v - lo) / ((hi - lo) / {bins}.0::DOUBLE)) AS INTEGER), {bins - 1}) END AS bin FROM h0)"""


@register("histogram", "A5", views=("risk_raw",), oracle=f"""
WITH {FILLED_SQL}, {_hist_sql(30, False)}
SELECT bin, COUNT(*) AS count, ROUND(lo + bin * (hi - lo) / 30.0::DOUBLE, 6) AS "left",
       ROUND(lo + (bin + 1) * (hi - lo) / 30.0::DOUBLE, 6) AS "right"
FROM h1 GROUP BY bin, lo, hi""")
def histogram(spark, sf):
    return r6(profile.histogram(filled(spark, sf), "amount", 30))


@register("histogram_density", "A5", views=("risk_raw",), oracle=f"""
WITH {FILLED_SQL}, {_hist_sql(50, True)}
SELECT y, bin, COUNT(*) AS count, ROUND(lo + bin * (hi - lo) / 50.0::DOUBLE, 6) AS "left",
       ROUND(lo + (bin + 1) * (hi - lo) / 50.0::DOUBLE, 6) AS "right",
       ROUND(COUNT(*) / (n * (hi - lo) / 50.0::DOUBLE) * 1e6, 6) AS density_e6
FROM h1 GROUP BY y, bin, lo, hi, n""")
def histogram_density(spark, sf):
    h = profile.histogram(filled(spark, sf), "amount", 50, keys=["y"], density=True)
    return r6(h.withColumn("density_e6", F.col("density") * 1e6).drop("density"))


@register("kde", "A6", views=("risk_raw",), oracle=f"""
WITH {FILLED_SQL},
st AS (SELECT MIN(amount) AS lo, MAX(amount) AS hi, COUNT(*) AS n, STDDEV_SAMP(amount) * POW(CAST(COUNT(*) AS DOUBLE), -0.2) AS bw FROM nf),
g AS (SELECT i, lo + i * (hi - lo) / 49.0::DOUBLE AS x FROM st, range(0, 50) r(i))
SELECT CAST(g.i AS INTEGER) AS i, ROUND(g.x, 6) AS x, ROUND(SUM(EXP(-0.5 * ((g.x - nf.amount) / bw) * ((g.x - nf.amount) / bw))) / (n * bw * SQRT(2 * PI())) * 1e6, 6) AS density_e6
FROM g, nf, st GROUP BY g.i, g.x, n, bw""")
def kde(spark, sf):
    k = profile.kde(filled(spark, sf), "amount", 50)
    return k.select("i", F.round("x", 6).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density_e6"))


@register("boxplot_stats", "A7", views=("risk_raw",), oracle=f"""
WITH {FILLED_SQL},
q AS (SELECT y, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS median, quantile_cont(amount, 0.75) AS q3
      FROM nf GROUP BY y),
x AS (SELECT nf.y, amount, q1, median, q3, q3 - q1 AS iqr,
             amount >= q1 - 1.5 * (q3 - q1) AND amount <= q3 + 1.5 * (q3 - q1) AS inside FROM nf JOIN q USING (y))
SELECT y, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3, ROUND(iqr, 6) AS iqr,
       ROUND(MIN(CASE WHEN inside THEN amount END), 6) AS whisker_low, ROUND(MAX(CASE WHEN inside THEN amount END), 6) AS whisker_high,
       SUM(CASE WHEN inside THEN 0 ELSE 1 END)::BIGINT AS n_outliers, COUNT(*) AS n
FROM x GROUP BY y, q1, median, q3, iqr""")
def boxplot_stats(spark, sf):
    return r6(profile.boxplot_stats(filled(spark, sf), "amount", "y"))


@register("head", "W5", views=("risk_raw",), oracle="""
SELECT id, segment, priority, status, amount FROM risk_raw ORDER BY id LIMIT 5""")
def head(spark, sf):
    from tally.plans.q_prep import R
    return profile.head(R(spark, sf).select("id", "segment", "priority", "status", "amount"), 5, "id")
