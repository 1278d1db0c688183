"""Catalogue: cleaning, encoding and splitting of the patient table (risk_raw)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.operators import clean, encode, splits
from tally.plans import fixtures as fx
from tally.plans.registry import dsql, register
from tally.plans.sqlparts import stratified_split_ctes
from tally.session import checkpoint_dir
from tally.sources.tables import Tables

CATS = ["segment", "priority", "status"]


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """risk_raw -> to_numeric(balance) -> exclude 'Other' -> median impute -> label codes."""
    r = clean.impute(numeric_risk(spark, sf), {"balance": "median"})
    return encode.label_encode(r, CATS)


PREPARED_SQL = """
base AS (
  SELECT id, segment, priority, status, flag_a, amount, y,
         TRY_CAST(CASE WHEN balance_txt = 'N/A' THEN NULL ELSE balance_txt END AS DOUBLE) AS balance
  FROM risk_raw WHERE priority IS DISTINCT FROM 'Other'),
filled AS (SELECT * REPLACE (COALESCE(balance, (SELECT quantile_cont(balance, 0.5) FROM base)) AS balance) FROM base),
prepared AS (
  SELECT f.id, f.flag_a, f.amount, f.y, f.balance,
         (SELECT COUNT(DISTINCT segment) FROM filled x WHERE x.segment < f.segment) AS segment,
         (SELECT COUNT(DISTINCT priority) FROM filled x WHERE x.priority < f.priority) AS priority,
         (SELECT COUNT(DISTINCT status) FROM filled x WHERE x.status < f.status) AS status
  FROM filled f)"""


@register("risk_split_balance", "P2 P3 P4 E1 R1 E10", views=("risk_raw",), oracle=f"""
WITH {PREPARED_SQL},
{stratified_split_ctes('prepared')},
g AS (SELECT split, y, COUNT(*) AS n, AVG(amount) AS a, AVG(balance) AS b, AVG(segment) AS s
      FROM splitted GROUP BY split, y)
SELECT split, y, n, ROUND(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY split), 6) AS share,
       ROUND(CAST(SUM(n) OVER (PARTITION BY split) AS DOUBLE) / (2 * n), 6) AS balanced_weight,
       ROUND(a, 6) AS mean_amount, ROUND(b, 6) AS mean_balance, ROUND(s, 6) AS mean_segment_code
FROM g""")
def risk_split_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Is every split equally imbalanced after cleaning? Class share and means per (split, class)."""
    r = splits.stratified_split(prepared(spark, sf), "y", "id", test=0.2, val=0.1, seed=42)
    g = r.groupBy("split", "y").agg(
        F.count(F.lit(1)).alias("n"), F.avg("amount").alias("a"), F.avg("balance").alias("b"),
        F.avg("segment").alias("s"))
    w = Window.partitionBy("split")
    return g.select(
        "split", "y", "n",
        F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"),
        F.round(F.sum("n").over(w).cast("double") / (2 * F.col("n")), 6).alias("balanced_weight"),
        F.round("a", 6).alias("mean_amount"), F.round("b", 6).alias("mean_balance"),
        F.round("s", 6).alias("mean_segment_code"),
    )


# ------------------------------------------------------------------ helpers
def R(spark: SparkSession, sf: str) -> DataFrame:
    return fx.risk_raw(Tables(spark, sf))


def numeric_risk(spark: SparkSession, sf: str) -> DataFrame:
    """risk_raw with balance parsed (P2) and the 'Other' priority excluded.

    Materialised once (checkpoint in the shared folder): the fitted statistics
    (median, levels, class quotas, scaling) each need a pass, and those passes
    read this narrow cleaned table instead of re-running the source join.
    """
    checkpoint_dir(spark)
    r = clean.to_numeric(R(spark, sf), "balance_txt", out="balance").drop("balance_txt")
    return clean.exclude_value(r, "priority", "Other").checkpoint(eager=True)


def r6(df: DataFrame) -> DataFrame:
    from tally.plans.q_metrics import r6 as _r6
    return _r6(df)


NUMERIC_SQL = """nr AS (
  SELECT id, segment, priority, status, flag_a, amount, y,
         TRY_CAST(CASE WHEN balance_txt = 'N/A' THEN NULL ELSE balance_txt END AS DOUBLE) AS balance
  FROM risk_raw WHERE priority IS DISTINCT FROM 'Other')"""

FILLED_SQL = NUMERIC_SQL + """,
nf AS (SELECT * REPLACE (COALESCE(balance, (SELECT quantile_cont(balance, 0.5) FROM nr)) AS balance) FROM nr)"""


def split_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Filled table with the 70/10/20 stratified split column, materialised once.

    Train-fitted steps (levels, scaling, weights, models) each read the split; a
    checkpoint keeps them from replaying impute + rank for every pass (the
    reference writes its split files for the same reason).
    """
    r = clean.impute(numeric_risk(spark, sf), {"balance": "median"})
    return splits.stratified_split(r, "y", "id", 0.2, 0.1, seed=42).checkpoint(eager=True)


SPLIT_SQL = FILLED_SQL + ",\n" + stratified_split_ctes("nf", name="sp")


# ------------------------------------------------------------------ P1 / P2 / P3 / P4
@register("drop_columns", "P1 S1", views=("risk_raw",), oracle="""
SELECT id, segment, priority, status, amount, y FROM risk_raw""")
def drop_columns(spark, sf):
    return clean.drop_columns(R(spark, sf), ["balance_txt", "flag_a", "not_a_column"])


@register("to_numeric", "P2", views=("risk_raw",), oracle="""
SELECT id, TRY_CAST(CASE WHEN balance_txt = 'N/A' THEN NULL ELSE balance_txt END AS DOUBLE) AS balance FROM risk_raw""")
def to_numeric(spark, sf):
    return clean.to_numeric(R(spark, sf), "balance_txt", out="balance").select("id", "balance")


@register("exclude_value", "P3", views=("risk_raw",), oracle="""
SELECT priority, COUNT(*) AS n FROM risk_raw WHERE priority IS DISTINCT FROM 'Other' GROUP BY priority""")
def exclude_value(spark, sf):
    return clean.exclude_value(R(spark, sf), "priority", "Other").groupBy("priority") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("impute", "P4", views=("risk_raw",), oracle=f"""
WITH {NUMERIC_SQL},
md AS (SELECT (SELECT quantile_cont(balance, 0.5) FROM nr) AS med, (SELECT AVG(amount) FROM nr) AS mu,
              (SELECT segment FROM nr WHERE segment IS NOT NULL GROUP BY segment ORDER BY COUNT(*) DESC, segment LIMIT 1) AS mo)
SELECT id, ROUND(COALESCE(balance, med), 6) AS balance,
       ROUND(COALESCE(CASE WHEN id % 7 = 0 THEN NULL ELSE amount END, mu), 6) AS amount,
       COALESCE(CASE WHEN id % 11 = 0 THEN NULL ELSE segment END, mo) AS segment
FROM nr, md""")
def impute(spark, sf):
    """Median fill of the dirty balance; mean and mode fills on columns with injected holes."""
    r = numeric_risk(spark, sf)
    holes = r.withColumns({
        "amount": F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("amount")),
        "segment": F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("segment")),
    })
    out = clean.impute(holes, {"balance": "median", "amount": "mean", "segment": "mode"}, fit=r)
    return r6(out.select("id", "balance", "amount", "segment"))


@register("impute_stats", "P4 A1", views=("risk_raw",), oracle=f"""
WITH {NUMERIC_SQL}
SELECT 'amount' AS "column", ROUND(AVG(amount), 6) AS mean, ROUND(quantile_cont(amount, 0.5), 6) AS median,
       (SELECT amount FROM nr GROUP BY amount ORDER BY COUNT(*) DESC, amount LIMIT 1) AS mode FROM nr
UNION ALL
SELECT 'balance', ROUND(AVG(balance), 6), ROUND(quantile_cont(balance, 0.5), 6),
       (SELECT balance FROM nr WHERE balance IS NOT NULL GROUP BY balance ORDER BY COUNT(*) DESC, balance LIMIT 1) FROM nr""")
def impute_stats(spark, sf):
    r = numeric_risk(spark, sf)
    parts = []
    for c in ("amount", "balance"):
        f = clean.fill_values(r, {c: "median"})[c]
        mode = clean.fill_values(r, {c: "mode"})[c]
        parts.append(r.agg(F.avg(c).alias("mean")).select(
            F.lit(c).alias("column"), "mean", f.alias("median"), mode.cast("double").alias("mode")))
    return r6(parts[0].unionByName(parts[1]))


# ------------------------------------------------------------------ E1 / E2 / J5 / P5
@register("label_encode", "E1 J5", views=("risk_raw",), oracle="""
SELECT r.id,
       CAST(DENSE_RANK() OVER (ORDER BY segment) - 1 AS INTEGER) AS segment,
       CAST(DENSE_RANK() OVER (ORDER BY priority) - 1 AS INTEGER) AS priority,
       CAST(DENSE_RANK() OVER (ORDER BY status) - 1 AS INTEGER) AS status,
       CAST(DENSE_RANK() OVER (ORDER BY flag_a) - 1 AS INTEGER) AS flag_a
FROM risk_raw r""")
def label_encode(spark, sf):
    return encode.label_encode(R(spark, sf), [*CATS, "flag_a"]).select("id", *CATS, "flag_a")


@register("label_code_table", "E1 S8", views=("risk_raw",), oracle="""
SELECT 'segment' AS "column", segment AS value, CAST(ROW_NUMBER() OVER (ORDER BY segment) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT segment FROM risk_raw)
UNION ALL SELECT 'priority', priority, CAST(ROW_NUMBER() OVER (ORDER BY priority) - 1 AS INTEGER) FROM (SELECT DISTINCT priority FROM risk_raw)
UNION ALL SELECT 'status', status, CAST(ROW_NUMBER() OVER (ORDER BY status) - 1 AS INTEGER) FROM (SELECT DISTINCT status FROM risk_raw)""")
def label_code_table(spark, sf):
    """E1 state as a table, built with the distributed dense index (the path for huge vocabularies)."""
    return encode.code_table(R(spark, sf), CATS)


@register("cardinalities", "E2", views=("risk_raw",), oracle="""
SELECT 'segment' AS "column", COUNT(DISTINCT segment) AS n_unique,
       COUNT(DISTINCT segment) + MAX(CASE WHEN segment IS NULL THEN 1 ELSE 0 END) AS n_unique_with_null FROM risk_raw
UNION ALL SELECT 'priority', COUNT(DISTINCT priority), COUNT(DISTINCT priority) + MAX(CASE WHEN priority IS NULL THEN 1 ELSE 0 END) FROM risk_raw
UNION ALL SELECT 'status', COUNT(DISTINCT status), COUNT(DISTINCT status) + MAX(CASE WHEN status IS NULL THEN 1 ELSE 0 END) FROM risk_raw
UNION ALL SELECT 'balance_txt', COUNT(DISTINCT balance_txt), COUNT(DISTINCT balance_txt) + MAX(CASE WHEN balance_txt IS NULL THEN 1 ELSE 0 END) FROM risk_raw""")
def cardinalities(spark, sf):
    return encode.cardinalities(R(spark, sf), [*CATS, "balance_txt"])


@register("typed_features", "P5 D3", views=("risk_raw",), oracle=f"""
WITH {FILLED_SQL}
SELECT id, CAST(flag_a AS FLOAT) AS label, [CAST(y AS BIGINT), CAST(flag_a AS BIGINT)] AS x_categ,
       [CAST(amount AS FLOAT), CAST(balance AS FLOAT)] AS x_cont FROM nf""")
def typed_features(spark, sf):
    r = clean.impute(numeric_risk(spark, sf), {"balance": "median"})
    t = clean.typed_features(r.select("id", "y", "flag_a", "amount", "balance").withColumn("lab", F.col("flag_a")),
                             ["y", "flag_a"], ["amount", "balance"], "lab")
    return t.select("id", "label", "x_categ", "x_cont")


# ------------------------------------------------------------------ E3 / E4 / E5
@register("one_hot", "E3", views=("risk_raw",), oracle="""
SELECT id, CASE WHEN segment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS segment_AUTOMOBILE,
       CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END AS segment_BUILDING,
       CASE WHEN segment = 'FURNITURE' THEN 1 ELSE 0 END AS segment_FURNITURE,
       CASE WHEN segment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS segment_HOUSEHOLD,
       CASE WHEN segment = 'MACHINERY' THEN 1 ELSE 0 END AS segment_MACHINERY
FROM risk_raw""")
def one_hot(spark, sf):
    return encode.one_hot(R(spark, sf).select("id", "segment"), "segment")


@register("align_one_hot", "E4 E5", views=("risk_raw",), oracle=f"""
WITH {SPLIT_SQL}
SELECT id, split, CASE WHEN priority = '2-HIGH' THEN 1 ELSE 0 END AS priority_2_HIGH,
       CASE WHEN priority = '3-MEDIUM' THEN 1 ELSE 0 END AS priority_3_MEDIUM,
       CASE WHEN priority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS "priority_4_NOT SPECIFIED",
       CASE WHEN priority = '5-LOW' THEN 1 ELSE 0 END AS priority_5_LOW
FROM sp WHERE split <> 'train'""")
def align_one_hot(spark, sf):
    """Levels fitted on train (first level dropped), applied to val and test."""
    s = split_risk(spark, sf)
    lv = encode.levels(s.where(F.col("split") == "train"), "priority")
    out = encode.one_hot(s.where(F.col("split") != "train").select("id", "split", "priority"), "priority", lv,
                         drop_first=True)
    return out.select("id", "split", *[F.col(f"`{c}`").alias(c.replace("-", "_")) for c in out.columns[2:]])


# ------------------------------------------------------------------ E6 / E7 / E8 / E10
@register("standard_scale", "E6", views=("risk_raw",), oracle=f"""
WITH {SPLIT_SQL},
st AS (SELECT AVG(amount) AS ma, STDDEV_POP(amount) AS sa, AVG(balance) AS mb, STDDEV_POP(balance) AS sb FROM sp WHERE split = 'train')
SELECT id, split, ROUND((amount - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END, 6) AS amount,
       ROUND((balance - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END, 6) AS balance,
       CAST(0 AS DOUBLE) AS flag_const
FROM sp, st""")
def standard_scale(spark, sf):
    s = split_risk(spark, sf).withColumn("flag_const", F.lit(3.0))  # no variance: divided by 1
    out = encode.standard_scale(s, ["amount", "balance", "flag_const"], fit=s.where(F.col("split") == "train"))
    return r6(out.select("id", "split", "amount", "balance", "flag_const"))


@register("mean_std", "E7", views=("risk_raw",), oracle=f"""
WITH {FILLED_SQL}
SELECT 'amount' AS "column", ROUND(AVG(amount), 6) AS mean, ROUND(STDDEV_SAMP(amount), 6) AS std FROM nf
UNION ALL SELECT 'balance', ROUND(AVG(balance), 6), ROUND(STDDEV_SAMP(balance), 6) FROM nf
UNION ALL SELECT 'flag_a', ROUND(AVG(flag_a), 6), ROUND(STDDEV_SAMP(flag_a), 6) FROM nf""")
def mean_std(spark, sf):
    r = clean.impute(numeric_risk(spark, sf), {"balance": "median"})
    return r6(encode.mean_std(r, ["amount", "balance", "flag_a"]))


@register("column_transformer", "E8 E5 E6", views=("risk_raw",), oracle=f"""
WITH {SPLIT_SQL},
st AS (SELECT AVG(amount) AS ma, STDDEV_POP(amount) AS sa, AVG(balance) AS mb, STDDEV_POP(balance) AS sb FROM sp WHERE split = 'train')
SELECT id, split, flag_a, y, ROUND((amount - ma) / sa, 6) AS amount, ROUND((balance - mb) / sb, 6) AS balance,
       CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END AS segment_BUILDING,
       CASE WHEN segment = 'FURNITURE' THEN 1 ELSE 0 END AS segment_FURNITURE,
       CASE WHEN segment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS segment_HOUSEHOLD,
       CASE WHEN segment = 'MACHINERY' THEN 1 ELSE 0 END AS segment_MACHINERY,
       CASE WHEN status = 'O' THEN 1 ELSE 0 END AS status_O,
       CASE WHEN status = 'P' THEN 1 ELSE 0 END AS status_P
FROM sp, st""")
def column_transformer(spark, sf):
    s = split_risk(spark, sf).select("id", "split", "flag_a", "y", "amount", "balance", "segment", "status")
    prep = encode.Prep(numeric=["amount", "balance"], categorical=["segment", "status"]).fit(
        s.where(F.col("split") == "train"))
    return r6(prep.transform(s).drop("priority"))


@register("class_weights", "E10", views=("risk_raw",), oracle=f"""
WITH {SPLIT_SQL},
c AS (SELECT split, COUNT(*) AS n, SUM(y)::BIGINT AS n_pos FROM sp GROUP BY split)
SELECT split, n, n_pos, n - n_pos AS n_neg, ROUND(CAST(n - n_pos AS DOUBLE) / n_pos, 6) AS scale_pos_weight,
       ROUND(SQRT(CAST(n - n_pos AS DOUBLE) / n_pos), 6) AS sqrt_pos_weight,
       ROUND(n / (CAST(2 AS DOUBLE) * (n - n_pos)), 6) AS weight_neg, ROUND(n / (CAST(2 AS DOUBLE) * n_pos), 6) AS weight_pos
FROM c""")
def class_weights(spark, sf):
    return r6(encode.class_weights(split_risk(spark, sf), "y", ["split"]))


# ------------------------------------------------------------------ R4 / R5 / U1 / J3
def kfold_sql(src: str, k: int, seeds: list[int], name: str = "kf") -> str:
    parts = []
    for r, seed in enumerate(seeds, start=1):
        parts.append(f"""SELECT s.*, {r} AS repeat,
       CAST((COALESCE(o.off, 0) + ROW_NUMBER() OVER (PARTITION BY s.y ORDER BY md5('{seed}|' || CAST(s.id AS VARCHAR)), s.id) - 1) % {k} AS INTEGER) AS fold
FROM {src} s JOIN (SELECT y, SUM(COUNT(*)) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off
                   FROM {src} GROUP BY y) o ON s.y = o.y""")
    return f"{name} AS (\n" + "\nUNION ALL\n".join(parts) + ")"


@register("stratified_kfold", "R4", views=("risk_raw",), oracle=f"""
WITH {FILLED_SQL}, {kfold_sql('nf', 10, [42, 43, 44])}
SELECT repeat, fold, y, COUNT(*) AS n, SUM(id)::BIGINT AS id_sum FROM kf GROUP BY repeat, fold, y""")
def stratified_kfold(spark, sf):
    r = clean.impute(numeric_risk(spark, sf), {"balance": "median"})
    f = splits.repeated_kfold(r, "y", "id", k=10, repeats=3, seed=42)
    return f.groupBy("repeat", "fold", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@register("holdout_from_fold", "R5", views=("risk_raw",), oracle=f"""
WITH {FILLED_SQL}, {kfold_sql('nf', 10, [42])},
tr AS (SELECT f.fold AS held, k.* FROM (SELECT DISTINCT fold FROM kf) f JOIN kf k ON k.fold <> f.fold),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY held ORDER BY md5('7|' || CAST(id AS VARCHAR)), id) AS r,
              COUNT(*) OVER (PARTITION BY held) AS n FROM tr)
SELECT held AS fold, CASE WHEN r <= FLOOR({dsql(0.8)} * n) THEN 'fit' ELSE 'holdout' END AS part,
       COUNT(*) AS n, SUM(y)::BIGINT AS n_pos
FROM rk GROUP BY ALL""")
def holdout_from_fold(spark, sf):
    """For each outer fold: its training part (other folds) split 80/20 without stratification."""
    r = clean.impute(numeric_risk(spark, sf), {"balance": "median"})
    f = splits.stratified_kfold(r, "y", "id", k=10, seed=42)
    tr = f.withColumn("fold_out", F.explode(F.sequence(F.lit(0), F.lit(9)))).where(F.col("fold") != F.col("fold_out"))
    h = splits.holdout_from_fold(tr.drop("fold").withColumnRenamed("fold_out", "fold"), "id", 0.8, seed=7,
                                 group_cols=["fold"])
    return h.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))


@register("union_splits", "U1 J3", views=("risk_raw",), oracle=f"""
WITH {SPLIT_SQL}
SELECT y, COUNT(*) AS n, ROUND(AVG(amount), 6) AS mean_amount FROM sp WHERE split IN ('train', 'val') GROUP BY y""")
def union_splits(spark, sf):
    """Train + val pooled (UNION ALL of the two parts), features re-paired with labels by id."""
    s = split_risk(spark, sf)
    x = s.where(F.col("split") == "train").unionByName(s.where(F.col("split") == "val"))
    feats, labels = x.select("id", "amount"), x.select("id", "y")
    return r6(feats.join(labels, "id").groupBy("y").agg(F.count(F.lit(1)).alias("n"),
                                                         F.avg("amount").alias("mean_amount")))


# ------------------------------------------------------------------ E9 / J6
SMOTE_FEATURES = ["segment", "priority", "status", "flag_a", "amount", "balance"]


def smote_train(spark: SparkSession, sf: str) -> DataFrame:
    """Label-encoded, imputed, split table (SMOTE runs after encoding, before scaling)."""
    checkpoint_dir(spark)
    return splits.stratified_split(prepared(spark, sf), "y", "id", 0.2, 0.1, seed=42) \
        .where(F.col("split") == "train").checkpoint(eager=True)


_d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in SMOTE_FEATURES)


@register("knn_minority", "J6 E9", views=("risk_raw",), oracle=f"""
WITH {PREPARED_SQL},
{stratified_split_ctes('prepared')},
m AS (SELECT id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SMOTE_FEATURES)} FROM splitted WHERE split = 'train' AND y = 1),
d AS (SELECT a.id, b.id AS nn_id, {_d2} AS dist2 FROM m a JOIN m b ON a.id <> b.id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY dist2, nn_id) AS nn_rank FROM d)
SELECT id, CAST(nn_rank AS INTEGER) AS nn_rank, nn_id, ROUND(SQRT(dist2), 6) AS dist FROM r WHERE nn_rank <= 5""")
def knn_minority(spark, sf):
    """Exact 5 nearest minority neighbours of every minority training row (the SMOTE neighbour stage)."""
    from tally.operators import resample
    t = smote_train(spark, sf).where(F.col("y") == 1)
    pts = t.select("id", F.array(*[F.col(c).cast("double") for c in SMOTE_FEATURES]).alias("v"))
    nn = resample.knn(pts, "id", "v", len(SMOTE_FEATURES), k=5)
    return r6(nn.select("id", "nn_rank", "nn_id", F.sqrt("dist2").alias("dist")))


@register("smote", "E9", views=("risk_raw",), oracle=f"""
WITH {PREPARED_SQL},
{stratified_split_ctes('prepared')},
tr AS (SELECT * FROM splitted WHERE split = 'train')
SELECT y, false AS synthetic, COUNT(*) AS n FROM tr GROUP BY y
UNION ALL
SELECT 1, true, (SELECT COUNT(*) FROM tr WHERE y = 0) - (SELECT COUNT(*) FROM tr WHERE y = 1)""")
def smote(spark, sf):
    """Train split oversampled to class parity; synthetic rows counted per label."""
    from tally.operators import resample
    out = resample.smote(smote_train(spark, sf), "y", "id", SMOTE_FEATURES, k=5, seed=42)
    return out.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("stratified_split_72_8_20", "R1", views=("risk_raw",), oracle=f"""
WITH {FILLED_SQL},
{stratified_split_ctes('nf', val=0.1, val_of_rest=True)}
SELECT split, y, COUNT(*) AS n, SUM(id)::BIGINT AS id_sum FROM splitted GROUP BY split, y""")
def stratified_split_72_8_20(spark, sf):
    """The multimodal variant: 20 % test, then 10 % of the rest as validation (72/8/20)."""
    r = clean.impute(numeric_risk(spark, sf), {"balance": "median"})
    s = splits.stratified_split(r, "y", "id", test=0.2, val=0.1, seed=42, val_of_rest=True)
    return s.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


def _smote_sql(k: int = 5, seed: int = 42) -> str:
    feats = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SMOTE_FEATURES)
    new = ",\n       ".join(f"ROUND(b.{c} + g.gap * (n.{c} - b.{c}), 6) AS {c}" for c in SMOTE_FEATURES)
    return f"""WITH {PREPARED_SQL},
{stratified_split_ctes('prepared')},
tr AS (SELECT * FROM splitted WHERE split = 'train'),
m AS (SELECT id, {feats} FROM tr WHERE y = 1),
d AS (SELECT a.id, b.id AS nn_id, {_d2} AS dist2 FROM m a JOIN m b ON a.id <> b.id),
nn AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY dist2, nn_id) AS nn_rank FROM d) WHERE nn_rank <= {k}),
c AS (SELECT (SELECT COUNT(*) FROM tr WHERE y = 0) - (SELECT COUNT(*) FROM m) AS need, (SELECT COUNT(*) FROM m) AS n_min),
rk AS (SELECT id, ROW_NUMBER() OVER (ORDER BY md5('{seed}|' || CAST(id AS VARCHAR))) AS rk FROM m),
per AS (SELECT rk.id, CAST(FLOOR(c.need / c.n_min) AS BIGINT) + CASE WHEN rk.rk <= c.need % c.n_min THEN 1 ELSE 0 END AS cnt
        FROM rk, c),
ex AS (SELECT id, unnest(range(1, cnt + 1)) AS j FROM per WHERE cnt > 0),
gen AS (SELECT id, j, md5('{seed}|' || CAST(id AS VARCHAR) || '|' || CAST(j AS VARCHAR)) AS h FROM ex),
g AS (SELECT id, j, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % {k} + 1 AS INTEGER) AS nn_rank,
             CAST('0x' || substr(h, 9, 13) AS BIGINT) / CAST({float(16 ** 13)!r} AS DOUBLE) AS gap FROM gen)
SELECT g.id AS base_id, nn.nn_id, ROUND(g.gap, 6) AS gap,
       {new}
FROM g JOIN nn ON g.id = nn.id AND g.nn_rank = nn.nn_rank JOIN m b ON b.id = g.id JOIN m n ON n.id = nn.nn_id"""


@register("smote_synthetic", "E9 J6", views=("risk_raw",), oracle=_smote_sql())
def smote_synthetic(spark, sf):
    """Every synthetic minority row: its base point, chosen neighbour, gap and interpolated features."""
    from tally.operators import resample
    out = resample.smote(smote_train(spark, sf), "y", "id", SMOTE_FEATURES, k=5, seed=42)
    return r6(out.where("synthetic").select("base_id", "nn_id", "gap", *SMOTE_FEATURES))


@register("write_read_splits", "S7", views=("risk_raw",), oracle=f"""
WITH {SPLIT_SQL}
SELECT y, COUNT(*) AS n, ROUND(AVG(amount), 6) AS mean_amount FROM sp WHERE split = 'test' GROUP BY y""")
def write_read_splits(spark, sf):
    """Persist the split partitioned by split (shared folder), read back only the test partition."""
    import uuid
    from tally.sources import sinks
    path = f"{checkpoint_dir(spark).rstrip('/')}/splits/{uuid.uuid4().hex}"
    sinks.write_splits(split_risk(spark, sf).select("id", "y", "amount", "split"), path)
    test = sinks.read_split(spark, path, "test")  # partition pruning: only split=test files are read
    return r6(test.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean_amount")))


@register("ordered_target_statistics", "L2", views=("risk_raw",), oracle="""
SELECT id, y, ROUND((COALESCE(SUM(y) OVER s, 0) + CAST(0.5 AS DOUBLE)) / (COUNT(*) OVER s + 1), 6) AS segment,
       ROUND((COALESCE(SUM(y) OVER p, 0) + CAST(0.5 AS DOUBLE)) / (COUNT(*) OVER p + 1), 6) AS priority
FROM risk_raw
WINDOW s AS (PARTITION BY segment ORDER BY md5('42|' || CAST(id AS VARCHAR)), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       p AS (PARTITION BY priority ORDER BY md5('42|' || CAST(id AS VARCHAR)), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def ordered_target_statistics(spark, sf):
    """Categories as positive shares of the earlier rows of their level, in a seeded order."""
    r = encode.ordered_target_statistics(R(spark, sf).select("id", "y", "segment", "priority"), ["segment", "priority"])
    return r.select("id", "y", F.round("segment", 6).alias("segment"), F.round("priority", 6).alias("priority"))
