"""Reproducible splits and folds.

Membership order is md5('<seed>|<id>') — identical in any engine and
independent of partitioning (never ``rand()`` / ``randomSplit``). Per-class
quotas follow the library allocation: ceil for the held-out size, then the
largest-remainder rule for classes (ties to the smaller class value). Ranks
inside a class come from ``ranking.ranked`` so no class is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions.exprs import keyed_values, seeded_key
from tally.operators.ranking import ranked


def _approx_mode(counts: DataFrame, grp: list[str], cls: str, cnt: str, draws: Column, out: str) -> DataFrame:
    """Largest-remainder allocation of ``draws`` over classes in proportion to ``cnt``."""
    wg = Window.partitionBy(*grp) if grp else Window.partitionBy(F.lit(0))
    total = F.sum(cnt).over(wg)
    cont = F.col(cnt).cast("double") / total.cast("double") * draws.cast("double")
    x = counts.withColumn("_cont", cont).withColumn("_floor", F.floor("_cont").cast("long"))
    x = x.withColumn("_need", draws.cast("long") - F.sum("_floor").over(wg)) \
         .withColumn("_rem", F.col("_cont") - F.col("_floor"))
    x = x.withColumn("_rk", F.row_number().over(wg.orderBy(F.desc("_rem"), F.asc(cls))))
    return x.withColumn(out, F.col("_floor") + F.when(F.col("_rk") <= F.col("_need"), 1).otherwise(0)) \
        .drop("_cont", "_floor", "_need", "_rem", "_rk")


def _class_counts(df: DataFrame, grp: list[str], label: str) -> DataFrame:
    return df.groupBy(*grp, label).agg(F.count(F.lit(1)).alias("_c"))


def _held_out_quota(counts: DataFrame, grp: list[str], label: str, cnt: str, frac: float, out: str,
                    stratify: bool = True) -> DataFrame:
    """Quota per class for the held-out part of one split of size ceil(frac * n)."""
    wg = Window.partitionBy(*grp) if grp else Window.partitionBy(F.lit(0))
    n = F.sum(cnt).over(wg)
    n_keep = n - F.ceil(F.lit(float(frac)) * n.cast("double"))
    kept = _approx_mode(counts, grp, label, cnt, n_keep, "_keep")
    return kept.withColumn(out, F.col(cnt) - F.col("_keep")).drop("_keep")


def _by_quota(ranked_rows: DataFrame, quotas: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The first ``_q_test`` ranks of a class are test, the next ``_q_val`` val, the rest train."""
    q = keyed_values(quotas, keys, ["_q_test", "_q_val"])
    split = (F.when(F.col("_rank") <= q["_q_test"], "test")
             .when(F.col("_rank") <= q["_q_test"] + q["_q_val"], "val").otherwise("train"))
    return ranked_rows.withColumn(out, split).drop("_key", "_rank")


def stratified_split(df: DataFrame, label: str = "y", id_col: str = "id", test: float = 0.2,
                     val: float = 0.1, seed: int = 42, val_of_rest: bool = False,
                     out: str = "split", group_cols: list[str] | None = None) -> DataFrame:
    """Stratified train/val/test.

    test = ceil(test * n); val = ceil(v * rest) with v = val / (1 - test) (70/10/20),
    or v = val itself when ``val_of_rest`` (72/8/20 variant).
    """
    grp = list(group_cols or [])
    v = val if val_of_rest else val / (1 - test)
    c = _class_counts(df, grp, label)
    c = _held_out_quota(c, grp, label, "_c", test, "_q_test")
    c = c.withColumn("_rest", F.col("_c") - F.col("_q_test"))
    c = _held_out_quota(c, grp, label, "_rest", v, "_q_val").select(*grp, label, "_q_test", "_q_val")
    x = df.withColumn("_key", seeded_key(seed, id_col))
    x = ranked(x, [*grp, label], "_key", id_col, "_rank")
    return _by_quota(x, c, [*grp, label], out)


def per_class_split(df: DataFrame, class_col: str, id_col: str, test: float = 0.2, val: float = 0.1,
                    seed: int = 42, out: str = "split") -> DataFrame:
    """R2: each class split on its own (unstratified inside the class)."""
    v = val / (1 - test)
    c = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("_c"))
    c = c.withColumn("_q_test", F.ceil(F.lit(float(test)) * F.col("_c").cast("double")))
    c = c.withColumn("_q_val", F.ceil(F.lit(float(v)) * (F.col("_c") - F.col("_q_test")).cast("double")))
    x = ranked(df.withColumn("_key", seeded_key(seed, id_col)), [class_col], "_key", id_col, "_rank")
    return _by_quota(x, c, [class_col], out)


def stratified_shuffle_split(df: DataFrame, label: str, id_col: str, held_out: float = 0.3,
                             second: float = 0.5, seed: int = 42, out: str = "split") -> DataFrame:
    """70/15/15 — hold out ``held_out`` stratified, then split it in halves (val, test)."""
    c = _class_counts(df, [], label)
    c = _held_out_quota(c, [], label, "_c", held_out, "_q_temp")
    c = c.withColumn("_temp", F.col("_q_temp"))
    c = _held_out_quota(c, [], label, "_temp", second, "_q_test").select(label, "_q_temp", "_q_test")
    x = ranked(df.withColumn("_key", seeded_key(seed, id_col)), [label], "_key", id_col, "_rank")
    q = keyed_values(c, [label], ["_q_temp", "_q_test"])
    split = F.when(F.col("_rank") <= q["_q_test"], "test").when(F.col("_rank") <= q["_q_temp"], "val").otherwise("train")
    return x.withColumn(out, split).drop("_key", "_rank")


def stratified_kfold(df: DataFrame, label: str = "y", id_col: str = "id", k: int = 10, seed: int = 42,
                     out: str = "fold", group_cols: list[str] | None = None) -> DataFrame:
    """Shuffled stratified k folds (0-based fold ids).

    Rows are laid out class by class (ascending), each class in md5 order; the
    row at global position j goes to fold j % k. This reproduces the library's
    per-class fold sizes exactly. The global position is class offset + rank.
    """
    grp = list(group_cols or [])
    c = _class_counts(df, grp, label)
    wg = (Window.partitionBy(*grp) if grp else Window.partitionBy(F.lit(0))).orderBy(label)
    off = c.select(*grp, label, F.coalesce(F.sum("_c").over(wg.rowsBetween(Window.unboundedPreceding, -1)),
                                           F.lit(0)).alias("_off"))
    x = ranked(df.withColumn("_key", seeded_key(seed, id_col)), [*grp, label], "_key", id_col, "_rank")
    first = keyed_values(off, [*grp, label], ["_off"])["_off"]
    return x.withColumn(out, ((first + F.col("_rank") - 1) % k).cast("int")).drop("_key", "_rank")


def repeated_kfold(df: DataFrame, label: str = "y", id_col: str = "id", k: int = 10, repeats: int = 3,
                   seed: int = 42) -> DataFrame:
    """R4 with repeats: seed + r for repeat r (1-based repeat column). Rows are repeated per repeat."""
    x = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    x = x.withColumn("_seed", (F.lit(seed) + F.col("repeat") - 1).cast("string"))
    x = x.withColumn("_key", F.md5(F.concat(F.col("_seed"), F.lit("|"), F.col(id_col).cast("string"))))
    c = x.groupBy("repeat", label).agg(F.count(F.lit(1)).alias("_c"))
    wg = Window.partitionBy("repeat").orderBy(label)
    off = c.select("repeat", label, F.coalesce(F.sum("_c").over(wg.rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0)).alias("_off"))
    x = ranked(x, ["repeat", label], "_key", id_col, "_rank")
    first = keyed_values(off, ["repeat", label], ["_off"])["_off"]
    return x.withColumn("fold", ((first + F.col("_rank") - 1) % k).cast("int")).drop("_seed", "_key", "_rank")


def holdout_from_fold(df: DataFrame, id_col: str = "id", frac: float = 0.8, seed: int = 42,
                      group_cols: list[str] | None = None, out: str = "part") -> DataFrame:
    """Unstratified int(frac * n) rows -> 'fit', the rest -> 'holdout' (per group)."""
    grp = list(group_cols or [])
    x = df.withColumn("_key", seeded_key(seed, id_col)).withColumn("_one", F.lit(1))
    x = ranked(x, [*grp, "_one"], "_key", id_col, "_rank", size_col="_n")
    cut = F.floor(F.lit(float(frac)) * F.col("_n").cast("double"))
    return x.withColumn(out, F.when(F.col("_rank") <= cut, "fit").otherwise("holdout")) \
        .drop("_key", "_rank", "_one", "_n")
