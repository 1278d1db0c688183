"""Encoding and feature-building operators.

Fitted state is data, not driver objects: label codes are a (column, value,
code) table, scaling parameters a one-row aggregate consumed as scalar
subqueries. Level lists reach the driver only for wide one-hot output, where
they decide the schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions.exprs import keyed_values, seeded_key
from tally.operators.ordered import dense_index, running_counts


# ---------------------------------------------------------------- E1 / E2
# Wide one-hot output has a column per level: a plan can't hold more than this many.
MAX_COLUMNS = 10_000


# A lookup reads its levels one by one: so many stand in a map at most, and so many rows' share makes a level frequent.
MAX_LOOKUP = 200
_SPREAD = 1 << 16  # join keys over which the rows of frequent levels are spread


def label_codes(fit: DataFrame, column: str) -> DataFrame:
    """E1 fit: sorted distinct non-NULL values -> code 0..k-1 (value, code), built distributed."""
    return dense_index(fit.select(column), [], column, "code")


def _lookup(codes: DataFrame, column: str) -> Column:
    entry = F.struct(F.col(column).alias("k"), F.col("code").alias("v"))
    found = codes.select(F.map_from_entries(F.collect_list(entry))).scalar()
    return found[F.col(column)]


def with_code(df: DataFrame, column: str, fit: DataFrame, out: str) -> DataFrame:
    """``df`` with the code of ``column`` among the levels of ``fit`` (NULL: none).

    Up to ``MAX_LOOKUP`` levels are looked up in one map-valued scalar subquery. Of more levels the
    rest is joined; those that hold at least a ``MAX_LOOKUP``-th of the fitted rows (so no more than
    ``MAX_LOOKUP`` levels) are looked up, and their rows get join keys of their own, so that no
    join key is frequent.
    """
    codes = label_codes(fit, column)
    if codes.limit(MAX_LOOKUP + 1).count() <= MAX_LOOKUP:
        return df.withColumn(out, _lookup(codes, column))
    counts = fit.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = fit.select(F.count(column)).scalar()
    often = counts.where(F.col("_n") * MAX_LOOKUP >= total).select(column)
    known = _lookup(codes.join(often, column, "left_semi"), column)
    rest = codes.join(often, column, "left_anti").select(F.col(column).alias("_join_level"), F.col("code").alias("_join_code"), F.lit(-1).cast("long").alias("_join_spread"))
    x = df.withColumn("_join_known", known)
    spread = F.when(F.col("_join_known").isNull() & F.col(column).isNotNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(*df.columns), F.lit(_SPREAD)))
    x = x.withColumn("_join_own", spread)
    x = x.join(rest, (F.when(F.col("_join_own") < 0, F.col(column)) == F.col("_join_level")) & (F.col("_join_own") == F.col("_join_spread")), "left")
    return x.withColumn(out, F.coalesce("_join_known", "_join_code")).drop("_join_known", "_join_own", "_join_level", "_join_code", "_join_spread")


def label_encode(df: DataFrame, columns: list[str], fit: DataFrame | None = None,
                 suffix: str = "", strict: bool = True) -> DataFrame:
    """Replace each categorical by its code (position in sorted order, fitted on ``fit``).

    Any number of levels; see ``with_code``. A value absent from the
    fitted levels fails the query as in the reference; with ``strict=False`` it
    gets a NULL code. NULL stays NULL.
    """
    out = df
    for c in columns:
        out = with_code(out, c, fit if fit is not None else df, f"_code_{c}")
        code = F.col(f"_code_{c}")
        if strict and fit is not None:
            unseen = F.raise_error(F.concat(F.lit(f"{c}: value not among the fitted levels: "), F.col(c).cast("string")))
            code = F.when(F.col(c).isNotNull() & code.isNull(), unseen.cast("int")).otherwise(code)
        out = out.withColumn(c + suffix, code).drop(f"_code_{c}")
    return out if suffix else out.select(*df.columns)


# ---------------------------------------------------------------- ordered target statistics (L2)
def ordered_target_statistics(df: DataFrame, columns: list[str], label: str = "y", id_col: str = "id", prior: float = 0.5,
                              seed: int = 42) -> DataFrame:
    """Each category replaced by (positives + prior) / (rows + 1) of the earlier rows of its level.

    Rows stand in a seeded order of their ids, so that no row's own label is in its
    statistic. NULL is a level. Running sums are taken over ranges (``running_counts``), so
    that a level that most rows have is no single task. Ids must be unique.
    """
    out = df.withColumns({"_order": F.concat(seeded_key(seed, id_col), F.lit("|"), F.col(id_col).cast("string")), "_one": F.lit(1), "_hit": F.col(label).cast("int")})
    for c in columns:
        x = out.withColumn("_level", F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")))
        x = running_counts(x, ["_level"], "_order", ["_one", "_hit"])
        before = (F.col("cum__hit") - F.col("_hit") + F.lit(prior)) / F.col("cum__one")  # rows before it and one
        out = x.withColumn(c, before.cast("double")).select(*out.columns)
    return out.select(*df.columns)


def target_statistics(df: DataFrame, columns: list[str], fit: DataFrame, label: str = "y", prior: float = 0.5) -> DataFrame:
    """Each category replaced by (positives + prior) / (rows + 1) of all rows of its level in ``fit``; ``prior`` for new levels.

    For rows that were not fitted on.
    """
    out = df
    for c in columns:
        sums = fit.groupBy(c).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("int")).alias("_p"))
        found = keyed_values(sums.select(F.col(c), ((F.col("_p") + F.lit(prior)) / (F.col("_n") + 1)).alias("_stat")), [c], ["_stat"])
        out = out.withColumn(c, F.coalesce(found["_stat"], F.lit(prior)))
    return out


def code_table(fit: DataFrame, columns: list[str]) -> DataFrame:
    """E1 state as one long table (column, value, code), built distributed."""
    parts = [label_codes(fit, c).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "code")
             for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct count per column without NULL (nunique) and with NULL as a value (unique())."""
    aggs = []
    for c in columns:
        aggs += [F.count_distinct(c).alias(f"{c}__n"),
                 (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"{c}__nn")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n_unique"),
                 F.col(f"{c}__nn").cast("long").alias("n_unique_with_null"))
        for c in columns])).alias("s")).select("s.*")


# ---------------------------------------------------------------- E3 / E4 / E5
def levels(fit: DataFrame, column: str) -> list:
    """Sorted distinct non-NULL levels (brought to the driver: they name the output columns).

    Raises if there are more levels than columns a plan can hold; ``one_hot_vector``
    has no such limit.
    """
    got = fit.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_COLUMNS + 1).collect()
    if len(got) > MAX_COLUMNS:
        raise ValueError(f"{column}: more than {MAX_COLUMNS} levels; use one_hot_vector")
    return sorted(r[0] for r in got)


def one_hot_vector(df: DataFrame, column: str, fit: DataFrame | None = None, drop_first: bool = False,
                   out: str | None = None) -> DataFrame:
    """E3/E5 without a limit on levels: struct (size, position) of the one entry that is 1.

    ``size`` counts the fitted levels (less one with ``drop_first``). NULL, unseen
    values and the dropped first level have a NULL position: all zeros.
    """
    fit = fit if fit is not None else df
    size = label_codes(fit, column).select(F.coalesce(F.max("code") + 1, F.lit(0))).scalar() - int(drop_first)
    index = F.col("_code") - int(drop_first)
    hot = F.struct(F.greatest(size, F.lit(0)).cast("int").alias("size"), F.when(index >= 0, index).cast("int").alias("position"))
    return with_code(df, column, fit, "_code").withColumn(out or f"{column}_hot", hot).drop("_code")


def one_hot(df: DataFrame, column: str, lvls: list | None = None, drop_first: bool = False,
            prefix: str | None = None, keep: bool = False) -> DataFrame:
    """0/1 column per level; no NULL level.

    ``lvls`` fitted elsewhere (e.g. on train) aligns other splits: unseen values
    give all zeros, levels missing from the data give constant-0 columns.
    ``drop_first`` removes the first level (baseline), as OneHotEncoder(drop='first').
    """
    lvls = lvls if lvls is not None else levels(df, column)
    use = lvls[1:] if drop_first else lvls
    p = prefix if prefix is not None else column
    new = {f"{p}_{v}": F.when(F.col(column) == F.lit(v), 1).otherwise(0) for v in use}
    out = df.withColumns(new) if new else df
    return out if keep else out.drop(column)


def align_columns(frame: DataFrame, reference_cols: list[str]) -> DataFrame:
    """E4 for raw frames: force ``frame`` to ``reference_cols``; missing -> 0, extra dropped."""
    return frame.select(*[F.col(c) if c in frame.columns else F.lit(0).alias(c) for c in reference_cols])


# ---------------------------------------------------------------- E6 / E7
def scaling_params(fit: DataFrame, columns: list[str]) -> Column:
    """E6 fit: struct of mean and population std per column, as one scalar subquery."""
    fields = []
    for c in columns:
        fields += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    names = [x for c in columns for x in (f"{c}__mean", f"{c}__std")]
    return fit.agg(*fields).select(F.struct(*names)).scalar()


def standard_scale(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std with population std; zero std divides by 1."""
    p = scaling_params(fit if fit is not None else df, columns)
    new = {}
    for c in columns:
        mu = p.getField(f"{c}__mean")
        sd = p.getField(f"{c}__std")
        new[c] = (F.col(c) - mu) / F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd)
    return df.withColumns(new)


def mean_std(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with mean and sample std."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_samp(c).alias(f"{c}__s")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__m").alias("mean"), F.col(f"{c}__s").alias("std"))
        for c in columns])).alias("s")).select("s.*")


# ---------------------------------------------------------------- E8
@dataclass
class Prep:
    """Scale numerics, one-hot (drop first) categoricals, pass the rest through.

    ``fit`` keeps the levels and the scaling subquery; ``transform`` is one select.
    """
    numeric: list[str]
    categorical: list[str]
    drop_first: bool = True
    _levels: dict = field(default_factory=dict)
    _params: Column | None = None

    def fit(self, df: DataFrame) -> "Prep":
        self._levels = {c: levels(df, c) for c in self.categorical}
        self._params = scaling_params(df, self.numeric) if self.numeric else None
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        if self._params is not None:
            new = {}
            for c in self.numeric:
                mu = self._params.getField(f"{c}__mean")
                sd = self._params.getField(f"{c}__std")
                new[c] = (F.col(c) - mu) / F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd)
            out = out.withColumns(new)
        for c in self.categorical:
            out = one_hot(out, c, self._levels[c], drop_first=self.drop_first)
        return out

    def save(self, fit: DataFrame, path: str) -> None:
        """The state fitted on ``fit`` as Parquet tables: settings, means and deviations, levels with positions."""
        spark = fit.sparkSession
        spark.createDataFrame([(self.numeric, self.categorical, self.drop_first)], "numeric array<string>, categorical array<string>, drop_first boolean") \
            .write.mode("overwrite").parquet(f"{path}/settings")
        p = scaling_params(fit, self.numeric) if self.numeric else None
        rows = spark.range(1).select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), p.getField(f"{c}__mean").alias("mean"), p.getField(f"{c}__std").alias("std"))
            for c in self.numeric])).alias("s")).select("s.*") if self.numeric else spark.createDataFrame([], "column string, mean double, std double")
        rows.write.mode("overwrite").parquet(f"{path}/scaling")
        parts = [label_codes(fit, c).select(F.lit(c).alias("column"), F.col("code").alias("position"), F.to_json(F.struct(F.col(c).alias("v"))).alias("value"),
                                            F.lit(fit.schema[c].dataType.simpleString()).alias("type")) for c in self.categorical]
        levels_ = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "column string, position int, value string, type string")
        levels_.write.mode("overwrite").parquet(f"{path}/levels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Prep":
        """A saved state. Means and deviations stay a scalar subquery; levels name the output columns."""
        s = spark.read.parquet(f"{path}/settings").first()
        prep = cls(list(s.numeric), list(s.categorical), s.drop_first)
        if prep.numeric:
            table = spark.read.parquet(f"{path}/scaling")
            field = lambda c, v: F.max(F.when(F.col("column") == c, F.col(v))).alias(f"{c}__{v}")
            prep._params = table.agg(*[field(c, v) for c in prep.numeric for v in ("mean", "std")]) \
                .select(F.struct(*[f"{c}__{v}" for c in prep.numeric for v in ("mean", "std")])).scalar()
        table = spark.read.parquet(f"{path}/levels")
        for c in prep.categorical:
            one = table.where(F.col("column") == c).orderBy("position").limit(MAX_COLUMNS + 1)
            kind = one.select("type").first()
            got = one.select(F.from_json("value", f"v {kind.type}")["v"].alias("v")).collect() if kind else []
            if len(got) > MAX_COLUMNS:
                raise ValueError(f"{c}: more than {MAX_COLUMNS} levels")
            prep._levels[c] = [r.v for r in got]
        return prep

    def output_columns(self, df: DataFrame) -> list[str]:
        return self.transform(df).columns


# ---------------------------------------------------------------- E10
def class_weights(df: DataFrame, label: str = "y", group_cols: list[str] | None = None) -> DataFrame:
    """Per group — counts, neg/pos (scale_pos_weight), sqrt(neg/pos) and balanced weights.

    balanced weight of class c = n / (k * n_c) with k = 2. pos = 0 gives NULL ratios.
    """
    g = group_cols or []
    c = df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("long")).alias("n_pos"),
    ).withColumn("n_neg", F.col("n") - F.col("n_pos"))
    ratio = F.col("n_neg").cast("double") / F.nullif(F.col("n_pos"), F.lit(0)).cast("double")
    return c.select(
        *g, "n", "n_pos", "n_neg",
        ratio.alias("scale_pos_weight"),
        F.sqrt(ratio).alias("sqrt_pos_weight"),
        (F.col("n") / (2.0 * F.nullif(F.col("n_neg"), F.lit(0)))).alias("weight_neg"),
        (F.col("n") / (2.0 * F.nullif(F.col("n_pos"), F.lit(0)))).alias("weight_pos"),
    )


def with_weight(df: DataFrame, label: str = "y", out: str = "weight") -> DataFrame:
    """E10 as a weight column (balanced): n / (2 n_c), fitted on ``df`` itself."""
    w = class_weights(df, label).select(F.struct("weight_neg", "weight_pos")).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, w.getField("weight_pos")).otherwise(w.getField("weight_neg")))
