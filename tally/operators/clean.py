"""Projection, filtering and cleaning operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.exprs import col, nan_to_zero
from tally.operators.ordered import exact_quantiles


def drop_columns(df: DataFrame, cols: list[str], strict: bool = False) -> DataFrame:
    """Drop columns; missing names are ignored unless ``strict``."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def to_numeric(df: DataFrame, column: str, tokens: tuple[str, ...] = ("N/A",), dtype: str = "double",
               strict: bool = False, out: str | None = None) -> DataFrame:
    """NA token -> NULL, then numeric cast.

    Non-numeric junk becomes NULL (``try_cast``); with ``strict`` the job fails on
    it instead, as ``pd.to_numeric`` raises.
    """
    raw = F.when(F.col(column).isin(list(tokens)), F.lit(None)).otherwise(F.col(column))
    num = raw.try_cast(dtype)
    if strict:
        num = F.when(F.assert_true(raw.isNull() | num.isNotNull(),
                                   F.concat(F.lit(f"non-numeric value in {column}: "), raw)).isNull(), num)
    return df.withColumn(out or column, num)


def exclude_value(df: DataFrame, column: str, value) -> DataFrame:
    """Drop rows whose ``column`` equals ``value``; NULL rows are kept."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def _mode_value(fit: DataFrame, column: str) -> Column:
    """Most frequent non-NULL value, smallest on ties — a distributed top-1, as a scalar subquery."""
    counts = fit.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), F.asc(column)).limit(1).select(column).scalar()


def fill_values(fit: DataFrame, spec: dict) -> dict[str, Column]:
    """P4 fit: one fill expression per column, evaluated inside the plan (scalar subqueries).

    spec values: 'mean' | 'median' | 'mode' | ('constant', v).
    """
    out: dict[str, Column] = {}
    for c, how in spec.items():
        if how == "mean":
            out[c] = fit.select(F.avg(c)).scalar()
        elif how == "median":
            out[c] = exact_quantiles(fit, [], c, [0.5]).select("q").scalar()
        elif how == "mode":
            out[c] = _mode_value(fit, c)
        else:
            out[c] = F.lit(how[1] if isinstance(how, tuple) else 0)
    return out


def impute(df: DataFrame, spec: dict, fit: DataFrame | None = None) -> DataFrame:
    """Fill NULLs with statistics fitted on ``fit`` (default: ``df`` itself, all rows)."""
    fills = fill_values(fit if fit is not None else df, spec)
    return df.withColumns({c: F.coalesce(F.col(c), v.cast(df.schema[c].dataType)) for c, v in fills.items()})


def typed_features(df: DataFrame, cat_cols: list[str], cont_cols: list[str], label: str) -> DataFrame:
    """P5: x_categ array<bigint>, x_cont array<float>, label float (the typed matrices)."""
    return df.select(
        *[c for c in df.columns if c not in (*cat_cols, *cont_cols, label)],
        F.array(*[F.col(c).cast("long") for c in cat_cols]).alias("x_categ"),
        F.array(*[F.col(c).cast("float") for c in cont_cols]).alias("x_cont"),
        F.col(label).cast("float").alias("label"),
    )


def clean_vector(v: Column | str) -> Column:
    """NaN/+-Inf -> 0 inside an array column."""
    return F.transform(col(v), lambda x: nan_to_zero(x.cast("double")))


def binarize(score: Column | str, threshold, op: str = ">") -> Column:
    """1 if score > t (strict) or score >= t (inclusive), else 0."""
    s = col(score)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (s > t if op == ">" else s >= t).cast("int")


def parse_checkpoint_name(df: DataFrame, name_col: str = "name") -> DataFrame:
    """Epoch number and best flag from checkpoint file names; sort key (version, epoch or 999).

    A missing epoch and an epoch of 0 both sort as 999.
    """
    name = F.col(name_col)
    is_best = F.lower(name).contains("best")
    ep = F.regexp_extract(name, r"epoch[_]?(\d+)", 1)
    epoch = F.when(is_best | ~name.contains("epoch") | (ep == ""), F.lit(None)).otherwise(ep.cast("int"))
    return df.withColumns({
        "epoch": epoch,
        "is_best": is_best,
        "sort_epoch": F.coalesce(F.nullif(epoch, F.lit(0)), F.lit(999)),
    })


def format_share(n: Column | str, d: Column | str) -> Column:
    """P10: '21/30'."""
    return F.format_string("%d/%d", col(n).cast("int"), col(d).cast("int"))


def format_pct(x: Column | str) -> Column:
    """P10: '70.0%' (x is a percentage); half-to-even like Python's format."""
    return F.format_string("%.1f%%", F.bround(col(x).cast("double"), 1))
