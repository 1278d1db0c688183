"""Column-expression helpers. All are built-in Spark expressions (codegen, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str
MAX_KEYS = 1000  # of a table that ``keyed_values`` looks up


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: ColumnOrName, den: ColumnOrName, default: float = 0.0) -> Column:
    """num / den, or ``default`` when the denominator is zero or NULL (zero_division=0)."""
    return F.coalesce(col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0)), F.lit(default))


def sigmoid(z: ColumnOrName) -> Column:
    """Logistic function 1 / (1 + e^-z)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def softplus(z: ColumnOrName) -> Column:
    """log(1 + e^z) without overflow: max(z, 0) + log1p(e^-|z|)."""
    z = col(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def seeded_key(seed: int | str, id_col: ColumnOrName) -> Column:
    """Engine-independent pseudo-random order key: md5('<seed>|<id>').

    Gives the same order in Spark and DuckDB and does not depend on partitioning.
    """
    return F.md5(F.concat(F.lit(f"{seed}|"), col(id_col).cast("string")))


def hash_bucket(key: ColumnOrName, bits: int = 16) -> Column:
    """Leading ``bits`` of a hex md5 key as an int bucket (monotone in the key)."""
    n_hex = max(1, (bits + 3) // 4)
    v = F.conv(F.substring(col(key), 1, n_hex), 16, 10).cast("long")
    return F.shiftright(v, 4 * n_hex - bits).cast("int") if 4 * n_hex != bits else v.cast("int")


def nan_to_zero(x: Column) -> Column:
    """NaN / +-Inf -> 0 for one numeric value (np.nan_to_num with 0 fill)."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def keyed_values(table: DataFrame, keys: list[str], values: list[str]) -> dict[str, Column]:
    """Columns that look up ``values`` of a small table by ``keys``, as one map-valued scalar subquery.

    For tables with a row per class, model, fold or split: rows are not shuffled on
    such a key, which a few values would carry. NULL keys match NULL keys. A table of more
    than ``MAX_KEYS`` rows raises (a lookup reads the keys one by one): join it instead.
    """
    entry = F.struct(F.struct(*keys).alias("k"), F.struct(*values).alias("v"))
    listed = F.collect_list(entry)
    checked = F.when(F.size(listed) <= MAX_KEYS, listed).otherwise(F.raise_error(F.lit(f"keyed_values: more than {MAX_KEYS} keys")))
    found = table.limit(MAX_KEYS + 1).select(F.map_from_entries(checked)).scalar()
    return {v: found[F.struct(*keys)].getField(v) for v in values}
