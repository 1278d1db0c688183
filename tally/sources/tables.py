"""Readers for the input tables.

Parquet is the primary format: Catalyst pushes filters and column pruning into
the scan. CSV input follows the reference's pandas defaults: a header row, and
the usual NA spellings become NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The NA spellings pandas.read_csv treats as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


class Tables:
    """Lazy, cached parquet readers for one scale-factor folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._cache[name]


def na_to_null(c: Column, tokens=NA_TOKENS) -> Column:
    """String column with NA spellings replaced by NULL."""
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str | None = None) -> DataFrame:
    """Read a table; CSV cells equal to an NA token become NULL.

    With a schema, CSV columns are read as strings, NA tokens nulled, then cast
    with ``try_cast`` (a bad number becomes NULL instead of failing the job).
    Without one every CSV column stays a string (no inference pass over the data).
    """
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
        return df.select(*schema.fieldNames()) if schema else df
    names = schema.fieldNames() if schema else None
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    cols = []
    for name in raw.columns:
        c = na_to_null(F.col(f"`{name}`"))
        if schema is not None and name in names:
            dt = schema[name].dataType
            if not isinstance(dt, T.StringType):
                c = c.try_cast(dt)
        cols.append(c.alias(name))
    df = raw.select(*cols)
    return df.select(*names) if names else df
