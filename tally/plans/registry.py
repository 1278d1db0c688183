"""Registry of catalogue queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tally.plans.views_sql import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
SURVEY_ID: dict[str, str] = {}


def register(name: str, ids: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``ids`` are the SURVEY §2 operator ids it covers."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        SURVEY_ID[name] = ids
        if oracle is not None:
            ORACLE[name] = with_views(oracle, *views)
        return fn

    return deco


def dsql(x: float) -> str:
    """A float literal both engines read as DOUBLE (bare 1.0 is DECIMAL in both)."""
    return f"CAST({float(x)!r} AS DOUBLE)"
