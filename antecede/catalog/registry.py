"""Query registry and the helpers every registered query shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(col: Column | str) -> Column:
    """Round for comparison; the offset keeps exact halves away from the rounding edge."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double") + 1e-9, 6)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def s6(expr: str) -> str:
    """SQL twin of :func:`r6`."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6)"
