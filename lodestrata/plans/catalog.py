"""All queries outside the optional subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality_queries, reference_queries

_MODULES = [quality_queries, reference_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> SQL over the same tables."""
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
