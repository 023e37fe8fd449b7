"""Registry of named queries and their DuckDB oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame``.  Its oracle is an
ANSI-SQL text over the driver's tables (plus derived catalog CTEs) that DuckDB
can run; queries without an SQL equivalent register no oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from fleetcat.plans import (  # noqa: F401
        catalog_queries, large_file_queries, layout_queries, measure_queries, scalar_queries, scope_queries, source_queries,
    )
