"""Names, callables and DuckDB SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Modules that register queries when they are imported.
FAMILIES = ("telemetry", "text", "dedupe", "retrieval", "talk", "access", "catalog", "governance", "graph", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a callable (spark, sf_dir) -> DataFrame under ``name``, with the SQL that gives the same rows."""

    def keep(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return keep


def _load() -> None:
    for family in FAMILIES:
        import_module(f"loam.plans.{family}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
