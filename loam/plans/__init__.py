"""Queries on the driver's tables: each binds operators of this library to tables and has DuckDB SQL beside it."""

from loam.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
