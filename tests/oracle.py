"""Runs a registered query and its DuckDB SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def views(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(base).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def compare(spark, name: str, query, sql: str, base: str) -> str:
    """What differs, or nothing."""
    found = query(spark, base)
    columns = sorted(found.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    result = views(base).execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"{name}: columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b][:3]
        return f"{name}: {len(mine)} and {len(theirs)} rows, {columns}: {bad}"
    return "" if mine else f"{name}: no rows"
