"""Training-data operators: thirteen methods over documents, each with a registered query.

Nothing outside this package imports it. ``queries()`` and ``oracle_sql()`` are what the entry module adds.
"""

from loam.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
