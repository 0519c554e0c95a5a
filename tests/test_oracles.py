from __future__ import annotations

import pytest

import __spark_entry__ as entry
from loam import plans
from tests.oracle import compare

DATA = "/root/testdata/sf0.001"
SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    assert compare(spark, name, plans.queries()[name], SQL[name], DATA) == ""


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_queries_without_sql_run(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
