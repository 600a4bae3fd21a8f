"""Every query that has checking SQL gives the same rows, values and types as DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from conftest import SMALL

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_result(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, CHECKS[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_unchecked_query_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
