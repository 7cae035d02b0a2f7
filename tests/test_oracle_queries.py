"""Every registered query with a SQL twin matches DuckDB (sf0.001); what the
others must fulfil is in tests/test_models.py. The driver repeats the SQL
check at sf0.01."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    info = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert info["ok"], info


def test_every_query_is_checked():
    from tests.test_models import PROPERTIES
    from wattlane.plans.catalog import queries
    assert set(queries()) - set(SQL) == set(PROPERTIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "outliers" in df.columns
