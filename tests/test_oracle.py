"""Every query with oracle SQL agrees with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

from conftest import SF_SMALL

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    problems, _ = compare(df, con, SQL[name])
    assert not problems, problems


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["seq", "severity", "message"]


def test_every_query_has_a_name_and_callable():
    qs = E.queries()
    assert len(qs) >= 80
    assert set(SQL) <= set(qs)
