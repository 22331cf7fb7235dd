"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf_dir, name):
    verdict, _ = oracle.compare(spark, con, QUERIES[name], SQL[name], sf_dir)
    assert verdict == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert len(QUERIES[name](spark, sf_dir).take(1)) == 1


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"city", "mae", "rmse", "r2"}
