"""Every registered query with SQL matches its DuckDB oracle on sf0.001."""
import pytest

from tools_path import canon, duck  # noqa: F401

from apptflow.plans.registry import oracle_sql, queries

SQL = oracle_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, sf_small, name):
    s = queries()[name](spark, sf_small).toPandas()
    o = con.execute(SQL[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert canon(s) == canon(o)
