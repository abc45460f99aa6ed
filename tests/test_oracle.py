"""Every query with SQL gives what the SQL gives."""

import pytest

import oracle
from paddock.plans import catalogue, training, training_sql

QUERIES = {**catalogue.queries(), **training.queries()}
SQL = {**catalogue.SQL, **training_sql.SQL}


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    assert oracle.differences(QUERIES[name](spark, small), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0
