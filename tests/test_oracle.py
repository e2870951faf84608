"""Every query of the core that has SQL, against it, on the smallest tables."""

import pytest

from quadloom.plans import core_queries, more_queries, survey_queries
from tests.oracle import connect, spark_bag, sql_bag

SF = "/root/testdata/sf0.001"
QUERIES = core_queries.queries() | survey_queries.queries() | more_queries.queries()
SQL = core_queries.oracle_sql() | survey_queries.oracle_sql() | more_queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    names, want = sql_bag(con, SQL[name])
    assert sorted(df.columns) == sorted(names)
    assert spark_bag(df) == want


def test_every_query_of_the_core_has_sql():
    assert set(QUERIES) == set(SQL)
