"""Queries of the subpackage that have SQL, against it; the others run."""

import pytest

from quadloom.llm import queries
from tests.oracle import connect, spark_bag, sql_bag

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    names, want = sql_bag(connect(SF), sql)
    assert sorted(df.columns) == sorted(names) and spark_bag(df) == want
