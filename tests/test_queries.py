import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import DATA
from oracle import compare, connect

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, SF).count() > 0
        return
    ours, theirs, difference = compare(spark, con, SF, queries()[name], sql)
    assert difference is None and ours == theirs > 0


def test_entry(spark):
    assert entry(spark).count() > 0
