"""Every query against its SQL on the smallest tables, and the driver contract."""

import pytest
from check_oracles import connect, differences

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    mine = entry.queries()[name](spark, FOLDER).toPandas()
    assert differences(mine, duck.execute(entry.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"h6_boosted_trees", "h7_network"}))
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0
