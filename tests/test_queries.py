"""Every registered query against its SQL on the smallest tables; those without SQL run and give rows."""

import pytest
from comparison import SF, database, differences

import __spark_entry__ as entry
from tidewire import queries as core

SQL = core.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    return database()


def test_entry(spark):
    assert entry.entry(spark).columns


def test_registered():
    assert set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, SF)
    if name in SQL:
        assert not differences(df, SQL[name], con)
    else:
        assert df.count() > 0
