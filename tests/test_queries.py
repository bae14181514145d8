"""Every registered query against its SQL twin on the smallest tables."""

import __spark_entry__ as entry
import compare
import pytest

QUERIES = entry.queries()
SQL = entry.oracle_sql()

@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare.diff(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 3
    assert {"protocol", "flows", "packets"} <= set(df.columns)


def test_names():
    assert set(SQL) <= set(QUERIES)
