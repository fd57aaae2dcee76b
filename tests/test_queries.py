"""Every named query gives the same rows as its SQL twin (CHECK_SF_DIR picks the scale)."""

import pytest
from harness import difference, duck

import __spark_entry__ as driver

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, con, name):
    frame = QUERIES[name](spark, folder)
    if name in SQL:
        assert difference(frame, con, SQL[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    frame = driver.entry(spark)
    assert frame.columns[0] == "PHONE_NUMBER" and frame.count() > 0
