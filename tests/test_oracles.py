"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from checks.compare import connect, difference


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, SMOKE_DIR).count() > 0
    else:
        found = difference(spark, con, SMOKE_DIR, queries()[name], sql)
        assert found is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) > 1000 and {"map_id", "x", "y", "pix", "value", "t", "cls", "idx"} <= set(rows[0].asDict())
