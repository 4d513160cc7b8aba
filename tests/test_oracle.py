"""Every registered query against its SQL on the same tables."""

import pytest

from shotgrove.plans.catalog import QUERIES, SQL
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def db(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, folder, name):
    problems, _ = differences(spark, db, QUERIES[name], SQL[name], folder)
    assert not problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
