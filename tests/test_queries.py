"""Every registered query runs, and those with oracle SQL give its rows."""

import pytest
from oracle import compare, connect

from riskloom.catalog.registry import entries

ENTRIES = entries()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql is not None])
def test_matches_sql(spark, small, con, name):
    fn, sql = ENTRIES[name]
    assert compare(spark, con, fn, sql, small) == []


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql is None])
def test_gives_rows(spark, small, name):
    assert ENTRIES[name][0](spark, small).count() > 0


def test_entry_contract(spark, small):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
