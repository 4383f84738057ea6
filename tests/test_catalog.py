"""Every registered query against the check engine, and the contract of the registry."""

import pytest

import compare
from nearby_engine.plans import load_catalog
from nearby_engine.plans.catalog import CATALOG

load_catalog()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, engine, name):
    entry = CATALOG[name]
    result = entry.plan(spark, FOLDER)
    if entry.sql is None:
        assert result.count() > 0
    else:
        assert compare.differences(result, engine, entry.sql) == []


def test_entry_contract(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() >= 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
