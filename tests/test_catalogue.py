"""Every query of the catalogue against its SQL, on the smallest tables; derived tables are computed once."""

import pytest

import __spark_entry__ as entry
from sentryspark.plans.catalogue import BUILDS, ORACLES, Tables
from tests.conftest import SMALL, duck_rows, rows_of


@pytest.fixture(scope="module")
def tables(spark):
    found = Tables(spark, SMALL)
    for name in ("events", "reputation", "findings", "alerts", "sessions"):
        vars(found)[name] = getattr(found, name).cache()
    yield found
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(BUILDS))
def test_equals_sql(tables, duck, name):
    found = BUILDS[name](tables)
    if name not in ORACLES:
        assert found.count() > 0
        return
    columns, expected = duck_rows(duck, ORACLES[name])
    assert sorted(found.columns) == columns
    assert rows_of(found) == expected
    assert expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
