"""Every query that SQL can express, against its SQL on the smallest tables."""

import pytest

from sentryspark.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL, duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    columns, expected = duck_rows(duck, ORACLES[name])
    found = QUERIES[name](spark, SMALL)
    assert sorted(found.columns) == columns
    assert rows_of(found) == expected
