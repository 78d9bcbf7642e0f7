"""Queries over users so many that the views' addresses go on past 203.0.255.255, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sentryspark.plans.catalogue import BUILDS, ORACLES, Tables
from sentryspark.sources import tables
from tests.conftest import SMALL, duck_rows, rows_of


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("many"), duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (user_id * 9000 AS user_id) FROM read_parquet('{SMALL}/events.parquet')) TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["usable_addresses", "validate_profiles", "validate_types", "map_service_incidents", "map_service_kinds", "map_service_lists", "stream_service_incidents"])
def test_equals_sql(spark, many, name):
    folder, con = many
    found = BUILDS[name](Tables(spark, str(folder)))
    columns, expected = duck_rows(con, ORACLES[name])
    assert sorted(found.columns) == columns
    assert rows_of(found) == expected
    assert expected


def test_addresses_there_and_back(spark):
    rows = spark.createDataFrame([(x,) for x in ("203.0.113.7", "203.0.255.255", "203.0.256.0", "203.0.65535.9", None)], "ip string").select("ip", tables.sendable(F.col("ip")).alias("sent"))
    assert [tuple(r) for r in rows.select("sent", tables.as_viewed(F.col("sent")) == F.col("ip")).collect()] == [("203.0.113.7", True), ("203.0.255.255", True), ("203.1.0.0", True), ("203.255.255.9", True), (None, None)]
