"""One small local session for all tests, and a DuckDB connection over the driver's tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    return con


def rows_of(frame) -> list[tuple]:
    """Sorted rows with columns in order of their names; floats rounded to 6 places."""
    names = sorted(frame.columns)
    cells = lambda v: f"{v:.6f}" if isinstance(v, float) else repr(list(v) if isinstance(v, list | tuple) else v)
    return sorted(tuple(cells(r[c]) for c in names) for r in frame.select(*names).collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cells = lambda v: f"{v:.6f}" if isinstance(v, float) else repr(v)
    return sorted(columns), sorted(tuple(cells(r[k]) for k in order) for r in got.fetchall())
