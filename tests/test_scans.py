"""Neighbours across range partitions, and substring search by trigrams."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentryspark.functions.scalar import contains
from sentryspark.operators import search, trigrams
from sentryspark.schema import SESSIONS
from tests.conftest import rows_of
from tests.test_stores import bytes_read


def by_window(sessions):
    line = Window.partitionBy("attacker_ip").orderBy(F.desc("start_time"), "session_id")
    return sessions.where("attacker_ip is not null").select("session_id", "attacker_ip", F.lag("session_id").over(line).alias("prev"), F.lead("session_id").over(line).alias("next"), F.row_number().over(line).cast("long").alias("position"), F.count(F.lit(1)).over(Window.partitionBy("attacker_ip")).alias("sessions"))


@pytest.mark.parametrize("shares", [[1], [30, 1, 1, 1], [1] * 60])
def test_neighbours_lie_across_partitions(spark, shares):
    rng = random.Random(len(shares))
    ips = [f"10.0.0.{k}" for k, n in enumerate(shares) for _ in range(n)]
    rows = [(f"s{k}", "n", rng.choice(ips) if k % 50 else None, None, None, None, f"2026-01-01T00:00:{rng.randrange(60):02}Z", None, "active") for k in range(900)]
    sessions = spark.createDataFrame(rows, SESSIONS)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(search.adjacent_sessions(sessions)) == rows_of(by_window(sessions))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_no_neighbours(spark):
    assert search.adjacent_sessions(spark.createDataFrame([], SESSIONS)).count() == 0


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng, words = random.Random(1), ["wget", "http", "cat", "passwd", "É%", "chmod_x", "back\\slash", "curl", "uname", "nproc"]
    rows = [(k, None if k % 97 == 0 else " ".join(rng.choices(words, k=3)) + (f" rare{k // 500}Token" if k % 500 == 3 else ""), f"d{k % 7}" * 20, f"{rng.getrandbits(800):x}") for k in range(20_000)]
    path = str(tmp_path_factory.mktemp("index"))
    frame = spark.createDataFrame(rows, "k int, command string, note string, body string").cache()
    trigrams.build(frame, ["command", "note"], path, ["k"], block_rows=200)
    return frame, path


@pytest.mark.parametrize("query", ["RARE7token", "rare3%ken", "wget_http", "é%", "\\sla", "nothing at all", "d3d3", "ca", "chmod_x", "%", "PASSWD cat", "rare_Token"])
def test_same_rows_as_contains(spark, indexed, query):
    frame, path = indexed
    expected = frame.where(F.coalesce(contains(F.col("command"), query), F.lit(False)) | F.coalesce(contains(F.col("note"), query), F.lit(False)))
    assert rows_of(trigrams.search(spark, path, ["command", "note"], query)) == rows_of(expected)


def test_fewer_bytes_are_read(spark, indexed):
    cost = {}
    for query in ("rare7token", "wget"):
        before = bytes_read(spark)
        trigrams.search(spark, indexed[1], ["command", "note"], query).write.format("noop").mode("overwrite").save()
        cost[query] = bytes_read(spark) - before
    assert cost["rare7token"] < cost["wget"] / 2
    assert trigrams.query_grams("aB%cde_fg") == ["cde"]
