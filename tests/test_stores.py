"""Growing tables: ids without a horizon, sequence numbers, runs, snapshots; and what they read and write."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from sentryspark.operators import ingest
from sentryspark.schema import REPUTATION
from sentryspark.sources.store import Runs, Snapshot, get_text, names, put_text
from sentryspark.sources.tables import stored
from sentryspark.streaming import pipeline
from sentryspark.streaming.ids import SCHEMA, Ids
from tests.test_engine import GOOD


def bytes_read(spark) -> int:
    """Bytes that Hadoop's file systems have read in this process, which is all of them on a local master."""
    return sum(x.getBytesRead() for x in spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def ids(spark, numbers):
    return spark.createDataFrame([(str(uuid.uuid5(uuid.NAMESPACE_URL, str(x))),) for x in numbers], SCHEMA)


@pytest.mark.parametrize("filtered", [10_000, 3])
def test_ids_of_any_age_are_known(spark, tmp_path, filtered):
    store, rng, seen = Ids(spark, str(tmp_path / "ids"), fan_in=3, filtered=filtered), random.Random(4), set()
    for number in range(14):
        own = {rng.randrange(200) for _ in range(12)}
        batch = stored(ids(spark, own), "batch")
        found = {r[0] for r in store.known(batch, number).collect()}
        assert found == {r[0] for r in ids(spark, own & seen).collect()} if own & seen else not found
        fresh = own - seen
        for _ in range(2 if number % 4 == 0 else 1):  # tried again
            store.add(ids(spark, fresh), number)
        seen |= fresh
    assert sorted(r[0] for r in store.runs.rows().collect()) == sorted(r[0] for r in ids(spark, seen).collect())
    levels = [x["level"] for x in store.runs.state()["runs"]]
    assert max(levels) == 2 and all(levels.count(x) < 3 for x in levels)
    assert store.known(stored(ids(spark, seen), "batch"), 5).count() < len(seen)  # only what came before


def test_a_batch_reads_the_same_however_long_the_log_is(spark, tmp_path):
    store, cost = Ids(spark, str(tmp_path / "ids"), fan_in=3), {}
    for number in range(28):
        store.add(ids(spark, range(number * 1000, number * 1000 + 1000)), number)
        if number in (4, 13, 27):
            asked = stored(ids(spark, [3, 10**7, 10**7 + 1]), "asked")
            before = bytes_read(spark)
            assert store.known(asked, number + 1).count() == 1
            cost[number] = bytes_read(spark) - before
    assert cost[27] < 2 * cost[13] and cost[27] < 28_000 * 36 / 3  # twice the log: one level more, not three times the bytes


def test_sequence_numbers_never_overlap(spark, tmp_path):
    make = lambda tag: [json.dumps(GOOD | {"event_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{tag}{k}"))}) for k in range(200)]
    for number in range(2):
        batch = spark.createDataFrame([(x,) for x in make(number)], "value string").repartition(200)
        for _ in range(2):
            pipeline.ingested(batch, number, str(tmp_path / "out"), F.lit("2026-07-19T15:00:01Z"))
    seq = {number: [r["seq"] for r in pipeline.stored_events(spark, str(tmp_path / "out"), number + 1).collect()] for number in range(2)}
    assert sorted(seq[1]) == list(range(400)) and sorted(seq[0]) == list(range(200))


def test_text_files(spark, tmp_path):
    path = str(tmp_path / "x" / "y.json")
    put_text(spark, path, "é1")
    put_text(spark, path, "é2")
    assert get_text(spark, path) == "é2" and names(spark, str(tmp_path / "x")) in (["y.json"], [".y.json.crc", "y.json"]) and names(spark, str(tmp_path / "none")) == []


def test_runs_merge_partial_sums(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n long").schema
    runs = Runs(spark, str(tmp_path / "runs"), schema, merge=lambda x: x.groupBy("k").agg(F.sum("n").alias("n")), fan_in=3)
    for number in range(10):
        runs.add(spark.createDataFrame([(x, number) for x in "ab"], schema), number)
    assert {r["k"]: r["n"] for r in runs.rows().groupBy("k").agg(F.sum("n").alias("n")).collect()} == {"a": 45, "b": 45}
    assert runs.rows().count() == 2 * len(runs.state()["runs"]) and [r["n"] for r in runs.rows(9).collect()] == [36, 36]
    on_disk = [x for x in names(spark, str(tmp_path / "runs")) if x.startswith("run-")]
    assert len(on_disk) <= len(runs.state()["runs"]) + len(runs.state()["gone"])


def reputation(spark, rows):
    return spark.createDataFrame([(ip, None, city, None, 1.5, abuse, "ip-api", None, "2026-01-01T00:00:00Z") for ip, city, abuse in rows], REPUTATION)


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    snapshot = Snapshot(spark, str(tmp_path / "rep"), REPUTATION, "attacker_ip", buckets=16)
    old = reputation(spark, [(f"10.0.0.{k}", f"C{k}", k) for k in range(200)])
    assert len(snapshot.upsert(old, 0, ingest.merged_reputation)) == 16
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "rep").rglob("*.parquet")}
    new = reputation(spark, [("10.0.0.7", None, 99), ("10.9.9.9", "new", 5)])
    touched = snapshot.upsert(new, 1, ingest.merged_reputation)
    assert 1 <= len(touched) <= 2
    made = [p for p in (tmp_path / "rep").rglob("*.parquet") if p not in files]
    assert {p.parent.name for p in made} == {f"bucket={b}" for b in touched} and all(p.stat().st_mtime_ns == t for p, t in files.items())
    expected = ingest.merged_reputation(ingest.merged_reputation(spark.createDataFrame([], REPUTATION), old), new)
    assert sorted(map(tuple, snapshot.rows().collect())) == sorted(map(tuple, expected.collect()))
    assert snapshot.rows(1).count() == 200


def test_a_failed_upsert_leaves_the_old_snapshot(spark, tmp_path):
    snapshot = Snapshot(spark, str(tmp_path / "rep"), REPUTATION, "attacker_ip", buckets=4)
    old = reputation(spark, [(f"10.0.0.{k}", "a", k) for k in range(20)])
    snapshot.upsert(old, 0, ingest.merged_reputation)

    def failing(a, b):
        return ingest.merged_reputation(a, b).withColumn("city", F.when(F.col("attacker_ip") == "10.0.0.3", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.lit("b")))

    with pytest.raises(Exception, match="broken"):
        snapshot.upsert(old, 1, failing)
    assert {r["city"] for r in snapshot.rows().collect()} == {"a"} and snapshot.rows().count() == 20
    snapshot.upsert(old.withColumn("city", F.lit("c")), 1, ingest.merged_reputation)  # tried again
    assert {r["city"] for r in Snapshot(spark, str(tmp_path / "rep"), REPUTATION, "attacker_ip", buckets=99).rows().collect()} == {"c"}
    assert snapshot.upsert(old.limit(0), 2, ingest.merged_reputation) == [] and snapshot.rows().count() == 20


def test_a_large_batch_of_ids_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Runs, "PART_ROWS", 100)
    store = Ids(spark, str(tmp_path / "ids"), fan_in=2, filtered=10)
    for number in range(3):
        store.add(stored(ids(spark, range(number * 1000, number * 1000 + 1000)), "batch"), number)
    assert sorted((x["level"], x["parts"], len(x["full"])) for x in store.runs.state()["runs"]) == [(0, 16, 16), (1, 32, 32)]
    asked = stored(ids(spark, range(900, 3100)), "asked")
    assert store.known(asked, 3).count() == 2100 and store.known(asked, 0).count() == 0
    few = stored(ids(spark, [3, 2999, 5000]), "few")
    assert store.known(few, 3).count() == 2
