"""Batches in a landing folder: what is decided of each, and that a crash neither loses nor repeats anything."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from sentryspark.streaming import batches, pipeline
from tests.test_engine import GOOD

KEYS = {"node-01": hashlib.sha256(b"k1").hexdigest(), "node-02": hashlib.sha256(b"k2").hexdigest()}



def event(name, **changed):
    return GOOD | {"event_id": str(uuid.uuid5(uuid.NAMESPACE_URL, name))} | changed


def sent(folder, name, body):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body))


def test_statuses(spark, tmp_path):
    good = {"node_id": "node-01", "node_key": "k1", "events": [event("a")]}
    cases = {
        "good": (good, 200), "key": (good | {"node_key": "k2"}, 401), "nokey": ({"node_id": "node-01", "events": [event("a")]}, 401), "stranger": (good | {"node_id": "node-09"}, 401), "many": (good | {"events": [event(str(k)) for k in range(21)]}, 422),
        "manykey": (good | {"node_key": "x", "events": [event(str(k)) for k in range(21)]}, 401), "none": (good | {"events": []}, 422), "list": ("[]", 422), "broken": ("{", 422), "null": (good | {"events": None}, 422), "other": ({"node_id": "node-02", "node_key": "k2", "events": [event("a")]}, 403),
        "text": (good | {"events": ["x"]}, 403), "twenty": (good | {"events": [event(str(k)) for k in range(20)]}, 200), "numbers": (good | {"node_id": 5, "node_key": 6}, 401),
    }
    rows = spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x), f"file:/x/{k}") for k, (x, _) in cases.items()], "value string, file string")
    found = {r["batch_id"]: r["status"] for r in batches.judged(rows, KEYS).collect()}
    assert found == {k: v for k, (_, v) in cases.items()}
    assert {r["status"] for r in batches.judged(rows, {}).collect()} == {401, 422}


def test_a_crash_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for k in range(4):
        sent(source, f"{k}.json", {"node_id": "node-01", "node_key": "k1", "events": [event(f"{k}-{n}", details={"username": "u", "password": None}) for n in range(5)] + [event("0-0")]})
    sent(source, "bad.json", {"node_id": "node-01", "node_key": "no", "events": [event("never")]})
    run = lambda: batches.take_in(spark, str(source), out, checkpoint, KEYS, F.lit("2026-07-19T15:00:09Z"), files=2).awaitTermination()
    real, calls = batches.ingested, []

    def crashing(rows, number, *rest):
        real(rows, number, *rest)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("crash after writing, before the commit")

    monkeypatch.setattr(batches, "ingested", crashing)
    with pytest.raises(Exception, match="crash"):
        run()
    run()
    run()
    assert calls[:3] == [0, 1, 1]  # the same micro-batch again
    log = pipeline.stored_events(spark, out).collect()
    assert sorted(r["event_id"] for r in log) == sorted(event(f"{k}-{n}")["event_id"] for k in range(4) for n in range(5))
    assert len({r["seq"] for r in log}) == 20
    decided = spark.read.parquet(f"{out}/batches").groupBy("batch_id").agg(F.max("status").alias("status"), F.count("*").alias("n")).collect()
    assert {r["batch_id"]: (r["status"], r["n"]) for r in decided} == {"bad.json": (401, 1)} | {f"{k}.json": (200, 1) for k in range(4)}


def test_packed_batches(spark, tmp_path):
    """Batches in lines are judged as those in files of their own; a line without an id isn't lost."""
    good = {"node_id": "node-01", "node_key": "k1", "events": [event("a"), event("b")]}
    bodies = {"b1": json.dumps(good), "b2": json.dumps(good | {"node_key": "k2"}), "b3": "{"}
    source = tmp_path / "landing"
    source.mkdir()
    (source / "part-0.txt").write_text("".join(f"{k}\t{v}\n" for k, v in bodies.items()) + "no id\n")
    out = str(tmp_path / "judged")
    step = lambda rows, number: batches.judged(rows, KEYS).write.parquet(f"{out}/batch={number}")
    batches.landed_packed(spark, str(source)).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.createDataFrame([*((v, k) for k, v in bodies.items()), ("no id", None)], "value string, file string")
    key = lambda frame: sorted((str(r["batch_id"]), r["sender"], r["status"], r["reason"], r["events"]) for r in frame.collect())
    assert key(spark.read.parquet(out)) == key(batches.judged(rows, KEYS))
