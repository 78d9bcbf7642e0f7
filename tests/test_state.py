"""Keyed state of streams against the batch forms, after every micro-batch."""

import json
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentryspark.config import Config
from sentryspark.operators import ingest, mappers
from sentryspark.schema import EVENTS, SESSIONS
from sentryspark.streaming import state

START = datetime(2026, 1, 1)


def stamp(n):
    return (START + timedelta(seconds=n)).strftime("%Y-%m-%dT%H:%M:%SZ")


@pytest.fixture
def stateful(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield state.prepared(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def batches_of_events(seed, batches=9):
    rng, out, seq = random.Random(seed), [], 0
    for batch in range(batches):
        rows = []
        for _ in range(rng.randrange(3, 18)):
            kind = rng.choice(["connection", "login_attempt", "command", "session_end", "heartbeat"])
            details = {"login_attempt": {"username": rng.choice(["a", "b", None]), "password": rng.choice([None, "p", "q"])}, "session_end": {"status": rng.choice(["closed", "failed"])}}.get(kind, {})
            beat = kind == "heartbeat"
            at = batch * 600 - rng.choice([0, 5, 200, 900, 2400])  # some are very late
            rows.append((seq, str(seq), f"node-0{rng.randrange(1, 4)}", None if beat else f"s{rng.randrange(12)}", kind, stamp(at), rng.choice([None, "1.2.3.4"]), rng.choice([None, "ssh"]), json.dumps(details), stamp(batch * 600)))
            seq += 1
        rng.shuffle(rows)
        out.append(rows)
    return out


def played(spark, tmp_path, batches, schema, build, mode="update"):
    """What the stream emits in each micro-batch, one for each file and an empty last one if time has to move."""
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = (
        build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        .writeStream.outputMode(mode).foreachBatch(lambda frame, number: seen.append([r.asDict() for r in frame.collect()]))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    if not query.awaitTermination(150):
        query.stop()
        raise TimeoutError
    return seen


def test_sessions_after_every_batch(stateful, tmp_path):
    batches, table = batches_of_events(1, 6), {}
    for k, changes in enumerate(played(stateful, tmp_path, batches, EVENTS, state.session_changes)):
        table |= {r["session_id"]: tuple(r[c] for c in SESSIONS.fieldNames()) for r in changes}
        log = stateful.createDataFrame([r for b in batches[: k + 1] for r in b], EVENTS)
        assert sorted(map(str, table.values())) == sorted(str(tuple(r[c] for c in SESSIONS.fieldNames())) for r in ingest.folded_sessions(log).collect())
        assert {r["session_id"] for r in changes} == {r[3] for r in batches[k] if r[3]}  # a batch emits its own sessions only
    assert k == 5


CONFIG = Config(stale_session_seconds=1500, offline_seconds=700)


def test_stale_sessions_and_silent_nodes_by_the_clock(stateful, tmp_path):
    arrived = F.to_timestamp("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    batches = [*batches_of_events(2, 6), [(9999, "last", "node-01", "s99", "command", stamp(9000), None, None, "{}", stamp(9000))]]
    sessions, nodes, by_time = {}, {}, 0
    changed = played(stateful, tmp_path / "s", batches, EVENTS, lambda x: state.session_changes(x, CONFIG, arrived))
    seen = played(stateful, tmp_path / "n", batches, EVENTS, lambda x: state.node_changes(x, arrived, CONFIG))
    assert len(changed) == len(seen) == len(batches) + 1
    clock = ["1970-01-01T00:00:00Z", *(stamp(k * 600) for k in range(6)), stamp(9000)]  # the latest arrival of the batches before
    for k, now in enumerate(clock):
        order = lambda r: r["change"] == "time"
        sessions |= {r["session_id"]: str(tuple(r[c] for c in SESSIONS.fieldNames())) for r in sorted(changed[k], key=order)}
        nodes |= {r["node_id"]: (r["last_seen"], r["status"]) for r in sorted(seen[k], key=order)}
        by_time += sum(map(order, changed[k] + seen[k]))
        log = stateful.createDataFrame([r for b in batches[: k + 1] for r in b], EVENTS)
        expected = ingest.closed_stale_sessions(ingest.folded_sessions(log), log, now, CONFIG).select(*SESSIONS.fieldNames())
        assert sorted(sessions.values()) == sorted(str(tuple(r)) for r in expected.collect())
        assert nodes == {r["node_id"]: (r["last_seen"], r["status"]) for r in ingest.with_stale_nodes_offline(ingest.touched_nodes(log), now, CONFIG).collect()}
    assert by_time > 3


def test_durations_over_batches(stateful, tmp_path):
    rng, lines = random.Random(6), []
    for k in range(40):
        at = sorted(rng.randrange(5000) for _ in range(3))
        link = {"id": f"{k % 15:064x}", "protocol": "ftpd", "remote_ip": "1.2.3.4", "remote_port": 5, "local_ip": "9.9.9.9", "local_port": 21}
        for origin, t in zip(("dionaea.connection.tcp.accept", "dionaea.modules.python.ftp.login", "dionaea.connection.free"), at, strict=True):
            when = (START + timedelta(seconds=t, milliseconds=k)).strftime("%Y-%m-%dT%H:%M:%S.%f")
            lines.append((when, json.dumps({"origin": origin, "timestamp": when, "data": {"connection": link, "username": "u"}})))
    lines.append(("9", json.dumps({"connection": {"type": "accept", "protocol": "ftpd"}, "timestamp": "2026-01-01T00:00:00", "src_ip": "1.2.3.4"})))
    lines = [(x,) for _, x in sorted(lines)]
    parts = [lines[k : k + 31] for k in range(0, len(lines), 31)]
    schema = stateful.createDataFrame([], "line string").schema
    out = [r for rows in played(stateful, tmp_path, parts, schema, lambda x: state.service_stream(x, "node-02"), "append") for r in rows]
    cut = lambda r: (r["line"][:200], r["index"], r["event_type"], r["details"])
    expected = mappers.service_events(stateful.createDataFrame(lines, schema), "node-02").collect()
    assert sorted(map(cut, out)) == sorted(map(cut, expected)) and sum("duration_seconds" in r["details"] for r in out) == 40
    assert len(out) == 122


class _Map(dict):
    iterator, updateValue, removeKey = dict.items, dict.__setitem__, dict.pop


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class _Timers(set):
    registerTimer, deleteTimer = set.add, set.remove


def test_open_connections_stay_bounded():
    one = state.OpenConnections(4, 1000)
    one.handle, one.accepts, one.until = _Timers(), _Map(), _Value()
    row = lambda k: {"line": "", "index": 0, "node_id": "n", "event_type": "connection", "timestamp": stamp(k), "session_id": "s", "attacker_ip": "", "protocol": "", "details": "", "at": k, "ms": k}
    for k in range(100):
        list(one.handleInputRows(("s",), iter([row(k)]), None))
        assert len(one.accepts) <= 4 and one.handle == {k + 1000}
    assert sorted(one.accepts) == [(96,), (97,), (98,), (99,)]
    list(one.handleExpiredTimer(("s",), None, None))
    assert not one.accepts and not one.until.exists()


def test_a_sensors_events_are_reduced_before_they_are_shuffled(spark):
    rows = pa.table({"node_id": ["b", "a", "b", None, "c", "b"], "timestamp": ["1", "5", "3", "4", None, None], "arrived": pa.array([7, 9, 8, 1, 2, 3], pa.timestamp("us", "UTC"))})
    out = [r for b in state._latest(iter(rows.to_batches())) for r in b.to_pylist()]
    assert sorted((str(r["node_id"]), str(r["timestamp"]), r["arrived"].microsecond) for r in out) == [("None", "4", 1), ("a", "5", 9), ("b", "3", 8), ("c", "None", 2)]
