"""Kept partials against the operators over the whole log, and what reading them costs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sentryspark.operators import ingest, rollups, rules
from sentryspark.schema import ALERTS, EVENTS, REPUTATION
from sentryspark.sources.tables import stored
from sentryspark.streaming.partials import Panes, Rollups
from tests.conftest import rows_of
from tests.test_engine import _stamp
from tests.test_stores import bytes_read


def batch_of(spark, rng, number, n=150):
    rows = []
    for k in range(n):
        kind = rng.choice(["connection", "login_attempt", "login_success", "command", "file_download", "heartbeat"])
        details = {"login_attempt": {"username": rng.choice(["a", "b", "c", "d", "e", "f", None])}, "login_success": {"username": "z"}, "command": {"command": rng.choice(["wget x", "ls"])}, "file_download": {"file_name": "f"}}.get(kind, {})
        at = number * 120 + rng.randrange(-400, 120)  # late ones among them
        beat = kind == "heartbeat"
        seq = number * 1000 + k
        rows.append((seq, str(seq), f"node-0{rng.randrange(1, 4)}", None if beat else f"s{rng.randrange(40)}", kind, _stamp(36_000 + at), None if beat else f"10.0.0.{rng.randrange(9)}", None, json.dumps(details), _stamp(36_000 + at + rng.randrange(9))))
    return stored(spark.createDataFrame(rows, EVENTS), "batch")


def test_rollups_equal_those_of_the_log(spark, tmp_path):
    rng, kept, log = random.Random(8), Rollups(spark, str(tmp_path / "r"), fan_in=3), None
    for number in range(4):
        batch = batch_of(spark, rng, number)
        for _ in range(2 if number == 3 else 1):  # tried again
            kept.add(batch, number)
        log = batch if log is None else log.unionByName(batch)
    since = "2026-01-01T10:00:00Z"
    alerts = spark.createDataFrame([(str(k), "10.0.0.1", f"s{k}", "x", "high", _stamp(36_000 + k), "d", "open") for k in range(9)], ALERTS)
    nodes = ingest.touched_nodes(log)
    assert rows_of(kept.attacker_summary()) == rows_of(rollups.attacker_summary(log))
    for by in ("hour", "day"):
        assert rows_of(kept.activity(since, by)) == rows_of(rollups.activity(log, since, by))
    assert rows_of(kept.node_statistics(nodes, alerts, since)) == rows_of(rollups.node_statistics(nodes, log, alerts, since))
    with pytest.raises(ValueError, match="full"):
        kept.activity("2026-01-01T10:00:01Z")


def test_findings_from_panes_at_each_step(spark, tmp_path):
    rng, panes, log = random.Random(9), Panes(spark, str(tmp_path / "p"), fan_in=3), None
    reputation, cost = spark.createDataFrame([("10.0.0.1", "U", "C", 1.0, 2.0, 90, "x", 60, _stamp(0))], REPUTATION), {}
    for number in range(5):
        batch = batch_of(spark, rng, number)
        panes.add(batch, number)
        log = batch if log is None else log.unionByName(batch)
        since = _stamp(36_000 + (number - 2) * 120)
        if number in (2, 4):
            before = bytes_read(spark)
            found = rows_of(panes.evaluated(reputation, since))
            cost[number] = bytes_read(spark) - before
            assert found == rows_of(rules.evaluated(log, reputation, since)) and len({r for r in found}) > 20
    panes.add(batch, 4)  # tried again
    assert rows_of(panes.evaluated(reputation, since)) == found
    panes.drop(since)
    assert rows_of(panes.evaluated(reputation, since)) == found
    assert cost[4] < 2 * cost[2]
    with pytest.raises(ValueError, match="pane"):
        panes.counters("2026-01-01T10:00:01Z")
    assert panes.counters("2027-01-01T00:00:00Z").count() == 0


def test_many_rows_are_reduced_without_sorting(spark, tmp_path):
    """Times of any form count as in the log, and neither adding a batch nor merging runs sorts its rows."""
    kept, own = Rollups(spark, str(tmp_path / "r")), []
    merge = kept.sums.merge
    kept.sums.merge = lambda x: own.append(merge(x)) or own[-1]
    odd = ["2026-01-01T10:59:59.5Z", "2026-01-01T10:59", "2026-01-01T10:59:59Z\n", "0026-01-01T10:00:00Z", None]
    rows = [(k, str(k), "node-01", "s", "heartbeat" if k % 2 else "command", stamp, None if k % 2 else "10.0.0.1", None, "{}", _stamp(36_000)) for k, stamp in enumerate([*odd, *odd, *(_stamp(36_000 + 700 * j) for j in range(6))])]
    log = stored(spark.createDataFrame(rows, EVENTS), "batch")
    for number in range(8):
        kept.add(log.where(f"seq % 8 = {number}"), number)
    assert [x["level"] for x in kept.sums.state()["runs"]] == [1] and own
    plan = own[0]._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    none, nodes = spark.createDataFrame([], ALERTS), ingest.touched_nodes(log)
    assert rows_of(kept.attacker_summary()) == rows_of(rollups.attacker_summary(log))
    assert rows_of(kept.node_statistics(nodes, none, "2026-01-01T10:00:00Z")) == rows_of(rollups.node_statistics(nodes, log, none, "2026-01-01T10:00:00Z"))


def test_panes_of_large_batches(spark, tmp_path):
    """Logins of a large batch begin in several parts, panes are reduced without sorting, and times of another form count as in the log."""
    panes, written = Panes(spark, str(tmp_path / "p"), fan_in=2), {}
    panes.logins.PART_ROWS = 40
    write = panes._write
    panes._write = lambda name, rows, number: (written.setdefault(name, rows), write(name, rows, number))
    log = batch_of(spark, random.Random(3), 1, n=600)
    odd = stored(log.withColumn("timestamp", F.when(F.col("seq") % 5 == 0, F.concat(F.substring("timestamp", 1, 19), F.lit(".5Z"))).otherwise(F.col("timestamp"))), "batch")
    panes.add(odd, 0)
    assert panes.logins.state()["runs"][0]["parts"] > 1
    for name in ("counts", "typed"):
        plan = written[name]._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "Sort" not in plan
    reputation, since = spark.createDataFrame([], REPUTATION), _stamp(36_000 - 360)
    assert rows_of(panes.evaluated(reputation, since)) == rows_of(rules.evaluated(odd, reputation, since))
