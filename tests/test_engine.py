"""Validation, folds, cooldown, mappers, feed and streaming on hand-built rows."""

import gzip
import json
import random
import re
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sentryspark.config import Config
from sentryspark.functions import scalar
from sentryspark.operators import feed, ingest, mappers, rollups, rules, search
from sentryspark.plans import screens
from sentryspark.plans.catalogue import Tables
from sentryspark.schema import ALERTS, EVENTS, NODES, REPUTATION
from sentryspark.sources import tables
from sentryspark.streaming import pipeline

GOOD = {"event_id": "7b0c2a9e-35cf-4a0f-9a44-2f6f7a3c1d10", "node_id": "node-01", "event_type": "login_attempt", "timestamp": "2026-07-19T15:00:00.123Z", "session_id": "s1", "attacker_ip": "198.51.100.9", "protocol": "ssh", "details": {"username": "root", "password": None}}


def without(key):
    return {k: v for k, v in GOOD.items() if k != key}


CASES = [
    (GOOD, []),
    (GOOD | {"details": {"username": "r", "password": "p"}}, []),
    (GOOD | {"event_type": "heartbeat", "session_id": None, "attacker_ip": None, "protocol": None, "details": {"status": "online"}}, []),
    (without("protocol"), ["missing top-level field 'protocol' (use null, do not omit)"]),
    (GOOD | {"z": 1, "a": 2}, ["unexpected top-level field(s): a, z"]),
    (GOOD | {"event_type": "nothing"}, ["event_type 'nothing' is not an allowed type"]),
    (GOOD | {"event_type": None}, ["event_type 'null' is not an allowed type"]),
    (GOOD | {"event_id": "x"}, ["event_id must be a valid UUID string"]),
    (GOOD | {"node_id": None}, ["node_id must be non-null"]),
    (GOOD | {"node_id": "node-09"}, ["node_id 'node-09' is not a registered node"]),
    (GOOD | {"timestamp": "2026-07-19 15:00:00"}, ["timestamp must be ISO 8601 UTC, e.g. 2026-07-19T15:00:00Z"]),
    (GOOD | {"timestamp": "2026-07-19T15:00:00+02:00"}, ["timestamp must be ISO 8601 UTC, e.g. 2026-07-19T15:00:00Z"]),
    (GOOD | {"timestamp": "2026-02-30T15:00:00Z"}, ["timestamp '2026-02-30T15:00:00Z' is not a real date/time"]),
    (GOOD | {"session_id": ""}, ["session_id must be non-null for 'login_attempt' events"]),
    (GOOD | {"event_type": "heartbeat", "details": {"status": "online"}}, ["session_id must be null for heartbeat events", "attacker_ip must be null for heartbeat events", "protocol must be null for heartbeat events"]),
    (GOOD | {"protocol": "gopher"}, ["protocol 'gopher' is not an allowed one"]),
    (GOOD | {"details": None}, ["details must be an object, never null"]),
    (GOOD | {"details": [1]}, ["details must be a JSON object, not array"]),
    (GOOD | {"details": {"username": "r", "host": 1}}, ["details key(s) not allowed for 'login_attempt': host"]),
    (GOOD | {"details": {"username": ""}}, ["details.username is required and must be non-null for 'login_attempt'"]),
    (GOOD | {"event_type": "command", "details": {}}, ["details.command is required and must be non-null for 'command'"]),
    (GOOD | {"event_type": "file_download", "details": {"file_name": "x"}}, ["'file_download' requires at least one of: download_url, file_hash"]),
]


def test_reasons(spark):
    lines = spark.createDataFrame([(k, json.dumps(e)) for k, (e, _) in enumerate(CASES)] + [(100, "no json"), (101, "[1]"), (102, "")], "k int, line string")
    found = {r["k"]: r["errors"] for r in ingest.validated(lines).collect()}
    assert {k: found[k] for k in range(len(CASES))} == {k: e for k, (_, e) in enumerate(CASES)}
    assert {found[k][0] for k in (100, 101, 102)} == {"event must be a JSON object"}
    loose = {r["k"]: r["errors"] for r in ingest.validated(lines, Config(strict_nodes=False)).collect()}
    assert loose[9] == []
    strict = spark.createDataFrame([(json.dumps(GOOD | {"attacker_ip": "nowhere"}),), (json.dumps(GOOD | {"details": {"username": "  "}}),), (json.dumps(GOOD),)], "line string")
    assert [len(r["errors"]) for r in ingest.validated(strict, profile="collector").collect()] == [1, 1, 0]


def test_details_are_canonical(spark):
    odd = [
        {"username": "é", "password": "x"}, {"username": 'a":,\\"b, c: d', "password": None}, {"username": "\x1b[0m\x0b\n\\u001B", "password": "\\\\\x1f"}, {"username": [{"b": 1, "a": [1.5, True]}, {}], "password": 3},
        {"username": "\\n," * 5000, "password": "," * 20_000},
    ]
    lines = spark.createDataFrame([(k, json.dumps(GOOD | {"details": d}, ensure_ascii=k % 2 == 0), "now") for k, d in enumerate(odd)], "seq int, line string, received_at string")
    found = {r["seq"]: r["details"] for r in ingest.normalized(ingest.validated(lines)).collect()}
    assert found == {k: json.dumps(d, ensure_ascii=False, sort_keys=True) for k, d in enumerate(odd)}


def test_batches_and_lines(spark, tmp_path):
    rows = [("a", "node-01", json.dumps(GOOD))] * 21 + [("b", "node-02", json.dumps(GOOD)), ("c", "node-01", json.dumps(GOOD))]
    found = ingest.batch_rejections(spark.createDataFrame(rows, "batch_id string, header_node string, line string")).collect()
    assert {r["batch_id"]: r["reason"] for r in found} == {"a": "more than 20 events", "b": "node_id differs from the sender's"}
    (tmp_path / "x.jsonl").write_text('// note\n\n{"timestamp": "2026-01-02T00:00:00Z"}\n{"timestamp": "2025-01-02T00:00:00Z"}\nbroken\n')
    lines = tables.read_lines(spark, str(tmp_path))
    assert [r["valid"] for r in tables.parsed_lines(lines).orderBy("line").collect()] == [False, True, True]
    assert tables.read_lines(spark, str(tmp_path), since="2026-01-01T00:00:00Z").count() == 2
    for name in ("log.json", "log.json.2026-08-07", "log.json.2026-08-06.gz"):
        (tmp_path / "rotated").mkdir(exist_ok=True)
        body = f'{{"from": "{name}"}}'.encode()
        (tmp_path / "rotated" / name).write_bytes(gzip.compress(body) if name.endswith("gz") else body)
    ordered = tables.file_order(tables.read_lines(spark, str(tmp_path / "rotated")), "log.json").orderBy("age").collect()
    assert [json.loads(r["line"])["from"] for r in ordered] == ["log.json.2026-08-06.gz", "log.json.2026-08-07", "log.json"]
    with pytest.raises(Exception, match="not a JSON object"):
        tables.parsed_lines(lines, strict=True).collect()
    described = {r["name"]: (r["readable"], len(r["missing"])) for r in tables.describe(spark, {"events": "/root/testdata/sf0.001/events.parquet", "alerts": str(tmp_path / "none")}).collect()}
    assert described["alerts"] == (False, 8) and described["events"][0]


def _stamp(n: int) -> str:
    return (datetime(2026, 1, 1) + timedelta(seconds=n)).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_fold_equals_replay(spark):
    rng, rows, state = random.Random(1), [], {}
    for seq in range(1500):
        kind = rng.choice(["connection", "login_attempt", "login_success", "command", "session_end"])
        details = {"login_attempt": {"username": rng.choice(["a", "b", None]), "password": rng.choice([None, "p"])}, "login_success": {"username": "c"}, "session_end": {"status": rng.choice(["closed", "failed", "error"])}}.get(kind, {})
        sid, ip, protocol, stamp = f"s{rng.randint(0, 60)}", rng.choice([None, "1.2.3.4", "5.6.7.8"]), rng.choice([None, "ssh", "ftp"]), _stamp(rng.randint(0, 5000))
        node = rng.choice(["node-01", "node-02"])
        rows.append((seq, str(seq), node, sid, kind, stamp, ip, protocol, json.dumps(details), stamp))
        s = state.setdefault(sid, {"node_id": node, "attacker_ip": None, "protocol": None, "username": None, "password": None, "start_time": stamp, "end_time": None, "status": "active"})
        s["attacker_ip"], s["protocol"] = s["attacker_ip"] or ip, s["protocol"] or protocol
        s["username"], s["password"] = details.get("username") or s["username"], details.get("password") or s["password"]
        s["start_time"] = min(s["start_time"], stamp)
        if kind == "session_end":
            s["end_time"], s["status"] = stamp, "closed" if details["status"] == "closed" else "failed"
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, EVENTS).repartition(7)
    found = {r["session_id"]: {k: r[k] for k in next(iter(state.values()))} for r in ingest.folded_sessions(events).collect()}
    assert found == state
    again = ingest.outcomes(events.unionByName(events.withColumn("seq", F.col("seq") + 5000)), events.where("seq < 100"))
    assert {(r["outcome"], r["count"]) for r in again.groupBy("outcome").count().collect()} == {("accepted", 1400), ("duplicate", 1600)}
    assert ingest.folded_sessions(spark.createDataFrame([], EVENTS)).count() == 0


def test_cooldown_equals_a_loop(spark):
    rng = random.Random(2)
    now, config = datetime(2026, 1, 1, 2), Config()
    findings, existing = [], []
    for k in range(400):
        kind = rng.choice(["brute_force", "post_auth_activity", "malware_staging"])
        ip = f"10.0.0.{rng.randint(1, 9)}"
        key = f"{kind}|{ip}|{rng.randint(0, 12)}"
        findings.append((kind, ip, rng.choice(["low", "medium", "high"]), _stamp(rng.randint(0, 9000)), f"d{k}", None, key, rng.randint(0, 6)))
    for k in range(60):
        ip = f"10.0.0.{rng.randint(1, 30)}"
        key = f"{rng.choice(['brute_force', 'post_auth_activity'])}|{ip}|{rng.randint(0, 15)}"
        existing.append((str(uuid.uuid5(uuid.UUID("c35ac7c6-2707-528e-8e1e-398e87b6b396"), key)), ip, None, key.split("|")[0], "high", _stamp(rng.randint(0, 9000)), "old", rng.choice(["open", "closed"])))
    rank = {"low": 1, "medium": 2, "high": 3}
    order = sorted(sorted(findings, key=lambda f: f[6], reverse=True), key=lambda f: f[7])
    order = sorted(order, key=lambda f: (rank[f[2]], f[3]), reverse=True)
    table, made = list(existing), []
    for kind, ip, level, stamp, text, session, key, _ in order:
        num = str(uuid.uuid5(uuid.UUID("c35ac7c6-2707-528e-8e1e-398e87b6b396"), key))
        fresh = lambda a: now - datetime.strptime(a[5], "%Y-%m-%dT%H:%M:%SZ") < timedelta(minutes=30)
        if kind not in config.no_cooldown and any(a[1] == ip and a[3] == kind and a[7] == "open" and fresh(a) for a in table):
            continue
        if any(a[0] == num for a in table):
            continue
        row = (num, ip, session, kind, level, stamp, text, "open")
        table.append(row)
        made.append(row)
    frame = spark.createDataFrame(findings, "alert_type string, attacker_ip string, severity string, timestamp string, description string, session_id string, dedupe_key string, rule_order int")
    # findings that tie in everything but their text may swap
    found = rules.new_alerts(frame, now.strftime("%Y-%m-%dT%H:%M:%SZ"), spark.createDataFrame(existing, ALERTS)).collect()
    cut = lambda rows: sorted((r[0], r[1], r[3], r[4], r[5]) for r in rows)
    assert cut(found) == cut(made)
    changed = rules.with_statuses(spark.createDataFrame(existing[:2], ALERTS), spark.createDataFrame([(existing[0][0], "closed", 1), (existing[0][0], "acknowledged", 2), ("none", "open", 3)], "alert_id string, status string, seq int"))
    assert {r["alert_id"]: r["status"] for r in changed.collect()}[existing[0][0]] == "acknowledged"


def test_command_patterns_equal_python(spark):
    commands = ["rm -rf /", "rm -fr /tmp", "RM -RF / ", "history -c", "> .bash_history", "dd if=/dev/zero of=x", "wget x", "curl -O x", "curl x | sh", "curl x", "tftp", "busybox  wget", "cat < /dev/tcp/1/2", "nc -e sh", "chmod +x a", "chmod 0777 a", "chmod 644", "echo | base64 -d", "python3 -e x", "x|bash", "crontab -l", "authorized_keys", "passwd", "chattr", "id", "cat /proc/cpuinfo", "cat /etc/shadow", "free -m", "nmap", "apk  install x", "", "ls", "ſystemctl enable", "İD", "line\nwget"]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(commands)], "k int, c string")
    severity, label = scalar.classified(F.col("place"))
    found = {r["k"]: (r["severity"], r["label"]) for r in rows.select("k", scalar.once(scalar.first_pattern(F.col("c"))).alias("place")).select("k", severity.alias("severity"), label.alias("label")).collect()}
    expected = {k: next(((level, name) for p, level, name in scalar.COMMAND_PATTERNS if re.search(p, c, re.IGNORECASE)), (None, None)) for k, c in enumerate(commands)}
    assert found == expected


def test_scalars(spark):
    names = ["", "a", "é日😀", "x" * 200]
    rows = spark.createDataFrame([(x,) for x in names], "x string").select(scalar.uuid5(F.col("x")).alias("u"), scalar.uuid5(F.col("x"), scalar.ID_NAMESPACE).alias("v")).collect()
    assert [r["u"] for r in rows] == [str(uuid.uuid5(uuid.UUID(scalar.ID_NAMESPACE), x)) for x in names]
    ips = {"10.1.2.3": True, "8.8.8.8": False, "203.0.113.9": False, "192.0.2.1": False, "198.51.100.1": False, "127.0.0.1": True, "172.20.0.1": True, "172.32.0.1": False, "169.254.1.1": True, "224.0.0.1": True, "x": True, "": True, "::1": True, "fe80::1": True, "2001:db8::1": False, "2606:4700::1111": False, "1.2.3": True, "256.1.1.1": True}
    found = spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", scalar.is_private(F.col("ip")).alias("p"), scalar.is_private(F.col("ip"), v6=False).alias("q")).collect()
    assert {r["ip"]: r["p"] for r in found} == ips and all(r["q"] == ips[r["ip"]] for r in found if ":" not in r["ip"])
    like = spark.createDataFrame([("Ab\\c",), ("aBxc",), ("É",), (None,)], "x string")
    hits = lambda q: [r[0] for r in like.select(scalar.contains(F.col("x"), q)).collect()]
    assert hits("B\\C") == [True, False, False, None] and hits("b_c") == [True, True, False, None] and hits("é") == [False, False, False, None]
    places = spark.createDataFrame([("Berlin 52.5, 13.4",), ("1/2",), ("95,10",), ("none",)], "t string")
    lat, lon = scalar.coordinates(F.col("t"))
    assert [tuple(r) for r in places.select(lat, lon).collect()] == [(52.5, 13.4), (1.0, 2.0), (None, None), (None, None)]
    bands = spark.createDataFrame([(None,), (10,), (40,), (75,)], "s int").select(scalar.score_band(F.col("s")).alias("b"))
    assert [r["b"] for r in bands.collect()] == ["none", "low", "medium", "high"]


def test_nodes_and_map(spark):
    nodes = spark.createDataFrame([("n1", None, "52.5 13.4", None, "online", "2026-01-01T00:00:00Z"), ("n2", None, "attic", None, "online", None), ("n3", None, None, None, "online", "2026-01-01T00:09:00Z")], NODES)
    assert {r["node_id"]: r["status"] for r in ingest.with_stale_nodes_offline(nodes, "2026-01-01T00:10:00Z").collect()} == {"n1": "offline", "n2": "offline", "n3": "online"}
    placed = {r["node_id"]: (r["latitude"], r["longitude"]) for r in rollups.placed_nodes(nodes, {"n3": (1, 2)}).collect()}
    assert placed == {"n1": (52.5, 13.4), "n2": (None, None), "n3": (1.0, 2.0)}
    paths = spark.createDataFrame([("1.1.1.1", "n1", 4), ("1.1.1.1", "n2", 2)], "attacker_ip string, node_id string, events long")
    origins = spark.createDataFrame([("1.1.1.1", 0.0, 0.0)], "attacker_ip string, latitude double, longitude double")
    arcs = rollups.map_arcs(paths, origins, rollups.placed_nodes(nodes, {})).collect()
    assert [(r["node_id"], r["origin_x"], r["origin_y"]) for r in arcs] == [("n1", 500.0, 233.3)]
    health = rollups.node_health(spark.createDataFrame([("a", "2026-01-01T00:00:00Z", None), ("b", None, "2026-01-01T00:07:00Z"), ("c", None, None), ("d", "2026-01-01T00:09:30Z", None)], "node_id string, last_seen string, last_event string"), "2026-01-01T00:10:00Z")
    assert {r["node_id"]: r["health"] for r in health.collect()} == {"a": "critical", "b": "warning", "c": "unknown", "d": "healthy"}


def test_transcript_gap_and_pages(spark):
    rows = [(k, str(k), "n", "s", "command", t, "1.1.1.1", "ssh", json.dumps({"command": "ls", "password": "" if k == 0 else None}), t) for k, t in enumerate([_stamp(0), "broken", _stamp(30), _stamp(100)])]
    found = search.transcript(spark.createDataFrame(rows, EVENTS), "s").orderBy("event_id").collect()
    assert [r["gap_seconds"] for r in found] == [None, None, None, 70] and [r["had_password"] for r in found] == [1, 0, 0, 0]
    assert search.clamped(0, 5) == (10, 0) and search.clamped(3, 20) == (20, 40) and search.pages(41, 9, 20) == {"page": 3, "pages": 3, "has_prev": True, "has_next": False, "first": 41, "last": 41}


# -- mappers ----------------------------------------------------------------


def _mapped(frame):
    return [(r["event_type"], r["timestamp"], r["session_id"], r["attacker_ip"], r["protocol"], json.loads(r["details"])) for r in frame.collect()]


def test_shell_lines(spark):
    base = {"timestamp": "2026-01-01T00:00:00.5Z", "session": "abc", "src_ip": "1.2.3.4"}
    raw = [
        base | {"eventid": "cowrie.session.connect", "dst_ip": "9.9.9.9", "dst_port": 22, "src_port": 5}, base | {"eventid": "cowrie.login.failed", "username": "root", "password": "x"}, base | {"eventid": "cowrie.command.input", "input": "ls\r\né"},
        base | {"eventid": "cowrie.session.closed", "duration": 1.5}, base | {"eventid": "cowrie.client.version"}, base | {"eventid": "cowrie.session.file_download", "url": "http://x", "shasum": "f", "outfile": None},
    ]
    lines = spark.createDataFrame([(json.dumps(x),) for x in raw], "line string").coalesce(1)
    head = ("2026-01-01T00:00:00.5Z", "abc", "1.2.3.4", "ssh")
    assert _mapped(mappers.shell_events(lines, "node-01")) == [
        ("connection", *head, {"destination_ip": "9.9.9.9", "destination_port": 22, "source_port": 5}), ("login_attempt", *head, {"username": "root", "password": "x"}), ("command", *head, {"command": "ls\r\né"}),
        ("session_end", *head, {"status": "closed", "duration_seconds": 1.5}), ("file_download", *head, {"download_url": "http://x", "file_hash": "f", "file_name": None}),
    ]
    assert [tuple(r) for r in mappers.skipped_shell_events(lines).collect()] == [("cowrie.client.version", 1)]
    ids = [r["event_id"] for r in mappers.with_stable_ids(mappers.shell_events(lines, "node-01")).collect()]
    assert len(set(ids)) == 5 and ids == [r["event_id"] for r in mappers.with_stable_ids(mappers.shell_events(lines, "node-01")).collect()]


def test_service_lines(spark):
    link = {"id": "f" * 64, "protocol": "ftpd", "remote_ip": "1.2.3.4", "remote_port": 5, "local_ip": "9.9.9.9", "local_port": 21}
    incident = lambda origin, stamp, **data: {"origin": origin, "timestamp": stamp, "data": {"connection": link, **data}}
    raw = [
        incident("dionaea.connection.tcp.accept", "2026-01-01T00:00:00.250000"), incident("dionaea.modules.python.ftp.command", "2026-01-01T00:00:01", command="PASS", arguments=["secret"]),
        incident("dionaea.modules.python.ftp.command", "2026-01-01T00:00:02", command="LIST", arguments=["-l", "", "/x"]), incident("dionaea.modules.python.ftp.login", "2026-01-01T00:00:03Z", username="u", password=""),
        incident("dionaea.connection.free", "2026-01-01T00:00:10"), incident("dionaea.modules.python.smb.dcerpc.request", "2026-01-01T00:00:04"), {"origin": "dionaea.connection.tcp.accept", "timestamp": "2026-01-01T00:00:05", "data": {"connection": link | {"protocol": "pcap"}}},
        {"origin": "dionaea.connection.tcp.accept", "timestamp": "2026-01-01T00:00:05", "data": {"connection": link | {"remote_ip": "0.0.0.0"}}}, {"other": 1},
    ]
    lines = spark.createDataFrame([(json.dumps(x),) for x in raw], "line string")
    found = sorted(_mapped(mappers.service_events(lines, "node-02")), key=lambda r: r[1])
    assert [(r[0], r[5]) for r in found] == [
        ("connection", {"destination_ip": "9.9.9.9", "destination_port": 21, "source_port": 5}), ("command", {"command": "PASS ***REDACTED***"}), ("command", {"command": "LIST -l /x"}),
        ("login_attempt", {"username": "u", "password": None}), ("session_end", {"status": "closed", "duration_seconds": 9.75}),
    ]
    assert {r[1:5] for r in found[:1]} == {("2026-01-01T00:00:00.250000Z", f"node-02:{'f' * 16}", "1.2.3.4", "ftp")}
    assert {tuple(r) for r in mappers.skipped_services(lines).collect()} == {("origin", "dionaea.modules.python.smb.dcerpc.request", 1), ("protocol", "pcap", 1)}
    record = {"connection": {"type": "accept", "protocol": "ftpd"}, "timestamp": "2026-01-01T00:00:00", "src_ip": "1.2.3.4", "src_port": 5, "dst_ip": "9.9.9.9", "dst_port": 21}
    listed = record | {"credentials": [{"username": "a", "password": "b"}, {"username": "c", "password": ""}], "ftp": {"commands": [{"command": "USER", "arguments": ["a"]}, {"command": "PASS", "arguments": ["b"]}, {"command": ""}]}}
    flat = record | {"credentials": {"username": ["a", "c"], "password": ["b"]}, "ftp": {"commands": {"command": ["USER", "PASS"], "arguments": [["a"], ["b"]]}}}
    for one in (listed, flat):
        rows = mappers.service_events(spark.createDataFrame([(json.dumps(one),)], "line string"), "node-02").orderBy("index").collect()
        assert [r["event_type"] for r in rows] == ["connection", "login_attempt", "login_attempt", "command", "command", "session_end"]
        assert [json.loads(r["details"]) for r in rows][1:5] == [{"username": "a", "password": "b"}, {"username": "c", "password": None}, {"command": "USER a"}, {"command": "PASS ***REDACTED***"}]
    import hashlib

    assert rows[0]["session_id"] == "node-02:" + hashlib.sha256(b"1.2.3.4|5|9.9.9.9|21|2026-01-01T00:00:00").hexdigest()[:16]
    quiet = record | {"connection": {"type": "listen", "protocol": "ftpd"}}
    assert mappers.service_events(spark.createDataFrame([(json.dumps(quiet),)], "line string"), "node-02").count() == 0


# -- feed -------------------------------------------------------------------


def _feed(spark):
    events = spark.createDataFrame([(k, str(k), f"node-0{k % 2 + 1}", "s", "command", _stamp(k), "1.2.3.4", "ssh", '{"command": "x"}', _stamp(k)) for k in range(4)], EVENTS)
    alerts = spark.createDataFrame([("a1", "1.2.3.4", "s", "brute_force", "high", _stamp(9), 'text, with "quotes"\nand lines', "open"), ("a2", "2001:db8::1", None, "high_risk_ip", "medium", _stamp(8), "t", "acknowledged"), ("a3", "9.9.9.9", None, "x", "low", _stamp(7), "t", "open"), ("a4", "9.9.9.8", None, "x", "high", _stamp(7), "t", "closed")], ALERTS)
    reputation = spark.createDataFrame([("1.2.3.4", "Utopia", "C", 1.0, 2.0, 90, "one,two", 60, _stamp(0))], REPUTATION)
    return feed.indicators(events, alerts, reputation), feed.feed_alerts(alerts, reputation)


def test_feed_sinks(spark, tmp_path):
    flat, alerts = _feed(spark)
    document = json.loads(feed.feed_document(flat, alerts, _stamp(100)).first()["json"])
    assert document["feed"]["counts"] == {"indicators": 2, "alerts": 2} and document["indicators"][0]["confidence"] == 95 and document["indicators"][0]["scores"]["sources"] == ["one", "two"]
    out = feed.write_feed(flat, alerts, str(tmp_path / "feed"), _stamp(100))
    stix = [json.loads(r["value"]) for r in spark.read.text(out["stix"]).collect()]
    bundle = json.loads(feed.bundle_document(flat, _stamp(100)).first()["json"])
    assert bundle["type"] == "bundle" and bundle["id"].startswith("bundle--") and [x["type"] for x in bundle["objects"]] == ["identity", "indicator", "indicator"]
    with pytest.raises(Exception, match="too many"):
        feed.feed_document(flat, alerts, _stamp(100), most=1).collect()
    patterns = {x["pattern"] for x in stix if x["type"] == "indicator"}
    assert patterns == {"[ipv4-addr:value = '1.2.3.4']", "[ipv6-addr:value = '2001:db8::1']"} and sum(x["type"] == "identity" for x in stix) == 1
    csv = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(out["alerts_csv"])
    assert {r["description"] for r in csv.collect()} == {'text, with "quotes"\nand lines', "t"}
    assert spark.read.option("header", True).csv(out["indicators_csv"]).columns[:3] == ["attacker_ip", "first_seen", "last_seen"]
    empty = feed.write_feed(flat.limit(0), alerts.limit(0), str(tmp_path / "none"), _stamp(100))
    assert spark.read.text(empty["indicators_json"]).count() == 0


def test_secrets_never_leak(spark):
    rows = spark.createDataFrame([("u", "hunter2", [("k", "hunter2")], ("hunter2", None))], "username string, Password string, list array<struct<name:string,api_key:string>>, deep struct<secret:string,pwd:string>")
    text = feed.scrubbed(rows).select(F.to_json(F.struct("*")).alias("j")).first()["j"]
    assert "hunter2" not in text and text.count("***MASKED***") == 3
    with pytest.raises(Exception, match="unmasked"):
        rows.select(feed.checked(F.to_json(F.struct("*")))).collect()


# -- composites -------------------------------------------------------------


def test_screens(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    for name in ("events", "reputation", "alerts", "sessions", "nodes"):
        vars(t)[name] = getattr(t, name).cache()
    day, now = "2024-01-30T00:00:00Z", "2024-01-31T00:00:00Z"
    assert screens.since_of(spark, "24h", now) == day and screens.since_of(spark, "all", now) == "" and screens.since_of(spark, "x", now) == day
    for frames in (screens.overview(t, now, day, day), screens.attacker_list(t, {}, "score"), screens.alerts_screen(t, {}), screens.nodes_screen(t, now, day), screens.statistics(t, day, day)):
        assert all(f.count() > 0 for f in frames.values())
    ip = t.events.where("attacker_ip is not null").first()["attacker_ip"]
    profile = screens.attacker_profile(t, ip, "")
    assert profile["summary"].count() == 1 and profile["sessions"].count() > 0
    stranger = t.reputation.join(t.events, "attacker_ip", "left_anti").first()["attacker_ip"]
    assert screens.attacker_profile(t, stranger, "")["summary"].count() == 1 and screens.attacker_profile(t, "0.0.0.0", "")["summary"].count() == 0
    sid = t.sessions.first()["session_id"]
    detail = screens.session_detail(t, sid)
    assert detail["session"].count() == detail["neighbours"].count() == 1 and detail["transcript"].count() > 0
    drawn = screens.map_screen(t, day, {"node-01": (52.5, 13.4)})
    assert drawn["arcs"].count() > 0 and {r["node_id"] for r in drawn["unplaced"].collect()} == {"node-02", "node-03"}
    assert screens.feed_preview(t, now, min_confidence=60)["stix"].count() > 1
    assert screens.health_tallies(t, now, day).count() > 0
    passed = screens.cycle(t, "2024-01-23T00:00:00Z", now, str(tmp_path / "feed"))
    assert passed["alerts"].count() == 0 and passed["summary"].count() > 0
    found = screens.dossier(t, ip, now)
    body = json.loads(found["json"].first()["json"])
    assert body["summary"]["attacker_ip"] == ip and body["sessions"] and not re.search(r'"pw\d"', json.dumps(body))
    assert found["csv"].count() == 1


# -- streaming --------------------------------------------------------------


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    events = [GOOD | {"event_id": str(uuid.uuid5(uuid.NAMESPACE_URL, str(k % 40))), "session_id": f"s{k % 5}"} for k in range(60)]
    for part in range(3):
        (source / f"{part}.json").write_text("\n".join(json.dumps(e) for e in events[part * 20 : part * 20 + 20]) + "\nbroken\n")
    run = lambda: pipeline.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), files=1).awaitTermination()
    run()
    log = pipeline.stored_events(spark, str(tmp_path / "out"))
    assert log.count() == 40 == log.select("event_id").distinct().count()
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 3
    assert ingest.folded_sessions(log).count() == 5
    (source / "3.json").write_text("\n".join(json.dumps(e) for e in events[:20] + [GOOD]))
    run()
    assert pipeline.stored_events(spark, str(tmp_path / "out")).count() == 41
    batch = spark.createDataFrame([(json.dumps(GOOD),)], "value string")
    for _ in range(2):  # a retried batch replaces itself
        pipeline.ingested(batch, 99, str(tmp_path / "out"), F.lit("2026-07-19T15:00:01Z"))
    assert pipeline.stored_events(spark, str(tmp_path / "out")).count() == 41
    reputation = spark.createDataFrame([], REPUTATION)
    first = pipeline.alert_pass(spark, str(tmp_path / "out"), reputation, "2026-07-19T14:00:00Z", "2026-07-19T15:00:10Z", 1).count()
    again = pipeline.alert_pass(spark, str(tmp_path / "out"), reputation, "2026-07-19T14:00:00Z", "2026-07-19T15:00:10Z", 2).count()
    assert (first, again) == (1, 0)


def test_live_rollups(spark, tmp_path):
    rows = [(k, str(k // 2), "node-01", "s1" if k < 10 else "s2", "command", _stamp(k * 60 + (20_000 if k >= 10 else 0)), "1.2.3.4", "ssh", "{}", _stamp(0)) for k in range(20)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = lambda: spark.readStream.schema(EVENTS).parquet(str(tmp_path / "ev"))

    def result(frame, mode):
        query = frame.writeStream.format("memory").queryName("live").outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp{random.random()}")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table("live").collect()

    assert len(result(pipeline.deduplicated(stream()), "append")) == 10
    batch = pipeline.windowed_activity(spark.read.parquet(str(tmp_path / "ev"))).collect()
    assert sorted(map(tuple, result(pipeline.windowed_activity(stream()), "complete"))) == sorted(map(tuple, batch)) and len(batch) == 5
    assert [(r["session_id"], r["n"]) for r in result(pipeline.inactive_sessions(stream()), "append")] == [("s1", 10)]


def test_pause_of_just_the_timeout_ends_a_stretch(spark):
    stamps = {"a": ("00:00:00", "01:00:00"), "b": ("00:00:00", "00:59:59"), "c": ("00:00:00", "01:00:01", "02:00:01")}
    rows = [(k, f"2024-01-01T{x}Z") for k, own in stamps.items() for x in own]
    out = pipeline.inactive_sessions(spark.createDataFrame(rows, "session_id string, timestamp string"))
    assert sorted((r["session_id"], r["n"]) for r in out.collect()) == [("a", 1), ("a", 1), ("b", 2), ("c", 1), ("c", 1), ("c", 1)]


def test_ingest_report_parses_lines_once(spark):
    lines = [json.dumps(GOOD)] * 3 + [json.dumps(GOOD | {"event_id": str(uuid.UUID(int=k))}) for k in (1, 1, 2, 3)] + ["{", "", None]
    rows = spark.createDataFrame([(x, k, "2026-07-19T15:00:09Z") for k, x in enumerate(lines)], "line string, seq long, received_at string")
    history = spark.createDataFrame([(str(uuid.UUID(int=k)),) for k in (2, 2, 9)], "event_id string")
    report = lambda *x: {r["outcome"]: r["n"] for r in ingest.ingest_report(*x).collect()}
    assert report(rows, history) == {"accepted": 3, "duplicate": 4, "rejected": 3}
    assert report(rows) == {"accepted": 4, "duplicate": 3, "rejected": 3}
    assert report(rows.limit(0), history) == {"accepted": 0, "duplicate": 0, "rejected": 0}
    assert ingest.ingest_report(rows, history)._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1
