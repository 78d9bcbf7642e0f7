"""The event contract: numbers and repeated keys in JSON, types of values, addresses, ids of lines."""

import ipaddress
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from sentryspark.functions import jsontext, scalar
from sentryspark.operators import ingest, mappers
from tests.test_engine import GOOD

RAW = [
    '{"b": 12.0, "a": -0.0, "c": 1e22, "d": 1.5e-07, "e": 123456789012345678901234567890123456789012}', '{"a": 1E400, "b": -1e400, "c": NaN, "d": 0.1, "e": 1e16, "f": 123456789.125, "g": -0, "h": 5e-324}', '{"k": 1, "k": {"z": [1.0, 2], "y": null}, "k": {"b": 2.50, "a": "é\\u00e9\\u0001\\/"}}',
    '[{"b": 1, "a": [{"d": true, "c": false}]}]', '"text"', "7.10", " {} ", '{"a": "\\ud83d\\ude00"}',
]
BROKEN = ["", "no", "{", '{"a": 1,}', "{'a': 1}", None, "[" * 100_000]


def test_canonical_json_is_pythons(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(RAW + BROKEN)], "k int, x string")
    found = {r["k"]: (r["s"], r["c"]) for r in rows.select("k", jsontext.canonical(F.col("x")).alias("s"), jsontext.canonical(F.col("x"), compact=True).alias("c")).collect()}
    for k, x in enumerate(RAW):
        assert found[k] == (json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True), json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")))
    assert all(found[k] == (None, None) for k in range(len(RAW), len(RAW) + len(BROKEN)))
    lone = spark.createDataFrame([('{"a": "x\\ud800"}',)], "x string").select(jsontext.canonical(F.col("x"))).first()[0]
    assert lone == '{"a": "x\\ud800"}'


def test_stored_details_keep_numbers(spark):
    end = {"event_type": "session_end", "details": "@"}
    values = ["12.0", "-0.0", "1e22", "1.5e-07", "9" * 45, "3"]
    lines = [(k, json.dumps(GOOD | end).replace('"@"', f'{{"status": "closed", "duration_seconds": {v}}}'), "now") for k, v in enumerate(values)]
    rows = ingest.normalized(ingest.validated(spark.createDataFrame(lines, "seq int, line string, received_at string"))).collect()
    assert {r["seq"]: r["details"] for r in rows} == {k: json.dumps({"duration_seconds": json.loads(v), "status": "closed"}) for k, v in enumerate(values)}


def test_ids_follow_from_canonical_json(spark):
    raw = [{"eventid": "cowrie.command.input", "session": "s", "src_ip": "1.2.3.4", "timestamp": "2026-01-01T00:00:00Z", "input": "é 1", "n": 1.50}, {"eventid": "cowrie.session.connect", "session": "s", "src_ip": "1.2.3.4", "timestamp": "t", "z": {"b": 1, "a": 2}}]
    layouts = [json.dumps(x, ensure_ascii=False, indent=k, sort_keys=bool(k)) for x in raw for k in (None, 1)]
    rows = mappers.with_stable_ids(mappers.shell_events(spark.createDataFrame([(x.replace("\n", " "),) for x in layouts], "line string"), "node-01")).collect()
    expected = [str(uuid.uuid5(uuid.NAMESPACE_URL, f"sentryspark-backfill://node-01/0/{json.dumps(x, sort_keys=True, separators=(',', ':'))}")) for x in raw]
    assert sorted(r["event_id"] for r in rows) == sorted(expected * 2)


def errors(spark, events, profile):
    lines = spark.createDataFrame([(k, e if isinstance(e, str) else json.dumps(e)) for k, e in enumerate(events)], "k int, line string")
    return [r["errors"] for r in ingest.validated(lines, profile=profile).orderBy("k").collect()]


END = GOOD | {"event_type": "session_end"}


@pytest.mark.parametrize("status", [7, 0, False, True, [], ["x"], {"a": 1}, None, "", "  ", " "])
def test_required_details_are_strings(spark, status):
    reason = ["details.status is required and must be non-null for 'session_end'"]
    found = {p: errors(spark, [END | {"details": {"status": status}}], p)[0] for p in ("storage", "collector", "sensor")}
    assert found["collector"] == found["sensor"] == reason  # strings with more than white space only
    assert found["storage"] == (reason if status in (None, "") and status is not False and status != 0 else [])


def test_types_of_fields(spark):
    cases = [
        (GOOD | {"session_id": 5}, ["session_id must be a string"], []), (GOOD | {"session_id": []}, ["session_id must be non-null for 'login_attempt' events", "session_id must be a string"], []),
        (GOOD | {"protocol": 1}, ["protocol must be a string", "protocol '1' is not an allowed one"], ["protocol '1' is not an allowed one"]), (GOOD | {"node_id": 0}, ["node_id must be non-null"], ["node_id must be non-null"]),
        (GOOD | {"node_id": ["node-01"]}, ["node_id '['node-01']' is not a registered node"], ["node_id '['node-01']' is not a registered node"]), (GOOD | {"timestamp": 5}, ["timestamp must be ISO 8601 UTC, e.g. 2026-07-19T15:00:00Z"], ["timestamp must be ISO 8601 UTC, e.g. 2026-07-19T15:00:00Z"]),
        (GOOD | {"event_type": 5}, ["event_type '5' is not an allowed type"], ["event_type '5' is not an allowed type"]), (GOOD | {"attacker_ip": "0.0.0.0"}, [], []), (GOOD | {"attacker_ip": "12345::1"}, ["attacker_ip must be an address"], []),
        (GOOD | {"event_id": "{urn:uuid:7b0c2a9e35cf4a0f9a442f6f7a3c1d10}"}, [], []), (GOOD | {"event_type": "file_download", "details": {"download_url": 0, "file_hash": []}}, ["'file_download' requires at least one of: download_url, file_hash"], []),
    ]
    assert errors(spark, [e for e, _, _ in cases], "collector") == [c for _, c, _ in cases]
    assert errors(spark, [e for e, _, _ in cases], "storage") == [s for _, _, s in cases]


def test_repeated_keys_have_their_last_value(spark):
    line = json.dumps(END).replace(json.dumps(END["details"]), '{"status": 7, "status": "closed"}')
    twice = line.replace('"node_id": "node-01"', '"node_id": "nowhere", "node_id": "node-01"')
    assert errors(spark, [line, twice], "collector") == [[], []]


def test_addresses_are_pythons(spark):
    rng = random.Random(3)
    known = ["1:2", ":::::", "12345::1", "0::0", "::0", "::", "0:0:0:0:0:0:0:0", "::0.0.0.0", "::1.2.3.4", "1::1.2.3.4.5", "1:2:3:4:5:6:7::", "1::2:3:4:5:6:7:8", "::1:2:3:4:5:6:7", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "::%1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "01.2.3.4", "1.2.3.4", "0.0.0.0", "256.1.1.1", "", "x", "::ffff:1.2.3.04", "%", "1.2.3.4%a", "٣.1.1.1", "1.2.3.4\n"]
    pieces = ["", "0", "1", "ffff", "12345", "g", "1.2.3.4", "::", ":", "%", "%e", "abcd", "00"]
    made = ["".join(rng.choices(pieces, k=rng.randrange(1, 9))) if k % 2 else ":".join(rng.choices(["", "", "0", "1", "fF", "abcd"], k=rng.randrange(2, 10))) for k in range(10_000)]

    def python(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return False, False
        return True, not ip.is_unspecified

    rows = spark.createDataFrame([(x,) for x in known + made], "ip string").select("ip", scalar.is_address(F.col("ip")).alias("a"), scalar.is_usable(F.col("ip")).alias("u")).collect()
    wrong = [(r["ip"], r["a"], r["u"]) for r in rows if (r["a"], r["u"]) != python(r["ip"])]
    assert not wrong and 100 < sum(r["a"] for r in rows)
    assert [scalar.is_private(F.lit(x)) is not None for x in ("192.0.0.9",)] and [r[0] for r in spark.createDataFrame([("192.0.0.8",), ("192.0.0.9",), ("192.0.0.10",)], "ip string").select(scalar.is_private(F.col("ip"))).collect()] == [True, False, False]
