"""Queries over the telemetry views that go through what is kept: streams with state, stores, partials, indexes; and the contract's edges."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sentryspark.functions.scalar import field, is_usable, seconds
from sentryspark.operators import ingest, mappers, trigrams
from sentryspark.plans import duck
from sentryspark.schema import REPUTATION
from sentryspark.sources import tables
from sentryspark.sources.store import Snapshot
from sentryspark.streaming import batches, state
from sentryspark.streaming.partials import Panes, Rollups
from sentryspark.streaming.session_log import SessionLog, session_folds

SINCE, DAY = "2024-01-23T00:00:00Z", "2024-01-30T00:00:00Z"
#: Times of arrival at which the log is cut into the batches of a stream.
CUTS = ("", "2024-01-15T00:00:00Z", "2024-01-25T00:00:00Z", "9")
NODE = "node-02"


def _head(**changed) -> F.Column:
    """The start of a line of JSON, up to its details."""
    parts = {k: F.col(k) for k in ("event_id", "node_id", "event_type", "timestamp", "session_id", "attacker_ip", "protocol")}
    text = F.to_json(F.struct(*(changed.get(k, v).alias(k) for k, v in parts.items())), {"ignoreNullFields": "false"})
    return F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"details":'))


def _choice(values: list[str]) -> F.Column:
    """One of some texts, by the row's number."""
    return F.element_at(F.array(*(F.lit(x) for x in values)), (F.col("seq") % len(values) + 1).cast("int"))


# -- the contract's edges -----------------------------------------------------

#: Numbers as sensors write them, and as they are stored.
NUMBERS = {"12.0": "12.0", "-0.0": "-0.0", "1e22": "1e+22", "1.5E-7": "1.5e-07", "9" * 45: "9" * 45, "7": "7", "1E400": "Infinity"}
#: Values of a required detail, those that the collector refuses first.
STATUSES = ["7", "false", "[]", '{"a": 1}', '"  "', '"closed"', '"failed"']
#: Spellings around an address, and whether they are usable ones.
SPELLINGS = {"{}": True, "::ffff:{}": True, "1:2:3:4:5:6:{}": True, "1:{}": False, "12345::{}": False, "{}::": False, ":::::": False, "0::0": False, "::0.0.0.0": False, "fe80::1%{}": True, "fe80::1%": False, "1:2:3:4:5:6:7:{}": False}


def _numbers(t) -> DataFrame:
    details = F.concat(F.lit('{"status":"closed","duration_seconds":'), _choice(list(NUMBERS)), F.lit("}"))
    lines = t.events.where("event_type = 'session_end'").select("seq", "received_at", F.concat(_head(), details, F.lit("}")).alias("line"))
    return ingest.normalized(ingest.validated(lines)).select("event_id", "details")


def _types(t) -> DataFrame:
    session = F.when(F.col("seq") % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("session_id"))
    lines = t.events.where("event_type = 'session_end'").select(F.concat(F.regexp_replace(_head(session_id=session, attacker_ip=tables.sendable(F.col("attacker_ip"))), '"session_id":null', '"session_id":5'), F.lit('{"status":'), _choice(STATUSES), F.lit("}}")).alias("line"))
    return ingest.problem_counts(ingest.validated(lines, profile="collector"))


def _addresses(t) -> DataFrame:
    spelt = F.array(*(F.struct(F.lit(x).alias("spelling"), F.concat(F.lit(x.partition("{}")[0]), tables.sendable(F.col("attacker_ip")) if "{}" in x else F.lit(""), F.lit(x.partition("{}")[2])).alias("ip")) for x in SPELLINGS))
    rows = t.events.where("attacker_ip is not null").select(F.explode(spelt).alias("x")).select("x.*")
    return rows.groupBy("spelling").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_usable(F.col("ip"))).alias("usable"))


# -- batches and streams -----------------------------------------------------

KEYS = {f"node-0{k}": hashlib.sha256(f"key-0{k}".encode()).hexdigest() for k in (1, 2, 3)}


def _sent(t) -> DataFrame:
    """Batches as in batch_rejections, packed, some with a wrong key or without events."""
    part = F.floor(F.col("seq") / F.when(F.floor(F.col("seq") / 360) % 2 == 0, 45).otherwise(90))
    foreign = F.floor(F.col("seq") / 45) % 14 == 3
    rows = t.events.select(F.concat_ws("_", "node_id", part.cast("string")).alias("name"), "node_id", part.alias("part"), F.when(foreign, "node-01").otherwise(F.col("node_id")).alias("sender"), F.struct(*(F.col(c) for c in ("event_id", "node_id"))).alias("event"))
    each = rows.groupBy("name").agg(F.max("part").alias("part"), F.min("sender").alias("node_id"), F.collect_list("event").alias("events"))  # 30 events at most
    key = F.when(F.col("part") % 5 == 4, "wrong").otherwise(F.concat(F.lit("key-"), F.substring("node_id", 6, 2)))
    body = F.to_json(F.struct("node_id", key.alias("node_key"), F.when(F.col("part") % 7 != 6, F.col("events")).alias("events")))
    landing, out, checkpoint = (tables.new_folder(t.spark, x) for x in ("landing", "judged", "stream"))
    each.select(F.concat("name", F.lit("\t"), body).alias("value")).write.text(landing)
    step = lambda rows, number: batches.judged(rows, KEYS).drop("events").write.mode("overwrite").parquet(f"{out}/batch={number}")
    batches.landed_packed(t.spark, landing, 1000).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select(F.col("file").alias("name"), "sender", "status")


def _played(t, rows: DataFrame, order: str, build: Callable[[DataFrame], DataFrame], mode: str, step: Callable[[DataFrame, int], None]) -> None:
    """A stream over rows, which land in three parts by `order`, in files of any number; each part is a micro-batch, as it lands when the one before is done."""
    landing, checkpoint = (tables.new_folder(t.spark, x) for x in ("landing", "stream"))
    own = state.prepared(t.spark.newSession())
    for a, b in zip(CUTS[:-1], CUTS[1:], strict=True):
        rows.where((F.col(order) >= a) & (F.col(order) < b)).write.mode("append").parquet(landing)
        build(own.readStream.schema(rows.schema).parquet(landing)).writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _nodes(t) -> DataFrame:
    """The latest change of each sensor, of a stream over the log."""
    out = tables.new_folder(t.spark, "changes")
    step = lambda frame, number: frame.write.mode("overwrite").parquet(f"{out}/batch={number}")
    _played(t, tables.stored(t.events, "log"), "received_at", lambda x: state.node_changes(x, _arrived()), "update", step)
    return t.spark.read.parquet(out).groupBy("node_id").agg(F.max_by(F.struct("last_seen", "status"), F.struct("batch", F.col("change") == "time")).alias("last")).select("node_id", "last.*")


def _sessions(t) -> DataFrame:
    log = SessionLog(t.spark, tables.new_folder(t.spark, "sessions"))
    _played(t, tables.stored(t.events, "log"), "received_at", lambda x: session_folds(x, seconds(F.col("received_at"))), "update", log.add)
    return log.rows()


def _arrived() -> F.Column:
    return F.to_timestamp("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _incidents(t) -> DataFrame:
    """Accepts and ends of connections as a service sensor reports them, one line each."""
    origin = F.when(F.col("event_type") == "connection", mappers.ACCEPT_ORIGINS[0]).otherwise(mappers.END_ORIGIN)
    link = F.struct(F.sha2("session_id", 256).alias("id"), F.lit("ftpd").alias("protocol"), tables.sendable(F.col("attacker_ip")).alias("remote_ip"), F.lit("5").alias("remote_port"), F.lit("198.51.100.1").alias("local_ip"), F.lit("21").alias("local_port"))
    rows = t.events.where("event_type in ('connection', 'session_end')")
    return rows.select("timestamp", F.to_json(F.struct(origin.alias("origin"), F.regexp_replace("timestamp", "Z", ".250000").alias("timestamp"), F.struct(link.alias("connection")).alias("data"))).alias("line"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("event_type", "timestamp", "session_id", tables.as_viewed(F.col("attacker_ip")).alias("attacker_ip"), field("duration_seconds").cast("double").alias("duration"))


def _service_batch(t) -> DataFrame:
    rows = mappers.service_events(_incidents(t).select("line"), NODE)
    return _shown(rows)


def _service_stream(t) -> DataFrame:
    landing, out, checkpoint = (tables.new_folder(t.spark, x) for x in ("landing", "timed", "stream"))
    rows = tables.stored(_incidents(t), "incidents")
    for a, b in zip(CUTS[:-1], CUTS[1:], strict=True):
        rows.where((F.col("timestamp") >= a) & (F.col("timestamp") < b)).select("line").coalesce(1).write.mode("append").parquet(landing)
    own = state.prepared(t.spark.newSession())
    stream = own.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(landing)
    step = lambda frame, number: frame.write.mode("overwrite").parquet(f"{out}/batch={number}")
    state.service_stream(stream, NODE).writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _shown(t.spark.read.parquet(out))


# -- stores and partials -------------------------------------------------------


def _thirds(t):
    """The log in three batches by arrival, stored by batch: reading one opens its files only. What else t derives from its events reads these files from then on."""
    at, path = F.col("received_at"), tables.new_folder(t.spark, "log")
    third = F.when((at >= CUTS[0]) & (at < CUTS[-1]), sum(((at >= x).cast("int") for x in CUTS[1:-1]), F.lit(0)))
    tables.demo_events(t.spark, t.sf_dir, spread=True).withColumn("third", third).write.partitionBy("third").parquet(path)
    rows = t.spark.read.schema(StructType([*t.events.schema, StructField("third", IntegerType())])).parquet(path)
    t.events = rows.drop("third")
    return [rows.where(F.col("third") == k).drop("third") for k in range(len(CUTS) - 1)]


def _kept(t) -> Rollups:
    kept = Rollups(t.spark, tables.new_folder(t.spark, "rollups"), fan_in=2)
    for number, rows in enumerate(_thirds(t)):
        kept.add(rows, number)
    return kept


def _panes(t) -> DataFrame:
    panes = Panes(t.spark, tables.new_folder(t.spark, "panes"), width=86_400, fan_in=2)
    for number, rows in enumerate(_thirds(t)):
        panes.add(rows, number)
    return panes.evaluated(t.reputation, SINCE)


def _upserted(t) -> DataFrame:
    """The reputation table, and then new lookups of a part of it and of unknown addresses, in a snapshot by buckets."""
    snapshot = Snapshot(t.spark, tables.new_folder(t.spark, "reputation"), REPUTATION, "attacker_ip", 16)
    snapshot.upsert(t.reputation, 0, ingest.merged_reputation)
    known = t.reputation.where("profile_score >= 50").select("attacker_ip")
    ips = known.unionByName(known.select(F.concat(F.lit("new-"), "attacker_ip").alias("attacker_ip")))
    new = ips.select("attacker_ip", *(F.lit(v).cast(k).alias(c) for c, v, k in (("country", None, "string"), ("city", "moved", "string"), ("latitude", None, "double"), ("longitude", 1.5, "double"), ("abuse_score", 7, "int"), ("source", "ip-api, other", "string"), ("profile_score", None, "int"), ("last_updated", DAY, "string"))))
    snapshot.upsert(new, 1, ingest.merged_reputation)
    return snapshot.rows()


def _indexed(t) -> DataFrame:
    path = tables.new_folder(t.spark, "commands")
    rows = t.events.where("event_type = 'command'").select("event_id", "timestamp", field("command").alias("command"))
    trigrams.build(rows, ["command"], path, ["timestamp", "event_id"])
    return trigrams.search(t.spark, path, ["command"], "SSWD")


def register(add, lines, valid: str, inputs: str) -> None:
    """Add this module's queries; lines and valid are the catalogue's damaged lines and the SQL for the valid ones, inputs that for profile inputs."""
    token = "CASE seq % {} " + "{} END"
    number = token.format(len(NUMBERS), " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(NUMBERS.values())))
    add("normalized_numbers", _numbers, f"""SELECT event_id, concat(chr(123), '"duration_seconds": ', {number}, ', "status": "closed"', chr(125)) AS details FROM ev WHERE event_type = 'session_end'""")
    add("validate_types", _types, """
        SELECT problem, count(*) AS n FROM (SELECT unnest([CASE WHEN seq % 4 = 1 THEN 'session_id must be a string' END, CASE WHEN seq % 7 < 5 THEN concat('details.status is required and must be non-null for ', chr(39), 'session_end', chr(39)) END]) AS problem
          FROM ev WHERE event_type = 'session_end') WHERE problem IS NOT NULL GROUP BY 1""")
    add("usable_addresses", _addresses, "SELECT spelling, count(*) AS n, count(*) FILTER (WHERE good) AS usable FROM ev, (VALUES " + ", ".join(f"(replace('{k}', '()', chr(123) || chr(125)), {v})".replace("{}", "()") for k, v in SPELLINGS.items()) + ") s(spelling, good) WHERE attacker_ip IS NOT NULL GROUP BY 1")
    add("landed_batches", _sent, """
        SELECT name, sender, CASE WHEN part % 7 = 6 THEN 422 WHEN part % 5 = 4 THEN 401 WHEN n > 20 THEN 422 WHEN alien THEN 403 ELSE 200 END::INT AS status FROM (
          SELECT node_id || '_' || (seq // CASE WHEN (seq // 360) % 2 = 0 THEN 45 ELSE 90 END) AS name, max(seq // CASE WHEN (seq // 360) % 2 = 0 THEN 45 ELSE 90 END) AS part, count(*) AS n,
            min(CASE WHEN (seq // 45) % 14 = 3 THEN 'node-01' ELSE node_id END) AS sender, bool_or(node_id <> 'node-01') AND min(CASE WHEN (seq // 45) % 14 = 3 THEN 'node-01' ELSE node_id END) = 'node-01' AS alien FROM ev GROUP BY 1)""")
    last, own_last = (duck.secs(f"(SELECT max(received_at) FROM ev{x})") for x in ("", " WHERE session_id IS NOT NULL"))
    add("stream_sessions", _sessions, f"""
        SELECT session_id, node_id, attacker_ip, protocol, username, password, start_time, CASE WHEN stale THEN coalesce(end_time, start_time) ELSE end_time END AS end_time, CASE WHEN stale THEN 'failed' ELSE status END AS status
        FROM (SELECT s.*, coalesce(status = 'active' AND {own_last} - {duck.secs("coalesce(l.last, start_time)")} > 3600, false) AS stale FROM sessions s LEFT JOIN (SELECT session_id, max(timestamp) AS last FROM ev GROUP BY 1) l USING (session_id)) s""")
    add("stream_nodes", _nodes, f"SELECT node_id, max(timestamp) AS last_seen, CASE WHEN {last} - {duck.secs('max(timestamp)')} > 180 THEN 'offline' ELSE 'online' END AS status FROM ev GROUP BY 1")
    timed = f"""
        SELECT event_type, replace(timestamp, 'Z', '.250000Z') AS timestamp, '{NODE}:' || substr(sha256(session_id), 1, 16) AS session_id, attacker_ip, CASE WHEN event_type = 'session_end' THEN
          ({duck.secs('timestamp')} - {duck.secs("max(CASE WHEN event_type = 'connection' THEN timestamp END) OVER (PARTITION BY session_id ORDER BY timestamp, event_type <> 'connection' ROWS UNBOUNDED PRECEDING)")})::DOUBLE END AS duration
        FROM ev WHERE event_type IN ('connection', 'session_end')"""
    add("map_service_incidents", _service_batch, timed)
    add("stream_service_incidents", _service_stream, timed)
    add("kept_attacker_summary", lambda t: _kept(t).attacker_summary(), "SELECT * FROM summary")
    add("kept_node_statistics", lambda t: _kept(t).node_statistics(t.nodes, t.alerts, DAY).withColumn("avg_lag_seconds", F.round("avg_lag_seconds", 6)), "SELECT * REPLACE (round(avg_lag_seconds, 6) AS avg_lag_seconds) FROM stats")
    add("panes_findings", _panes, f"SELECT {duck.FINDING}, rule_order FROM findings")
    add("reputation_upserted", _upserted, f"""
        SELECT attacker_ip, country, CASE WHEN profile_score >= 50 THEN 'moved' ELSE city END AS city, latitude, CASE WHEN profile_score >= 50 THEN 1.5 ELSE longitude END AS longitude, CASE WHEN profile_score >= 50 THEN 7 ELSE abuse_score END AS abuse_score,
          CASE WHEN profile_score >= 50 THEN 'ip-api,AbuseIPDB,other' ELSE source END AS source, profile_score, CASE WHEN profile_score >= 50 THEN '{DAY}' ELSE last_updated END AS last_updated FROM rep
        UNION ALL SELECT 'new-' || attacker_ip, NULL, 'moved', NULL, 1.5, 7, 'ip-api, other', 0, '{DAY}' FROM rep WHERE profile_score >= 50""")
    add("search_commands_indexed", _indexed, f"SELECT event_id, timestamp, {duck.field('command')} AS command FROM ev WHERE event_type = 'command' AND lower({duck.field('command')}) LIKE '%sswd%'")
    add("profile_inputs_known", lambda t: ingest.profile_inputs_of(t.events, t.reputation), f"SELECT attacker_ip, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('event_count', 'session_count', 'node_count', 'distinct_commands', 'distinct_usernames'))} FROM rep LEFT JOIN ({inputs}) USING (attacker_ip)")
    add("ingest_report", lambda t: ingest.ingest_report(lines(t), t.events.where("seq % 5 = 0")), f"SELECT outcome, n FROM (SELECT 'rejected' AS outcome, (SELECT count(*) FROM ev) - (SELECT count(*) FROM ({valid})) AS n UNION ALL SELECT 'duplicate', (SELECT count(*) FROM ({valid}) WHERE seq % 5 = 0) UNION ALL SELECT 'accepted', (SELECT count(*) FROM ({valid}) WHERE seq % 5 <> 0))")
    add("validation_report", lambda t: ingest.validation_report(lines(t)), f"SELECT count(*) AS lines, (SELECT count(*) FROM ({valid})) AS conforming, count(*) - (SELECT count(*) FROM ({valid})) AS not_conforming FROM ev")
