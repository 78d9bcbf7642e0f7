"""The catalogue of queries over the telemetry views, each with the same result in DuckDB SQL where SQL can give it.

Times are fixed: the views end on 2024-01-30, so the window starts a week before that and `now` is the day after.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.config import DEFAULT, ID_NAMESPACE, Config
from sentryspark.functions.scalar import COMMAND_PATTERNS, field, percent, profile_score, projected, score_band, stamp_of
from sentryspark.operators import feed, ingest, mappers, rollups, rules, search
from sentryspark.plans import duck, edges, live, screens
from sentryspark.sources import tables
from sentryspark.streaming import pipeline

SINCE, NOW, DAY, HOUR = "2024-01-23T00:00:00Z", "2024-01-31T00:00:00Z", "2024-01-30T00:00:00Z", "2024-01-30T23:00:00Z"
#: The address and sensor that queries about one of them ask for.
IP, NODE = "203.0.113.7", "node-02"


class Tables:
    """The five tables over the views of one folder, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return tables.demo_events(self.spark, self.sf_dir)

    @cached_property
    def reputation(self) -> DataFrame:
        return tables.demo_reputation(self.spark, self.sf_dir)

    @cached_property
    def findings(self) -> DataFrame:
        return rules.evaluated(self.events, self.reputation, SINCE)

    @cached_property
    def alerts(self) -> DataFrame:
        """A pass's new alerts, stored, as a system's are; a few are acknowledged or closed, by their ids."""
        last = F.substring("alert_id", 36, 1)
        fresh = rules.new_alerts(self.pass_findings, NOW).withColumn("status", F.when(last == "0", "acknowledged").when(last == "1", "closed").otherwise("open"))
        return tables.stored(fresh, "alerts")

    @cached_property
    def pass_findings(self) -> DataFrame:
        """The findings, stored, as a pass over earlier alerts reads them several times."""
        return tables.stored(self.findings, "findings")

    @cached_property
    def created(self) -> DataFrame:
        """The new alerts of a pass that knows a third of its findings already, some of them as open alerts, and has a long cooldown."""
        last, old = F.substring("alert_id", 36, 1), rules.with_ids(self.pass_findings)
        existing = old.where(last.isin("2", "3", "4", "5")).withColumn("status", F.when(last.isin("2", "3"), "open").otherwise("closed"))
        return rules.new_alerts(self.pass_findings, NOW, existing, Config(cooldown_minutes=duck.COOLDOWN_MINUTES))

    @cached_property
    def sessions(self) -> DataFrame:
        return ingest.folded_sessions(self.events)

    @cached_property
    def nodes(self) -> DataFrame:
        return ingest.with_stale_nodes_offline(ingest.touched_nodes(self.events), NOW)


Build = Callable[[Tables], DataFrame]
BUILDS: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Build, sql: str | None = None) -> None:
    BUILDS[name] = build
    if sql is not None:
        ORACLES[name] = duck.query(sql)


def _text(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with arrays joined to strings."""
    return rows.withColumns({c: F.array_join(c, ",") for c in columns})


# -- rules and alerts -------------------------------------------------------

for _name in rules.RULES:
    add(f"rule_{_name}", lambda t, name=_name: rules.RULES[name](t.events, t.reputation, SINCE, rules.DEFAULT), f"SELECT {duck.FINDING} FROM findings WHERE alert_type = '{_name}'")
add("alerts_union", lambda t: t.findings, f"SELECT {duck.FINDING}, rule_order FROM findings")
add("alerts_with_ids", lambda t: rules.with_ids(t.findings).select("alert_id", "dedupe_key"), "SELECT alert_id, dedupe_key FROM identified")
add("alerts_after_cooldown", lambda t: t.created, "SELECT * FROM created")
add("alert_pass_summary", lambda t: rules.pass_summary(t.pass_findings, t.created), "SELECT f.alert_type, f.n AS findings, coalesce(a.n, 0) AS created, f.n - coalesce(a.n, 0) AS suppressed FROM (SELECT alert_type, count(*) n FROM findings GROUP BY 1) f LEFT JOIN (SELECT alert_type, count(*) n FROM created GROUP BY 1) a USING (alert_type)")


def _changed(t: Tables) -> DataFrame:
    """Alerts after changes of status, some of them two for one alert, and one for an unknown id."""
    last, ids = F.substring("alert_id", 36, 1), tables.stored(t.alerts, "alerts")
    change = lambda rows, status, seq: rows.select("alert_id", F.lit(status).alias("status"), F.lit(seq).alias("seq"))
    changes = change(ids.where(last.isin("6", "7")), "closed", 2).unionByName(change(ids.where(last.isin("7", "8")), "acknowledged", 3)).unionByName(change(ids.where(last == "6"), "open", 1))
    return rules.with_statuses(ids, changes.unionByName(t.spark.createDataFrame([("none", "closed", 9)], changes.schema)))


add("alert_status_changes", _changed, "SELECT * REPLACE (CASE substr(alert_id, 36, 1) WHEN '6' THEN 'closed' WHEN '7' THEN 'acknowledged' WHEN '8' THEN 'acknowledged' ELSE status END AS status) FROM alerts")
add("window_start", lambda t: t.spark.range(1).select(F.lit(rules.window_start(t.events)).alias("since")), "SELECT strftime(max(strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ')) - INTERVAL 5 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS since FROM ev")

# -- views, folds, nodes ----------------------------------------------------

add("events_view", lambda t: t.events, "SELECT * FROM ev")
add("reputation_view", lambda t: t.reputation, "SELECT * FROM rep")
add("commands_view", lambda t: rollups.commands(t.events), "SELECT event_id, node_id, session_id, attacker_ip, timestamp, json_extract_string(details, '$.command') AS command FROM ev WHERE event_type = 'command'")
add("attacker_summary", lambda t: rollups.attacker_summary(t.events), "SELECT * FROM summary")
add("sessions_folded", lambda t: t.sessions, "SELECT * FROM sessions")
add("sessions_public", lambda t: rollups.public_sessions(t.sessions), "SELECT * REPLACE (CASE WHEN coalesce(password, '') <> '' THEN '***MASKED***' END AS password) FROM sessions")
add("stale_session_close", lambda t: ingest.closed_stale_sessions(t.sessions, t.events, "2024-01-30T12:00:00Z"), f"""
    SELECT s.session_id, node_id, attacker_ip, protocol, username, password, start_time, CASE WHEN stale THEN coalesce(end_time, start_time) ELSE end_time END AS end_time, CASE WHEN stale THEN 'failed' ELSE status END AS status
    FROM (SELECT s.*, coalesce(status = 'active' AND {duck.secs("'2024-01-30T12:00:00Z'")} - {duck.secs("coalesce(l.last, start_time)")} > 3600, false) AS stale FROM sessions s LEFT JOIN (SELECT session_id, max(timestamp) AS last FROM ev GROUP BY 1) l USING (session_id)) s""")
add("node_status", lambda t: t.nodes, "SELECT * FROM nodes")
add("node_statistics", lambda t: rollups.node_statistics(t.nodes, t.events, t.alerts, DAY).withColumn("avg_lag_seconds", F.round("avg_lag_seconds", 6)), "SELECT * REPLACE (round(avg_lag_seconds, 6) AS avg_lag_seconds) FROM stats")
add("node_health", lambda t: rollups.node_health(rollups.node_statistics(t.nodes, t.events, t.alerts, DAY), NOW), f"""
    SELECT node_id, reference, missed, CASE WHEN reference IS NULL THEN 'unknown' WHEN missed >= 5 THEN 'critical' WHEN missed >= 2 THEN 'warning' ELSE 'healthy' END AS health
    FROM (SELECT node_id, greatest(last_seen, last_event) AS reference, ({duck.secs(f"'{NOW}'")} - {duck.secs("greatest(last_seen, last_event)")}) // 60 AS missed FROM stats)""")
add("ingest_outcomes", lambda t: ingest.outcomes(t.events.unionByName(t.events.where("seq % 7 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)), t.events.where("seq % 5 = 0")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), """
    SELECT CASE WHEN rn = 1 AND seq % 5 <> 0 THEN 'accepted' ELSE 'duplicate' END AS outcome, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS rn FROM (SELECT seq, event_id, seq AS arrival FROM ev UNION ALL SELECT seq, event_id, seq + 1000000000 FROM ev WHERE seq % 7 = 0)) GROUP BY 1""")
add("node_upsert", lambda t: ingest.upserted(t.nodes.withColumn("location", F.lit("lab")), t.nodes.where("node_id <> 'node-03'").select("node_id", F.when(F.col("node_id") == "node-01", "52.5, 13.4").alias("location")), "node_id"), "SELECT *, CASE WHEN node_id = 'node-01' THEN '52.5, 13.4' ELSE 'lab' END AS location FROM nodes")

# -- series and counts ------------------------------------------------------

_BUCKETS = "count(*) AS total, count(*) FILTER (WHERE event_type <> 'heartbeat') AS attacks, count(*) FILTER (WHERE event_type = 'login_attempt') AS logins, count(*) FILTER (WHERE event_type = 'command') AS commands, count(DISTINCT attacker_ip) AS ips FROM ev WHERE timestamp >= "
_HOURLY = f"SELECT substr(timestamp, 1, 13) AS bucket, {_BUCKETS}'{SINCE}' GROUP BY 1"
add("activity_hourly", lambda t: rollups.activity(t.events, SINCE), _HOURLY)
add("activity_daily", lambda t: rollups.activity(t.events, SINCE, "day"), _HOURLY.replace("1, 13", "1, 10"))
add("activity_gapfilled", lambda t: rollups.filled(rollups.activity(t.events, SINCE), SINCE, NOW), f"""
    SELECT bucket, coalesce(total, 0) AS total, coalesce(attacks, 0) AS attacks, coalesce(logins, 0) AS logins, coalesce(commands, 0) AS commands, coalesce(ips, 0) AS ips
    FROM (SELECT strftime(unnest(generate_series(TIMESTAMP '2024-01-23', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)), '%Y-%m-%dT%H') AS bucket) LEFT JOIN ({_HOURLY}) USING (bucket)""")
add("node_activity", lambda t: rollups.hourly_of_node(t.events, NODE, SINCE), f"SELECT substr(timestamp, 1, 13) AS bucket, count(*) AS n FROM ev WHERE node_id = '{NODE}' AND timestamp >= '{SINCE}' GROUP BY 1")
add("event_type_counts", lambda t: rollups.counts_of(t.events, "event_type", SINCE), f"SELECT event_type, count(*) AS n FROM ev WHERE timestamp >= '{SINCE}' GROUP BY 1")
add("severity_counts", lambda t: rollups.severity_counts(t.alerts, "open"), "SELECT severity, (SELECT count(*) FROM alerts a WHERE a.severity = v.severity AND a.status = 'open') AS n FROM (VALUES ('low'), ('medium'), ('high')) v(severity)")
add("status_counts", lambda t: rollups.status_counts(t.alerts), "SELECT status, (SELECT count(*) FROM alerts a WHERE a.status = v.status) AS n FROM (VALUES ('open'), ('acknowledged'), ('closed')) v(status)")
add("alert_type_stats", lambda t: rollups.alert_type_stats(t.alerts, SINCE), f"SELECT alert_type, count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open_count, count(*) FILTER (WHERE severity = 'high') AS high_count, count(DISTINCT attacker_ip) AS distinct_ips, max(timestamp) AS last_fired FROM alerts WHERE timestamp >= '{SINCE}' GROUP BY 1")
add("event_type_shares", lambda t: rollups.counts_of(t.events, "event_type").crossJoin(F.broadcast(t.events.agg(F.count(F.lit(1)).alias("whole")))).select("event_type", percent(F.col("n"), F.col("whole")).alias("share")), "SELECT event_type, round(count(*) * 100.0 / (SELECT count(*) FROM ev), 1)::DOUBLE AS share FROM ev GROUP BY 1")
add("activity_sliding", lambda t: pipeline.windowed_activity(t.events, "1 hour", "30 minutes").withColumn("start", stamp_of(F.unix_timestamp("start"))), f"""
    SELECT strftime(make_timestamp(({duck.secs("timestamp")} // 1800 * 1800 - back * 1800) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS start, event_type, count(*) AS n FROM ev, (VALUES (0), (1)) b(back) GROUP BY 1, 2""")
add("inactive_sessions", lambda t: pipeline.inactive_sessions(t.events), f"""
    SELECT session_id, min(timestamp) AS first_event, max(timestamp) AS last_event, count(*) AS n FROM (
      SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY timestamp, seq) AS stretch FROM (
        SELECT session_id, timestamp, seq, CASE WHEN {duck.secs("timestamp")} - {duck.secs("lag(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp, seq)")} < 3600 THEN 0 ELSE 1 END AS new FROM ev WHERE session_id IS NOT NULL)) GROUP BY session_id, stretch""")
add("rebased_events", lambda t: ingest.rebased(t.events, "2026-02-01T12:00:00Z").select("event_id", "timestamp"), f"SELECT event_id, strftime(strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ') + to_seconds({duck.secs("'2026-02-01T12:00:00Z'")} - (SELECT max({duck.secs('timestamp')}) FROM ev)), '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM ev")
add("ingest_lag", lambda t: rollups.ingest_lag(t.events), f"SELECT round(avg({duck.secs('received_at')} - {duck.secs('timestamp')}), 2) AS avg_ingest_lag_seconds FROM (SELECT * FROM ev ORDER BY received_at DESC, seq DESC LIMIT 500)")

# -- top lists --------------------------------------------------------------

_CMD, _USER = "json_extract_string(details, '$.command')", "json_extract_string(details, '$.username')"
_LOGINS = "event_type IN ('login_attempt', 'login_success')"
add("top_commands", lambda t: rollups.top_commands(t.events, 5, SINCE), f"SELECT {_CMD} AS command, count(*) AS attempts, count(DISTINCT attacker_ip) AS distinct_ips, max(timestamp) AS last_seen FROM ev WHERE event_type = 'command' AND timestamp >= '{SINCE}' AND {_CMD} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
add("top_credentials", lambda t: rollups.top_credentials(t.events, 5), f"SELECT {_USER} AS username, count(*) AS attempts, count(DISTINCT attacker_ip) AS distinct_ips FROM ev WHERE {_LOGINS} AND {_USER} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
add("top_countries", lambda t: rollups.top_countries(t.events, t.reputation), "SELECT country, count(*) AS ips, sum(event_count)::BIGINT AS events FROM rep JOIN summary USING (attacker_ip) WHERE country <> '' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 8")
add("top_attackers", lambda t: rollups.top_attackers(t.events, t.reputation), "SELECT s.*, country, city, latitude, longitude, abuse_score, profile_score FROM summary s LEFT JOIN rep USING (attacker_ip) ORDER BY event_count DESC, attacker_ip LIMIT 20")

# -- map --------------------------------------------------------------------

_PLACED = f"FROM ev e JOIN rep r ON r.attacker_ip = e.attacker_ip WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND timestamp >= '{SINCE}'"
_PATHS = f"SELECT e.attacker_ip, node_id, count(*) AS events, max(timestamp) AS last_seen {_PLACED} GROUP BY 1, 2 ORDER BY events DESC, 1, 2 LIMIT 400"
_ORIGINS = f"""
    SELECT e.attacker_ip, any_value(country) AS country, any_value(city) AS city, any_value(latitude) AS latitude, any_value(longitude) AS longitude, any_value(abuse_score) AS abuse_score, any_value(profile_score) AS profile_score,
      greatest(coalesce(any_value(abuse_score), 0), coalesce(any_value(profile_score), 0)) AS risk_score, count(*) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT node_id) AS nodes, count(*) FILTER (WHERE event_type = 'login_success') AS login_successes, max(timestamp) AS last_seen
    {_PLACED} GROUP BY 1 ORDER BY events DESC, 1 LIMIT 200"""
add("attack_origins", lambda t: rollups.attack_origins(t.events, t.reputation, SINCE), _ORIGINS)
_MAP = lambda limit: f"""
    SELECT o.* EXCLUDE (latitude, longitude), round(3 + 10 * sqrt(events / greatest(max(events) OVER (), 1)), 6) AS radius, round(events * 100.0 / sum(events) OVER (), 1)::DOUBLE AS share, CASE WHEN risk_score >= 75 THEN 'high' WHEN risk_score >= 37 THEN 'medium' ELSE 'low' END AS band,
      login_successes > 0 AS breached, (SELECT count(*) FROM ({_ORIGINS})) > {limit} AS truncated FROM (SELECT * FROM ({_ORIGINS}) ORDER BY events DESC, attacker_ip LIMIT {limit}) o"""  # noqa: E731
_marks = lambda t, limit: rollups.map_marks(rollups.attack_origins(t.events, t.reputation, SINCE, limit + 1), limit).withColumn("radius", F.round("radius", 6)).drop("x", "y", "latitude", "longitude")
add("map_marks", lambda t: _marks(t, 30), _MAP(30))
add("map_marks_all", lambda t: _marks(t, 199), _MAP(199))
add("map_unknown_nodes", lambda t: rollups.unknown_nodes(rollups.attack_paths(t.events, t.reputation, SINCE), t.nodes.where("node_id <> 'node-03'")), f"SELECT node_id, sum(events)::BIGINT AS events FROM (SELECT e.attacker_ip, node_id, count(*) AS events {_PLACED} GROUP BY 1, 2 ORDER BY events DESC, 1, 2 LIMIT 400) WHERE node_id = 'node-03' GROUP BY 1")
add("placed_nodes", lambda t: rollups.placed_nodes(t.nodes.withColumn("location", F.when(F.col("node_id") == "node-01", "Berlin 52.5, 13.4").when(F.col("node_id") == "node-02", "95, 10")), {"node-03": (1, 2)}).select("node_id", "latitude", "longitude"), "SELECT node_id, CASE node_id WHEN 'node-01' THEN 52.5 WHEN 'node-03' THEN 1.0 END::DOUBLE AS latitude, CASE node_id WHEN 'node-01' THEN 13.4 WHEN 'node-03' THEN 2.0 END::DOUBLE AS longitude FROM nodes")
add("attack_paths", lambda t: rollups.attack_paths(t.events, t.reputation, SINCE), _PATHS)
add("attack_extent", lambda t: rollups.attack_extent(t.events, t.reputation), f"SELECT count(*) AS events, count(DISTINCT e.attacker_ip) AS origins, min(timestamp) AS first_seen, max(timestamp) AS last_seen {_PLACED.replace(SINCE, '')}")
add("map_totals", lambda t: rollups.map_totals(rollups.attack_paths(t.events, t.reputation, SINCE)), f"SELECT node_id, sum(events)::BIGINT AS events, count(DISTINCT attacker_ip) AS attackers, round(sum(events) * 100.0 / (SELECT sum(events) FROM ({_PATHS})), 1)::DOUBLE AS share FROM ({_PATHS}) GROUP BY 1")


def _projection(t: Tables) -> DataFrame:
    x, y = projected(F.col("latitude"), F.col("longitude"))
    return t.reputation.where("latitude is not null").select("attacker_ip", F.round(x * 10).cast("long").alias("x10"), F.round(y * 10).cast("long").alias("y10"))


add("map_projection", _projection, "SELECT attacker_ip, round(round_even((longitude + 180.0) / 360.0 * 1000.0, 1) * 10)::BIGINT AS x10, round(round_even((84.0 - greatest(-60.0, least(84.0, latitude))) / 144.0 * 400.0, 1) * 10)::BIGINT AS y10 FROM rep WHERE latitude IS NOT NULL")

# -- one address, one session -----------------------------------------------

add("attacker_commands", lambda t: rollups.commands_of(t.events, IP), f"SELECT {_CMD} AS command, count(*) AS times, max(timestamp) AS last_seen FROM ev WHERE event_type = 'command' AND attacker_ip = '{IP}' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25")
add("attacker_usernames", lambda t: rollups.usernames_of(t.events, IP), f"SELECT {_USER} AS username, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'login_success') AS successes FROM ev WHERE {_LOGINS} AND attacker_ip = '{IP}' AND {_USER} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
add("attacker_nodes", lambda t: rollups.nodes_of(t.events, IP), f"SELECT node_id, count(*) AS events, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ev WHERE attacker_ip = '{IP}' GROUP BY 1")
add("attacker_activity", lambda t: rollups.daily_of(t.events, IP, SINCE), f"SELECT substr(timestamp, 1, 10) AS day, count(*) AS n FROM ev WHERE attacker_ip = '{IP}' AND timestamp >= '{SINCE}' GROUP BY 1")
add("attacker_events", lambda t: search.events_of(t.events, IP), f"SELECT event_id, node_id, session_id, event_type, timestamp, protocol, {', '.join(f'''json_extract_string(details, '$.{k}') AS {k}''' for k in ('username', 'command', 'file_name', 'download_url', 'status'))} FROM ev WHERE attacker_ip = '{IP}' ORDER BY timestamp DESC, seq DESC LIMIT 200")
add("session_counters", lambda t: rollups.session_counters(t.events), f"SELECT session_id, {duck.COUNTERS} FROM ev WHERE session_id IS NOT NULL GROUP BY 1")
_GAP = f"{duck.secs('timestamp')} - {duck.secs('lag(timestamp) OVER w')}"
add("session_transcript", lambda t: search.transcript(t.events), f"""
    SELECT session_id, event_id, event_type, timestamp, node_id, attacker_ip, protocol, {', '.join(f'''json_extract_string(details, '$.{k}') AS {k}''' for k in ('username', 'command', 'download_url', 'file_name', 'file_hash', 'status', 'duration_seconds', 'destination_ip', 'destination_port', 'source_port', 'agent_version'))},
      CASE WHEN json_extract_string(details, '$.password') IS NULL THEN 0 ELSE 1 END AS had_password, CASE WHEN {_GAP} >= 60 THEN {_GAP} END AS gap_seconds, row_number() OVER w AS line, {duck.classified(_CMD, 1)} AS risk, {duck.classified(_CMD, 2)} AS risk_label
    FROM ev WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, received_at, seq)""")
add("transcript_counts", lambda t: search.transcript_counts(t.events), "SELECT session_id, count(*) FILTER (WHERE event_type = 'login_attempt') AS failed_logins, count(*) FILTER (WHERE event_type = 'login_success') AS successes, count(*) FILTER (WHERE event_type = 'command') AS commands, count(*) FILTER (WHERE event_type = 'file_download') AS downloads FROM ev WHERE session_id IS NOT NULL GROUP BY 1")
add("adjacent_sessions", lambda t: search.adjacent_sessions(t.sessions), "SELECT session_id, attacker_ip, lag(session_id) OVER w AS prev, lead(session_id) OVER w AS next, row_number() OVER w AS position, count(*) OVER (PARTITION BY attacker_ip) AS sessions FROM sessions WHERE attacker_ip IS NOT NULL WINDOW w AS (PARTITION BY attacker_ip ORDER BY start_time DESC, session_id)")

# -- searches ---------------------------------------------------------------

add("search_attackers", lambda t: search.search_attackers(t.events, t.reputation, t.alerts, {"q": "iTy", "min_score": 20, "alerts_only": True, "node": NODE, "since": SINCE}, "score", 40, 2)[0], f"""
    SELECT * FROM attackers WHERE (attacker_ip LIKE '%ity%' OR lower(country) LIKE '%ity%' OR lower(city) LIKE '%ity%') AND risk_score >= 20 AND alert_count > 0 AND last_seen >= '{SINCE}'
      AND attacker_ip IN (SELECT attacker_ip FROM ev WHERE node_id = '{NODE}') ORDER BY risk_score DESC, event_count DESC, attacker_ip LIMIT 40 OFFSET 2""")
add("attacker_rows", lambda t: search.attackers(t.events, t.reputation, t.alerts), "SELECT * FROM attackers")
add("search_sessions", lambda t: search.search_sessions(t.sessions, t.events, t.reputation, {"q": "ROOT", "status": "closed", "commands_only": True}, "duration", 50, 0)[0], f"""
    SELECT * FROM session_rows WHERE (lower(session_id) LIKE '%root%' OR attacker_ip LIKE '%root%' OR lower(username) LIKE '%root%') AND status = 'closed' AND command_count > 0 ORDER BY duration_seconds DESC NULLS LAST, session_id LIMIT 50""")
add("search_alerts", lambda t: search.search_alerts(t.alerts, t.reputation, {"q": "node", "min_severity": "medium", "status": "open", "since": SINCE}, "severity", 60, 10)[0], f"""
    SELECT a.*, country, city, abuse_score, profile_score, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS severity_rank FROM alerts a LEFT JOIN rep USING (attacker_ip)
    WHERE (lower(description) LIKE '%node%' OR lower(session_id) LIKE '%node%' OR lower(alert_type) LIKE '%node%' OR lower(a.attacker_ip) LIKE '%node%') AND severity IN ('medium', 'high') AND status = 'open' AND timestamp >= '{SINCE}' ORDER BY severity_rank DESC, timestamp DESC, alert_id LIMIT 60 OFFSET 10""")
add("countries", lambda t: rollups.vocabulary(t.reputation, "country"), "SELECT DISTINCT country FROM rep WHERE country <> ''")
add("protocols", lambda t: rollups.vocabulary(t.sessions, "protocol"), "SELECT DISTINCT protocol FROM sessions WHERE protocol <> ''")
add("alert_types", lambda t: rollups.vocabulary(t.alerts, "alert_type"), "SELECT DISTINCT alert_type FROM alerts")

# -- reputation and scores --------------------------------------------------

_INPUTS = f"SELECT attacker_ip, count(*) AS event_count, count(DISTINCT session_id) AS session_count, count(DISTINCT node_id) AS node_count, count(DISTINCT {_CMD}) FILTER (WHERE event_type = 'command') AS distinct_commands, count(DISTINCT {_USER}) FILTER (WHERE {_LOGINS}) AS distinct_usernames FROM ev WHERE attacker_ip IS NOT NULL GROUP BY 1"
add("profile_inputs", lambda t: ingest.profile_inputs(t.events), _INPUTS)
add("profile_score", lambda t: ingest.profile_inputs(t.events).join(t.reputation, "attacker_ip").select("attacker_ip", profile_score(F.col("abuse_score"), F.col("session_count"), F.col("distinct_commands")).alias("score")), f"SELECT attacker_ip, greatest(0, least(100, coalesce(abuse_score, 0) + least(25, session_count * 5) + least(25, distinct_commands * 2)))::INT AS score FROM ({_INPUTS}) JOIN rep USING (attacker_ip)")
add("score_bands", lambda t: t.reputation.groupBy(score_band(F.col("abuse_score")).alias("band")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN abuse_score IS NULL THEN 'none' WHEN abuse_score >= 75 THEN 'high' WHEN abuse_score >= 37 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM rep GROUP BY 1")
_KINDS = ["2606:4700::1111", "fe80::1", "::1", "2001:db8::7", "fd00::9", "10.1.2.3", "192.168.7.7", "8.8.8.8"]


def _queue(t: Tables) -> DataFrame:
    """The queue for the log and a few public and private addresses of both kinds."""
    more = t.spark.createDataFrame([(x,) for x in _KINDS], "attacker_ip string")
    known = t.reputation.where("profile_score < 60").withColumn("last_updated", F.when(F.col("profile_score") < 20, "2024-01-01T00:00:00Z").otherwise(F.col("last_updated")))
    return ingest.enrichment_queue(t.events.select("attacker_ip").unionByName(more), known, NOW, limit=10_000)


add("enrichment_queue_of_all_kinds", _queue, "SELECT attacker_ip FROM (SELECT DISTINCT attacker_ip FROM ev LEFT JOIN (SELECT * FROM rep WHERE profile_score < 60) r USING (attacker_ip) WHERE attacker_ip IS NOT NULL AND (r.profile_score IS NULL OR r.profile_score < 20) UNION VALUES ('2606:4700::1111'), ('2001:db8::7'), ('8.8.8.8')) ORDER BY 1 LIMIT 10000")
add("enrichment_queue", lambda t: ingest.enrichment_queue(t.events, t.reputation.where("profile_score < 60").withColumn("last_updated", F.when(F.col("profile_score") < 20, "2024-01-01T00:00:00Z").otherwise(F.col("last_updated"))), NOW, limit=50), "SELECT DISTINCT attacker_ip FROM ev LEFT JOIN (SELECT * FROM rep WHERE profile_score < 60) r USING (attacker_ip) WHERE attacker_ip IS NOT NULL AND (r.profile_score IS NULL OR r.profile_score < 20) ORDER BY 1 LIMIT 50")


def _new_reputation(t: Tables) -> DataFrame:
    """Lookups for every address of the table, and for as many unknown ones."""
    known = t.reputation.select("attacker_ip")
    rows = known.unionByName(known.select(F.concat(F.lit("new-"), "attacker_ip").alias("attacker_ip")))
    return rows.select("attacker_ip", F.lit(None).cast("string").alias("country"), F.lit("moved").alias("city"), F.lit(None).cast("double").alias("latitude"), F.lit(1.5).alias("longitude"), F.lit(7).alias("abuse_score"), F.lit("ip-api, other").alias("source"), F.lit(None).cast("int").alias("profile_score"), F.lit(NOW).alias("last_updated"))


add("reputation_merge", lambda t: ingest.merged_reputation(t.reputation.unionByName(t.reputation.withColumn("attacker_ip", F.concat(F.lit("old-"), "attacker_ip"))), _new_reputation(t)), f"""
    SELECT attacker_ip, country, 'moved' AS city, latitude, 1.5 AS longitude, 7 AS abuse_score, 'ip-api,AbuseIPDB,other' AS source, profile_score, '{NOW}' AS last_updated FROM rep
    UNION ALL SELECT 'old-' || attacker_ip, country, city, latitude, longitude, abuse_score, source, coalesce(profile_score, 0), last_updated FROM rep
    UNION ALL SELECT 'new-' || attacker_ip, NULL, 'moved', NULL, 1.5, 7, 'ip-api, other', 0, '{NOW}' FROM rep""")
add("enriched", lambda t: ingest.enriched(t.events.where("attacker_ip is not null").select("attacker_ip").distinct(), t.reputation.select("attacker_ip", "country", "city", "latitude", "longitude", "abuse_score", "source"), ingest.profile_inputs(t.events), NOW), f"""
    SELECT attacker_ip, r.country, r.city, r.latitude, r.longitude, r.abuse_score, coalesce(r.source, 'Error Fallback') AS source, CASE WHEN r.attacker_ip IS NULL THEN NULL ELSE greatest(0, least(100, coalesce(abuse_score, 0) + least(25, session_count * 5) + least(25, distinct_commands * 2)))::INT END AS profile_score, '{NOW}' AS last_updated
    FROM ({_INPUTS}) i LEFT JOIN rep r USING (attacker_ip)""")

_IDENTITY = f"identity--{uuid.uuid5(uuid.UUID(ID_NAMESPACE), 'sentryspark')}"

# -- feed -------------------------------------------------------------------


def _flat(t: Tables) -> DataFrame:
    return feed.indicators(t.events, t.alerts, t.reputation)


def _filtered(t: Tables) -> DataFrame:
    rows, alerts = feed.filtered(_flat(t), feed.feed_alerts(t.alerts, t.reputation), since=SINCE, alert_type="brute_force", min_confidence=80)
    return rows.select(F.lit("indicator").alias("kind"), F.col("attacker_ip").alias("name")).unionByName(alerts.select(F.lit("alert").alias("kind"), F.col("alert_id").alias("name")))


add("feed_indicators", lambda t: _text(_flat(t), "alert_types"), "SELECT * FROM indicators")
add("feed_confidence", lambda t: _flat(t).select("attacker_ip", "confidence"), "SELECT attacker_ip, confidence FROM indicators")
add("feed_alerts", lambda t: feed.feed_alerts(t.alerts, t.reputation), "SELECT * FROM feed_alerts")
add("feed_filtered", _filtered, f"SELECT 'indicator' AS kind, attacker_ip AS name FROM indicators WHERE last_seen >= '{SINCE}' AND list_contains(string_split(alert_types, ','), 'brute_force') AND confidence >= 80 UNION ALL SELECT 'alert', alert_id FROM feed_alerts WHERE timestamp >= '{SINCE}' AND alert_type = 'brute_force'")
add("feed_csv", lambda t: feed.flattened(_flat(t)), "SELECT attacker_ip, first_seen, last_seen, severity, confidence, alert_count, replace(alert_types, ',', ';') AS alert_types, country, city, latitude, longitude, abuse_score, profile_score, replace(coalesce(reputation_source, ''), ',', ';') AS sources, event_count AS events, session_count AS sessions, node_count AS nodes_touched, login_attempts, command_count AS commands, download_count AS downloads FROM indicators")


def _stix(t: Tables) -> DataFrame:
    """What is in the objects of the bundle."""
    get = lambda name: F.get_json_object("json", f"$.{name}").alias(name)
    return feed.stix_bundle(_flat(t), NOW).select("position", *(get(x) for x in ("type", "id", "created_by_ref", "created", "name", "description", "pattern", "valid_from", "confidence", "labels", "identity_class", "indicator_types")))


def _document(t: Tables) -> DataFrame:
    """What is in the rows of the feed document."""
    get = lambda name, path: F.get_json_object("json", f"$.{path}").alias(name)
    rows = feed.feed_rows(_flat(t), feed.feed_alerts(t.alerts, t.reputation), NOW)
    parts = {"attacker_ip": "attacker_ip", "first_seen": "first_seen", "severity": "severity", "confidence": "confidence", "events": "activity.events", "nodes": "activity.nodes_touched", "city": "geo.city", "abuse": "scores.abuse_score", "source": "scores.sources[0]", "alert_id": "alert_id", "indicators": "counts.indicators", "alerts": "counts.alerts", "generated_at": "generated_at"}
    return rows.select("part", *(get(k, v) for k, v in parts.items()))


add("stix_bundle", _stix, f"""
    SELECT 1 AS position, 'indicator' AS type, 'indicator--' || {duck.uuid5("'indicator|' || attacker_ip")} AS id, '{_IDENTITY}' AS created_by_ref, '2024-01-31T00:00:00.000Z' AS created, 'Honeypot activity from ' || attacker_ip AS name,
      concat_ws('. ', 'Observed on ' || node_count || ' honeypot sensor(s)', session_count || ' session(s)', login_attempts || ' login attempt(s)', CASE WHEN command_count > 0 THEN command_count || ' command(s) executed' END, CASE WHEN download_count > 0 THEN download_count || ' payload download(s)' END,
        CASE WHEN coalesce(country, '') <> '' THEN 'geolocated to ' || country END, CASE WHEN abuse_score IS NOT NULL THEN 'AbuseIPDB score ' || abuse_score END) || '.' AS description,
      '[ipv4-addr:value = ' || chr(39) || attacker_ip || chr(39) || ']' AS pattern, replace(coalesce(first_seen, '{NOW}'), 'Z', '.000Z') AS valid_from, confidence::VARCHAR AS confidence, '["' || replace(alert_types, ',', '","') || '"]' AS labels, NULL AS identity_class, '["malicious-activity"]' AS indicator_types FROM indicators
    UNION ALL SELECT 0, 'identity', '{_IDENTITY}', NULL, '2024-01-31T00:00:00.000Z', 'sentryspark', NULL, NULL, NULL, NULL, NULL, 'system', NULL""")
add("feed_document", _document, f"""
    SELECT 'indicator' AS part, attacker_ip, first_seen, severity, confidence::VARCHAR AS confidence, event_count::VARCHAR AS events, node_count::VARCHAR AS nodes, city, abuse_score::VARCHAR AS abuse, CASE WHEN reputation_source <> '' THEN string_split(reputation_source, ',')[1] END AS source, NULL AS alert_id, NULL AS indicators, NULL AS alerts, NULL AS generated_at FROM indicators
    UNION ALL SELECT 'alert', attacker_ip, NULL, severity, NULL, NULL, NULL, NULL, NULL, NULL, alert_id, NULL, NULL, NULL FROM feed_alerts
    UNION ALL SELECT 'feed', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT count(*) FROM indicators)::VARCHAR, (SELECT count(*) FROM feed_alerts)::VARCHAR, '{NOW}'""")

# -- overview ---------------------------------------------------------------

add("dashboard_overview", lambda t: rollups.overview(t.events, t.sessions, t.nodes, t.alerts, t.reputation, HOUR, DAY), f"""
    SELECT (SELECT count(*) FROM ev) AS total_events, (SELECT count(*) FROM ev WHERE timestamp >= '{HOUR}') AS events_last_hour, (SELECT count(*) FROM ev WHERE timestamp >= '{DAY}') AS events_in_window, (SELECT count(*) FROM ev WHERE timestamp >= '{DAY}' AND event_type <> 'heartbeat') AS attacks_in_window,
      (SELECT count(DISTINCT attacker_ip) FROM ev) AS unique_attackers, (SELECT count(DISTINCT attacker_ip) FROM ev WHERE timestamp >= '{DAY}') AS attackers_in_window, (SELECT max(timestamp) FROM ev) AS latest_event, (SELECT count(*) FROM sessions) AS total_sessions,
      (SELECT count(*) FROM sessions WHERE status = 'active') AS active_sessions, (SELECT count(*) FROM sessions WHERE start_time >= '{DAY}') AS sessions_in_window, (SELECT count(*) FROM nodes WHERE status = 'online') AS nodes_online, (SELECT count(*) FROM nodes) AS nodes_total,
      (SELECT count(*) FROM alerts WHERE status = 'open') AS open_alerts, (SELECT count(*) FROM alerts WHERE status = 'open' AND severity = 'high') AS open_high_alerts, (SELECT count(*) FROM alerts WHERE timestamp >= '{DAY}') AS alerts_in_window, (SELECT count(*) FROM rep) AS enriched_ips,
      (SELECT count(*) FROM rep WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS placed_ips, (SELECT round(avg({duck.secs('received_at')} - {duck.secs('timestamp')}), 2) FROM (SELECT * FROM ev ORDER BY received_at DESC, seq DESC LIMIT 500)) AS avg_ingest_lag_seconds, (SELECT greatest(0, count(*) - count(*) FILTER (WHERE status = 'online')) FROM nodes) AS nodes_stale""")
_OVERVIEW = ("total_events", "events_last_hour", "unique_attackers", "total_sessions", "active_sessions", "nodes_online", "nodes_total", "open_alerts", "open_high_alerts", "enriched_ips", "avg_ingest_lag_seconds")
add("overview_stats", lambda t: rollups.overview(t.events, t.sessions, t.nodes, t.alerts, t.reputation, HOUR, DAY).select(*_OVERVIEW), None)
ORACLES["overview_stats"] = f"SELECT {', '.join(_OVERVIEW)} FROM ({ORACLES['dashboard_overview']})"
add("rule_catalogue", lambda t: screens.rule_catalogue(t.spark), "SELECT * FROM (VALUES ('brute_force', true, 5, 5), ('credential_spray', true, 5, 5), ('high_risk_ip', true, 75, 5), ('suspicious_command', true, NULL, 5), ('malware_staging', true, NULL, 5), ('multi_node_scan', true, 2, 5), ('post_auth_activity', true, NULL, 5)) v(rule, enabled, threshold, window_minutes)")
add("command_patterns", lambda t: screens.command_patterns(t.spark), f"SELECT * FROM (VALUES {', '.join(str((k, *row)) for k, row in enumerate(COMMAND_PATTERNS))}) v(position, pattern, severity, label)".replace("\\\\", "\\"))
add("health_tallies", lambda t: screens.health_tallies(t, NOW, DAY), None)
ORACLES["health_tallies"] = f"SELECT health, count(*) AS n FROM ({ORACLES['node_health']}) GROUP BY 1"

# -- validation and mapping over lines made of the events ---------------------------


def _lines(t: Tables) -> DataFrame:
    """The events as lines of compact JSON with the keys of details in another order, every ninth of them damaged in one of eight ways."""
    raw = {k: F.col(k) for k in ("event_id", "node_id", "event_type", "timestamp", "session_id", "attacker_ip", "protocol")}
    way = F.when(F.col("seq") % 9 == 0, F.floor(F.col("seq") / 9) % 8)
    raw["event_id"] = F.when(way == 0, "no-uuid").otherwise(raw["event_id"])
    raw["event_type"] = F.when(way == 1, "unheard").otherwise(raw["event_type"])
    raw["timestamp"] = F.when(way == 2, "2024-13-45T00:00:00Z").otherwise(raw["timestamp"])
    raw["node_id"] = F.when(way == 3, "node-77").otherwise(raw["node_id"])
    head = F.to_json(F.struct(*(v.alias(k) for k, v in raw.items())), {"ignoreNullFields": "false"})
    details = F.regexp_replace(F.regexp_replace("details", r'^\{("password": .*), ("username": .*)\}$', "{$2, $1}"), r'(?<=":) |(?<=,) (?=")', "")
    details = F.when(way == 4, "null").when(way == 6, F.regexp_replace(details, r"^\{", '{"host":1,')).when(way == 7, "{}").otherwise(details)
    line = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"details":'), details, F.when(way == 5, ',"more":1').otherwise(""), F.lit("}"))
    return t.events.select("seq", "received_at", line.alias("line"))


_WAY = "CASE WHEN seq % 9 = 0 THEN (seq // 9) % 8 END"
_NEEDS = {"heartbeat": "status", "login_attempt": "username", "command": "command", "session_end": "status"}
_EMPTY = "CASE event_type " + " ".join(f"WHEN '{k}' THEN 'details.{v} is required and must be non-null for ' || chr(39) || '{k}' || chr(39) " for k, v in _NEEDS.items()) + "WHEN 'file_download' THEN chr(39) || 'file_download'' requires at least one of: download_url, file_hash' END"
add("validate_events", lambda t: ingest.problem_counts(ingest.validated(_lines(t))), f"""
    SELECT problem, count(*) AS n FROM (SELECT CASE {_WAY} WHEN 0 THEN 'event_id must be a valid UUID string' WHEN 1 THEN 'event_type ''unheard'' is not an allowed type' WHEN 2 THEN 'timestamp ''2024-13-45T00:00:00Z'' is not a real date/time'
      WHEN 3 THEN 'node_id ''node-77'' is not a registered node' WHEN 4 THEN 'details must be an object, never null' WHEN 5 THEN 'unexpected top-level field(s): more' WHEN 6 THEN 'details key(s) not allowed for ' || chr(39) || event_type || chr(39) || ': host' WHEN 7 THEN {_EMPTY} END AS problem FROM ev) WHERE problem IS NOT NULL GROUP BY 1""")
_VALID = f"SELECT * REPLACE (CASE WHEN seq % 9 = 0 THEN chr(123) || chr(125) ELSE details END AS details) FROM ev WHERE seq % 9 <> 0 OR ({_WAY} = 7 AND {_EMPTY} IS NULL)"
add("normalized_events", lambda t: ingest.normalized(ingest.validated(_lines(t))), _VALID)


def _collected(t: Tables) -> DataFrame:
    """Problems that only the collector and sensors see: an address that is none, and a user name of white space."""
    details = F.when((F.col("event_type") == "login_attempt") & (F.col("seq") % 11 == 1), '{"username":"  "}').otherwise(F.col("details"))
    ip = F.when((F.col("event_type") != "heartbeat") & (F.col("seq") % 11 == 0), "nowhere").otherwise(tables.sendable(F.col("attacker_ip")))
    head = F.to_json(F.struct("event_id", "node_id", "event_type", "timestamp", "session_id", ip.alias("attacker_ip"), "protocol"), {"ignoreNullFields": "false"})
    lines = t.events.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"details":'), details, F.lit("}")).alias("line"))
    found = [ingest.problem_counts(ingest.validated(lines, profile=x)).withColumn("profile", F.lit(x)) for x in ("storage", "collector", "sensor")]
    return found[0].unionByName(found[1]).unionByName(found[2])


add("validate_profiles", _collected, """
    SELECT problem, n, profile FROM (SELECT 'attacker_ip must be an address' AS problem, count(*) AS n FROM ev WHERE event_type <> 'heartbeat' AND seq % 11 = 0
      UNION ALL SELECT 'details.username is required and must be non-null for ' || chr(39) || 'login_attempt' || chr(39), count(*) FROM ev WHERE event_type = 'login_attempt' AND seq % 11 = 1), (VALUES ('collector'), ('sensor')) p(profile)""")


def _batches(t: Tables) -> DataFrame:
    """Batches of one sensor, of 15 or 30 events, some of them sent in another's name."""
    part = F.floor(F.col("seq") / F.when(F.floor(F.col("seq") / 360) % 2 == 0, 45).otherwise(90))
    sender = F.when(F.floor(F.col("seq") / 45) % 14 == 3, "node-01").otherwise(F.col("node_id"))
    return ingest.batch_rejections(t.events.select(F.concat_ws(":", "node_id", part.cast("string")).alias("batch_id"), sender.alias("header_node"), F.to_json(F.struct("node_id")).alias("line")))


add("batch_rejections", _batches, """
    SELECT batch_id, CASE WHEN n > 20 THEN 'more than 20 events' ELSE 'node_id differs from the sender' || chr(39) || 's' END AS reason FROM (
      SELECT node_id || ':' || (seq // CASE WHEN (seq // 360) % 2 = 0 THEN 45 ELSE 90 END) AS batch_id, count(*) AS n, bool_or((seq // 45) % 14 = 3 AND node_id <> 'node-01') AS alien FROM ev GROUP BY 1) WHERE n > 20 OR alien""")


def _streamed(t: Tables) -> DataFrame:
    """The lines, every seventh twice, through the ingest stream; then every fifth again, a year later by its own account."""
    landing, out, checkpoint = (tables.new_folder(t.spark, x) for x in ("landing", "log", "stream"))
    lines = _lines(t)
    later = lines.where("seq % 5 = 0").withColumn("line", F.regexp_replace("line", '"timestamp":"2024', '"timestamp":"2025'))
    for rows in (lines.unionByName(lines.where("seq % 7 = 0")), later):
        rows.select(F.col("line").alias("value")).write.mode("append").text(landing)
        pipeline.ingest(t.spark, landing, out, checkpoint).awaitTermination()
    return pipeline.stored_events(t.spark, out).drop("seq", "received_at")


add("stream_dedupe", _streamed, f"SELECT * EXCLUDE (seq, received_at) FROM ({_VALID})")


def _shell(t: Tables) -> DataFrame:
    """Events as a shell sensor logs them, mapped back."""
    name = F.create_map(*(F.lit(x) for k, v in mappers.SHELL_TYPES.items() for x in (v, k)))
    raw = F.struct(
        F.coalesce(F.element_at(name, F.col("event_type")), F.lit("cowrie.log.closed")).alias("eventid"), F.col("timestamp"), F.col("session_id").alias("session"), F.col("attacker_ip").alias("src_ip"),
        field("username").alias("username"), field("password").alias("password"), field("command").alias("input"), field("download_url").alias("url"), field("file_name").alias("outfile"),
    )
    rows = mappers.shell_events(t.events.select(F.to_json(raw).alias("line")), "node-01")
    return rows.select("event_type", "timestamp", "session_id", "attacker_ip", "protocol", *(field(x).alias(x) for x in ("username", "password", "command", "download_url", "file_name")))


add("map_shell_log", _shell, "SELECT event_type, timestamp, session_id, attacker_ip, 'ssh' AS protocol, " + ", ".join(f"json_extract_string(details, '$.{k}') AS {k}" for k in ("username", "password", "command", "download_url", "file_name")) + " FROM ev WHERE event_type <> 'heartbeat'")


def _service(t: Tables) -> DataFrame:
    """Login attempts as connection records of a service sensor, mapped to events."""
    user, secret = field("username").alias("username"), field("password").alias("password")
    command = lambda verb, *words: F.struct(F.lit(verb).alias("command"), F.array(*words).alias("arguments"))
    raw = F.struct(
        F.struct(F.lit("accept").alias("type"), F.when(F.col("protocol") == "ftp", "ftpd").when(F.col("protocol") == "smb", "smbd").otherwise("pcap").alias("protocol")).alias("connection"),
        F.regexp_replace("timestamp", "Z", "").alias("timestamp"), F.col("attacker_ip").alias("src_ip"), F.lit(4000).alias("src_port"), F.lit("198.51.100.1").alias("dst_ip"), F.lit(21).alias("dst_port"),
        F.array(F.struct(user, secret)).alias("credentials"), F.struct(F.array(command("USER", field("username")), command("PASS", F.coalesce(field("password"), F.lit("x")))).alias("commands")).alias("ftp"),
    )
    lines = t.events.where("event_type = 'login_attempt'").select(F.to_json(raw).alias("line"))
    rows = mappers.service_events(lines, NODE)
    return rows.select("event_type", "timestamp", "attacker_ip", "protocol", "session_id", field("username").alias("username"), field("password").alias("password"), field("command").alias("command"))


_PARTS = "(VALUES ('connection', 0), ('login_attempt', 1), ('command', 2), ('command', 3), ('session_end', 4)) v(event_type, part)"
add("map_service_log", _service, f"""
    SELECT v.event_type, timestamp, attacker_ip, protocol, '{NODE}:' || substr(sha256(attacker_ip || '|4000|198.51.100.1|21|' || replace(timestamp, 'Z', '')), 1, 16) AS session_id, CASE part WHEN 1 THEN {_USER} END AS username, CASE part WHEN 1 THEN json_extract_string(details, '$.password') END AS password,
      CASE part WHEN 2 THEN 'USER ' || {_USER} WHEN 3 THEN 'PASS ***REDACTED***' END AS command FROM ev, {_PARTS} WHERE ev.event_type = 'login_attempt' AND protocol IN ('ftp', 'smb')""")


# -- composite reads, part by part ------------------------------------------------

_SENSORS = {"node-01": (52.5, 13.4), "node-02": (-33.9, 151.2)}
_SESSION = f"(SELECT min(session_id) FROM sessions WHERE attacker_ip = '{IP}')"


def _first_session(t: Tables) -> str:
    return t.sessions.where(F.col("attacker_ip") == IP).agg(F.min("session_id")).first()[0]


def _arcs(t: Tables) -> DataFrame:
    rows = screens.map_screen(t, SINCE, _SENSORS)["arcs"]
    return rows.select("attacker_ip", "node_id", "events", "last_seen", *(F.round(F.col(c) * 10).cast("long").alias(c) for c in ("origin_x", "origin_y", "sensor_x", "sensor_y")))


def _at(latitude: str, longitude: str, end: str) -> str:
    return f"round(round_even(({longitude} + 180.0) / 360.0 * 1000.0, 1) * 10)::BIGINT AS {end}_x, round(round_even((84.0 - greatest(-60.0, least(84.0, {latitude}))) / 144.0 * 400.0, 1) * 10)::BIGINT AS {end}_y"


add("screen_overview_alerts", lambda t: screens.overview(t, NOW, HOUR, DAY)["alerts"], "SELECT a.*, country, city, abuse_score, profile_score, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS severity_rank FROM alerts a LEFT JOIN rep USING (attacker_ip) WHERE status = 'open' ORDER BY timestamp DESC, alert_id LIMIT 8")
add("screen_overview_activity", lambda t: screens.overview(t, NOW, HOUR, DAY)["activity"])
ORACLES["screen_overview_activity"] = ORACLES["activity_gapfilled"].replace("TIMESTAMP '2024-01-23'", "TIMESTAMP '2024-01-30'").replace(f">= '{SINCE}'", f">= '{DAY}'")
add("screen_attackers", lambda t: screens.attacker_list(t, {"min_score": 30}, "events", 1, 25)["rows"], "SELECT * FROM attackers WHERE risk_score >= 30 ORDER BY event_count DESC, attacker_ip LIMIT 25")
add("screen_profile", lambda t: screens.attacker_profile(t, IP, "")["summary"], f"SELECT * FROM attackers WHERE attacker_ip = '{IP}'")
add("screen_profile_sessions", lambda t: screens.attacker_profile(t, IP, "")["sessions"], f"SELECT * FROM session_rows WHERE attacker_ip = '{IP}' ORDER BY start_time DESC, session_id LIMIT 25")
add("screen_session", lambda t: screens.session_detail(t, _first_session(t))["session"], f"SELECT * FROM session_rows WHERE session_id = {_SESSION}")
add("screen_session_counts", lambda t: screens.session_detail(t, _first_session(t))["counts"], f"SELECT session_id, count(*) FILTER (WHERE event_type = 'login_attempt') AS failed_logins, count(*) FILTER (WHERE event_type = 'login_success') AS successes, count(*) FILTER (WHERE event_type = 'command') AS commands, count(*) FILTER (WHERE event_type = 'file_download') AS downloads FROM ev WHERE session_id = {_SESSION} GROUP BY 1")
add("screen_alerts", lambda t: screens.alerts_screen(t, {"status": "open"}, "type", 2, 20)["rows"], "SELECT a.*, country, city, abuse_score, profile_score, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS severity_rank FROM alerts a LEFT JOIN rep USING (attacker_ip) WHERE status = 'open' ORDER BY alert_type, timestamp DESC, alert_id LIMIT 20 OFFSET 20")
add("screen_node_hours", lambda t: screens.nodes_screen(t, NOW, DAY)["hours"], f"SELECT node_id, substr(timestamp, 1, 13) AS bucket, count(*) AS n FROM ev WHERE timestamp >= '{DAY}' GROUP BY 1, 2")
add("screen_node_peak", lambda t: screens.nodes_screen(t, NOW, DAY)["peak"], f"SELECT max(n) AS peak FROM (SELECT count(*) AS n FROM ev WHERE timestamp >= '{DAY}' GROUP BY node_id, substr(timestamp, 1, 13))")
add("screen_map_arcs", _arcs, f"""
    SELECT p.attacker_ip, p.node_id, p.events, p.last_seen, {_at("o.latitude", "o.longitude", "origin")}, {_at("s.latitude", "s.longitude", "sensor")}
    FROM (SELECT * FROM ({_PATHS.replace("LIMIT 400", f"LIMIT {DEFAULT.map_paths}")})) p JOIN (SELECT * FROM ({_ORIGINS}) ORDER BY events DESC, attacker_ip LIMIT {DEFAULT.map_origins}) o USING (attacker_ip)
    JOIN (VALUES {", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in _SENSORS.items())}) s(node_id, latitude, longitude) USING (node_id)""")
add("screen_map_outside", lambda t: screens.map_screen(t, SINCE, _SENSORS)["outside"], f"SELECT greatest(0, (SELECT count(*) {_PLACED.replace(SINCE, '')}) - (SELECT count(*) {_PLACED})) AS outside_window")
add("screen_feed_preview", lambda t: screens.feed_preview(t, NOW, min_confidence=80)["indicators"].select("attacker_ip", "confidence", "alert_count"), "SELECT attacker_ip, confidence, alert_count FROM indicators WHERE confidence >= 80")
add("screen_statistics", lambda t: screens.statistics(t, HOUR, DAY)["credentials"], f"SELECT {_USER} AS username, count(*) AS attempts, count(DISTINCT attacker_ip) AS distinct_ips FROM ev WHERE {_LOGINS} AND {_USER} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _cycled(t: Tables) -> DataFrame:
    t.events = tables.stored(t.events, "log")  # a system's log is stored; a cycle scans it ten times
    return screens.cycle(t, SINCE, NOW, tables.new_folder(t.spark, "feed"))["sessions"]


add("screen_cycle_sessions", _cycled, None)
ORACLES["screen_cycle_sessions"] = ORACLES["stale_session_close"].replace("2024-01-30T12:00:00Z", NOW)
add("screen_dossier", lambda t: screens.dossier(t, IP, NOW)["csv"].drop("reputation_latitude", "reputation_longitude"), f"SELECT s.*, country AS reputation_country, city AS reputation_city, abuse_score AS reputation_abuse_score, source AS reputation_source, profile_score AS reputation_profile_score, last_updated AS reputation_last_updated FROM summary s LEFT JOIN rep USING (attacker_ip) WHERE s.attacker_ip = '{IP}'")
live.register(add, _lines, _VALID, _INPUTS)
edges.register(add, _lines, _VALID)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, build=build: build(Tables(spark, sf_dir))) for name, build in BUILDS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of a pass over the whole log."""
    return rules.new_alerts(Tables(spark, sf_dir).pass_findings, NOW)
