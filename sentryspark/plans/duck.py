"""DuckDB SQL for the derived tables that the catalogue's comparisons start from."""

from __future__ import annotations

import re

from sentryspark.config import DEFAULT, ID_NAMESPACE
from sentryspark.functions.scalar import COMMAND_PATTERNS
from sentryspark.sources.tables import DUCK_EVENTS, DUCK_REPUTATION

SINCE, NOW = "2024-01-23T00:00:00Z", "2024-01-31T00:00:00Z"
#: Of the pass that is compared: long enough for earlier alerts and earlier findings to hold others back.
COOLDOWN_MINUTES = 3 * 24 * 60
FINDING = "alert_type, attacker_ip, severity, timestamp, description, session_id, dedupe_key"
COUNTERS = (
    "count(*) AS event_count, max(timestamp) AS last_event, count(*) FILTER (WHERE event_type = 'command') AS command_count, count(*) FILTER (WHERE event_type = 'login_attempt') AS login_attempts, "
    "count(*) FILTER (WHERE event_type = 'login_success') AS login_successes, count(*) FILTER (WHERE event_type = 'file_download') AS download_count"
)


def secs(stamp: str) -> str:
    return f"epoch(strptime({stamp}, '%Y-%m-%dT%H:%M:%SZ'))::BIGINT"


def bucket(stamp: str) -> str:
    return f"substr({stamp}, 1, 10) || '#' || ((substr({stamp}, 12, 2)::INT * 60 + substr({stamp}, 15, 2)::INT) // {DEFAULT.window_minutes})::VARCHAR"


def classified(command: str, what: int) -> str:
    """Severity (1) or label (2) of the first pattern that matches."""
    return "CASE " + " ".join(f"WHEN regexp_matches({command}, '{row[0]}', 'i') THEN '{row[what]}'" for row in COMMAND_PATTERNS) + " END"


def field(name: str) -> str:
    return f"json_extract_string(details, '$.{name}')"


def uuid5(name: str) -> str:
    digest = f"sha1(unhex('{ID_NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {digest} AS h))"


_RECENT = f"attacker_ip IS NOT NULL AND timestamp >= '{SINCE}'"
_RULES = [
    f"""SELECT 'brute_force', attacker_ip, CASE WHEN n >= 20 THEN 'high' ELSE 'medium' END, ts, n || ' failed login attempts from ' || attacker_ip || ' across ' || nodes || ' node(s) within 5 minutes', NULL, 'brute_force|' || attacker_ip || '|' || {bucket("ts")}
      FROM (SELECT attacker_ip, count(*) AS n, count(DISTINCT node_id) AS nodes, max(timestamp) AS ts FROM ev WHERE event_type = 'login_attempt' AND {_RECENT} GROUP BY 1) WHERE n >= 5""",
    f"""SELECT 'credential_spray', attacker_ip, 'medium', ts, attacker_ip || ' tried ' || n || ' distinct usernames within 5 minutes', NULL, 'credential_spray|' || attacker_ip || '|' || {bucket("ts")}
      FROM (SELECT attacker_ip, count(DISTINCT {field("username")}) AS n, max(timestamp) AS ts FROM ev WHERE event_type IN ('login_attempt', 'login_success') AND {field("username")} IS NOT NULL AND {_RECENT} GROUP BY 1) WHERE n >= 5""",
    """SELECT 'high_risk_ip', attacker_ip, 'high', last_updated, attacker_ip || CASE WHEN coalesce(country, '') <> '' THEN ' (' || country || ')' ELSE '' END || ' flagged high risk: ' || concat_ws(' and ', CASE WHEN a >= 75 THEN 'AbuseIPDB score ' || a END, CASE WHEN p >= 75 THEN 'local profile score ' || p END), NULL,
      'high_risk_ip|' || attacker_ip || '|' || (a // 10) || '|' || (p // 10) FROM (SELECT *, coalesce(abuse_score, 0) AS a, coalesce(profile_score, 0) AS p FROM rep) WHERE a >= 75 OR p >= 75""",
    f"""SELECT 'suspicious_command', attacker_ip, level, timestamp, label || ' on ' || node_id || ': ' || substr(command, 1, 200), session_id, 'suspicious_command|' || event_id
      FROM (SELECT *, {field("command")} AS command, {classified(field("command"), 1)} AS level, {classified(field("command"), 2)} AS label FROM ev WHERE event_type = 'command' AND {_RECENT}) WHERE level IS NOT NULL""",
    f"""SELECT 'malware_staging', attacker_ip, 'high', timestamp, 'payload fetched on ' || node_id || ': ' || substr(coalesce(nullif({field("file_name")}, ''), nullif({field("download_url")}, ''), nullif({field("file_hash")}, ''), 'unknown artefact'), 1, 200), session_id, 'malware_staging|' || event_id
      FROM ev WHERE event_type = 'file_download' AND {_RECENT}""",
    f"""SELECT 'multi_node_scan', attacker_ip, CASE WHEN n = 2 THEN 'medium' ELSE 'high' END, ts, attacker_ip || ' observed on ' || n || ' separate sensors (' || list || ') — coordinated scanning', NULL, 'multi_node_scan|' || attacker_ip || '|' || n || '|' || {bucket("ts")}
      FROM (SELECT attacker_ip, count(DISTINCT node_id) AS n, string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS list, max(timestamp) AS ts FROM ev WHERE {_RECENT} GROUP BY 1) WHERE n >= 2""",
    f"""SELECT 'post_auth_activity', attacker_ip, 'high', ts, 'authenticated session ' || session_id || ' on ' || node_id || ' executed ' || n || ' command(s) after a successful login', session_id, 'post_auth_activity|' || session_id || '|' || n
      FROM (SELECT l.session_id, l.attacker_ip, l.node_id, count(c.event_id) AS n, max(c.timestamp) AS ts FROM ev l JOIN ev c ON c.session_id = l.session_id AND c.event_type = 'command' WHERE l.event_type = 'login_success' AND l.attacker_ip IS NOT NULL AND c.timestamp >= '{SINCE}' GROUP BY 1, 2, 3)""",
]
_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_ORDER = f"{_RANK} DESC, timestamp DESC, rule_order, dedupe_key DESC"
_QUIET = "alert_type IN ('suspicious_command', 'malware_staging')"
_ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("event_count", "session_count", "node_count", "login_attempts", "command_count", "download_count"))

#: Name of each table, its SQL, in an order in which each needs only those before it.
CTES = {
    "ev": DUCK_EVENTS,
    "rep": DUCK_REPUTATION,
    "findings": " UNION ALL ".join(f"SELECT {FINDING}, {k} AS rule_order FROM ({sql}) f({FINDING})" for k, sql in enumerate(_RULES)),
    "identified": f"SELECT *, {uuid5('dedupe_key')} AS alert_id FROM findings",
    "ranked": f"SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY {_ORDER}) = 1 AS cand, NOT {_QUIET} AND {secs(f"'{NOW}'")} - {secs('timestamp')} < 1800 AS fresh FROM identified",
    "passed": f"SELECT *, {_QUIET} OR NOT coalesce(bool_or(cand AND fresh) OVER (PARTITION BY attacker_ip, alert_type ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS clear FROM ranked",
    "alerts": "SELECT alert_id, attacker_ip, session_id, alert_type, severity, timestamp, description, CASE substr(alert_id, 36, 1) WHEN '0' THEN 'acknowledged' WHEN '1' THEN 'closed' ELSE 'open' END AS status FROM passed WHERE cand AND clear",
    "existing": "SELECT alert_id, attacker_ip, alert_type, timestamp, CASE WHEN substr(alert_id, 36, 1) IN ('2', '3') THEN 'open' ELSE 'closed' END AS status FROM identified WHERE substr(alert_id, 36, 1) IN ('2', '3', '4', '5')",
    "retried": f"SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY {_ORDER}) = 1 AND alert_id NOT IN (SELECT alert_id FROM existing) AS cand, NOT {_QUIET} AND {secs(f"'{NOW}'")} - {secs('timestamp')} < {COOLDOWN_MINUTES * 60} AS fresh FROM identified",
    "cooled": f"""SELECT *, {_QUIET} OR NOT (coalesce(bool_or(cand AND fresh) OVER (PARTITION BY attacker_ip, alert_type ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
      OR (attacker_ip, alert_type) IN (SELECT (attacker_ip, alert_type) FROM existing WHERE status = 'open' AND {secs(f"'{NOW}'")} - {secs('timestamp')} < {COOLDOWN_MINUTES * 60})) AS clear FROM retried""",
    "created": "SELECT alert_id, attacker_ip, session_id, alert_type, severity, timestamp, description, 'open' AS status FROM cooled WHERE cand AND clear",
    "summary": "SELECT attacker_ip, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS event_count, count(DISTINCT session_id) AS session_count, count(DISTINCT node_id) AS node_count, count(*) FILTER (WHERE event_type = 'login_attempt') AS login_attempts, "
    "count(*) FILTER (WHERE event_type = 'login_success') AS login_successes, count(*) FILTER (WHERE event_type = 'command') AS command_count, count(*) FILTER (WHERE event_type = 'file_download') AS download_count FROM ev WHERE attacker_ip IS NOT NULL GROUP BY 1",
    "sessions": f"""SELECT session_id, arg_min(node_id, seq) AS node_id, arg_min(attacker_ip, seq) FILTER (WHERE attacker_ip IS NOT NULL) AS attacker_ip, arg_min(protocol, seq) FILTER (WHERE protocol IS NOT NULL) AS protocol,
      arg_max({field("username")}, seq) FILTER (WHERE {field("username")} IS NOT NULL) AS username, arg_max({field("password")}, seq) FILTER (WHERE {field("password")} IS NOT NULL) AS password, min(timestamp) AS start_time,
      arg_max(timestamp, seq) FILTER (WHERE event_type = 'session_end') AS end_time, coalesce(arg_max(CASE WHEN {field("status")} IN ('failed', 'error') THEN 'failed' ELSE 'closed' END, seq) FILTER (WHERE event_type = 'session_end'), 'active') AS status
      FROM ev WHERE session_id IS NOT NULL GROUP BY 1""",
    "nodes": f"SELECT node_id, last_seen, CASE WHEN {secs(f"'{NOW}'")} - {secs('last_seen')} > 180 THEN 'offline' ELSE 'online' END AS status FROM (SELECT node_id, max(timestamp) AS last_seen FROM ev GROUP BY 1)",
    "stats": f"""SELECT n.*, events_total, sessions_total, attackers_total, last_event, last_heartbeat, avg_lag_seconds, max_lag_seconds, events_recent, attacks_recent, heartbeats_recent, coalesce(alerts_recent, 0) AS alerts_recent FROM nodes n
      JOIN (SELECT node_id, count(*) AS events_total, count(DISTINCT session_id) AS sessions_total, count(DISTINCT attacker_ip) AS attackers_total, max(timestamp) AS last_event, max(timestamp) FILTER (WHERE event_type = 'heartbeat') AS last_heartbeat,
        avg({secs("received_at")} - {secs("timestamp")}) AS avg_lag_seconds, max({secs("received_at")} - {secs("timestamp")}) AS max_lag_seconds, count(*) FILTER (WHERE timestamp >= '2024-01-30T00:00:00Z') AS events_recent,
        count(*) FILTER (WHERE timestamp >= '2024-01-30T00:00:00Z' AND event_type <> 'heartbeat') AS attacks_recent, count(*) FILTER (WHERE timestamp >= '2024-01-30T00:00:00Z' AND event_type = 'heartbeat') AS heartbeats_recent FROM ev GROUP BY 1) USING (node_id)
      LEFT JOIN (SELECT node_id, count(DISTINCT alert_id) AS alerts_recent FROM alerts a JOIN ev USING (session_id) WHERE a.timestamp >= '2024-01-30T00:00:00Z' GROUP BY 1) USING (node_id)""",
    "attackers": """SELECT s.*, country, city, latitude, longitude, abuse_score, profile_score, source AS reputation_source, last_updated AS reputation_updated, rep.attacker_ip IS NOT NULL AS enriched, coalesce(alert_count, 0) AS alert_count, coalesce(high_alerts, 0) AS high_alerts, coalesce(open_alerts, 0) AS open_alerts,
      greatest(coalesce(abuse_score, 0), coalesce(profile_score, 0)) AS risk_score FROM summary s LEFT JOIN rep ON rep.attacker_ip = s.attacker_ip
      LEFT JOIN (SELECT attacker_ip, count(*) AS alert_count, count(*) FILTER (WHERE severity = 'high') AS high_alerts, count(*) FILTER (WHERE status = 'open') AS open_alerts FROM alerts GROUP BY 1) a ON a.attacker_ip = s.attacker_ip""",
    "session_rows": f"""SELECT s.* REPLACE (CASE WHEN coalesce(password, '') <> '' THEN '***MASKED***' END AS password), country, city, abuse_score, profile_score, event_count, last_event, command_count, login_attempts, login_successes, download_count, {secs("end_time")} - {secs("start_time")} AS duration_seconds
      FROM sessions s LEFT JOIN rep USING (attacker_ip) LEFT JOIN (SELECT session_id, {COUNTERS} FROM ev WHERE session_id IS NOT NULL GROUP BY 1) USING (session_id)""",
    "indicators": f"""SELECT *, CASE severity_rank WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, least(100, 50 + CASE WHEN coalesce(abuse_score, 0) >= 50 THEN 20 ELSE 0 END + CASE WHEN coalesce(profile_score, 0) >= 50 THEN 10 ELSE 0 END + CASE WHEN node_count >= 2 THEN 10 ELSE 0 END + CASE WHEN download_count > 0 THEN 10 ELSE 0 END + CASE WHEN command_count > 0 THEN 5 ELSE 0 END) AS confidence
      FROM (SELECT a.*, country, city, latitude, longitude, abuse_score, profile_score, source AS reputation_source, first_seen, last_seen, login_successes, {_ZERO}
        FROM (SELECT attacker_ip, count(alert_id) AS alert_count, string_agg(DISTINCT alert_type, ',' ORDER BY alert_type) AS alert_types, max({_RANK}) AS severity_rank, max(timestamp) AS latest_alert FROM alerts WHERE severity IN ('medium', 'high') AND status IN ('open', 'acknowledged') GROUP BY 1) a
        LEFT JOIN rep USING (attacker_ip) LEFT JOIN summary USING (attacker_ip))""",
    "feed_alerts": """SELECT alert_id, a.attacker_ip, session_id, alert_type, severity, timestamp, description, status, country, abuse_score, profile_score FROM (SELECT * FROM alerts WHERE severity IN ('medium', 'high') AND status IN ('open', 'acknowledged') ORDER BY timestamp DESC, alert_id LIMIT 10000) a LEFT JOIN rep USING (attacker_ip)""",
}


def query(sql: str) -> str:
    """sql with the tables of CTES that it needs put before it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(?<![\w.']){name}(?![\w'(])", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return f"WITH {', '.join(parts)} {sql.strip()}" if parts else sql
