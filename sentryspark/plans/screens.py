"""Composite reads: what one screen or command needs, as named DataFrames that share their inputs.

Nothing runs until a DataFrame is used. `t` is anything with the attributes events, sessions, nodes, alerts
and reputation, such as catalogue.Tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentryspark.config import DEFAULT, Config
from sentryspark.functions.scalar import COMMAND_PATTERNS, seconds, stamp_of
from sentryspark.operators import feed, ingest, rollups, rules, search
from sentryspark.sources.tables import stored

Frames = dict[str, DataFrame]
#: Seconds of the windows that a reader may choose; `all` has none.
WINDOWS = {"1h": 3600, "6h": 21_600, "24h": 86_400, "7d": 604_800, "30d": 2_592_000, "all": None}


def since_of(spark, window: str, now: str) -> str:
    """The time at which a window begins that ends at `now`; unknown windows are a day, `all` begins before everything."""
    length = WINDOWS.get(window, WINDOWS["24h"])
    if length is None:
        return ""
    return spark.range(1).select(stamp_of(seconds(F.lit(now)) - length).alias("since")).first()["since"]


def overview(t, now: str, hour: str, day: str) -> Frames:
    statistics = rollups.node_statistics(t.nodes, t.events, t.alerts, day)
    return {
        "counters": rollups.overview(t.events, t.sessions, t.nodes, t.alerts, t.reputation, hour, day), "activity": rollups.filled(rollups.activity(t.events, day), day, now), "nodes": rollups.node_health(statistics, now),
        "origins": rollups.attack_origins(t.events, t.reputation, day), "paths": rollups.attack_paths(t.events, t.reputation, day), "extent": rollups.attack_extent(t.events, t.reputation), "severities": rollups.severity_counts(t.alerts, "open"),
        "types": rollups.counts_of(t.events, "event_type", day), "attackers": rollups.top_attackers(t.events, t.reputation, 8), "credentials": rollups.top_credentials(t.events, 8), "commands": rollups.top_commands(t.events, 8),
        "countries": rollups.top_countries(t.events, t.reputation, 6), "alerts": search.search_alerts(t.alerts, t.reputation, {"status": "open"}, limit=8)[0],
    }


def attacker_list(t, filters: dict, sort: str | None = None, page: int = 1, per_page: int = 50) -> Frames:
    limit, offset = search.clamped(page, per_page)
    return {"rows": search.search_attackers(t.events, t.reputation, t.alerts, filters, sort, limit, offset)[0], "countries": rollups.vocabulary(t.reputation, "country"), "nodes": t.nodes.select("node_id").orderBy("node_id")}


def attacker_profile(t, ip: str, since: str) -> Frames:
    """All about one address. `summary` falls back to the reputation row of an address without events, and is empty if there is neither."""
    mine = lambda rows: rows.where(F.col("attacker_ip") == ip)
    known = mine(t.reputation)
    seen = search.attackers(mine(t.events), known, mine(t.alerts))
    only = known.join(seen.select("attacker_ip"), "attacker_ip", "left_anti").withColumnsRenamed({"source": "reputation_source", "last_updated": "reputation_updated"})
    return {
        "summary": seen.unionByName(only, allowMissingColumns=True), "commands": rollups.commands_of(t.events, ip), "usernames": rollups.usernames_of(t.events, ip), "nodes": rollups.nodes_of(t.events, ip), "days": rollups.daily_of(t.events, ip, since),
        "sessions": search.search_sessions(mine(t.sessions), mine(t.events), known, {"ip": ip}, limit=25)[0], "alerts": search.search_alerts(mine(t.alerts), known, {"ip": ip})[0], "events": search.events_of(t.events, ip),
    }


def session_detail(t, session_id: str) -> Frames:
    own = t.events.where(F.col("session_id") == session_id)
    mine = t.sessions.where(F.col("session_id") == session_id)
    return {
        "session": search.session_rows(mine, own, t.reputation), "transcript": search.transcript(t.events, session_id).orderBy("line"), "counts": search.transcript_counts(own),
        "alerts": t.alerts.where(F.col("session_id") == session_id).orderBy("timestamp", "alert_id"), "neighbours": search.adjacent_sessions(t.sessions.join(mine.select("attacker_ip"), "attacker_ip", "left_semi")).where(F.col("session_id") == session_id),
    }


def alerts_screen(t, filters: dict, sort: str | None = None, page: int = 1, per_page: int = 50, config: Config = DEFAULT) -> Frames:
    limit, offset = search.clamped(page, per_page)
    return {
        "rows": search.search_alerts(t.alerts, t.reputation, filters, sort, limit, offset)[0], "severities": rollups.severity_counts(t.alerts), "statuses": rollups.status_counts(t.alerts),
        "types": rollups.alert_type_stats(t.alerts), "rules": rule_catalogue(t.events.sparkSession, config), "patterns": command_patterns(t.events.sparkSession),
    }


def nodes_screen(t, now: str, since: str) -> Frames:
    statistics = rollups.node_statistics(t.nodes, t.events, t.alerts, since)
    hours = t.events.where(F.col("timestamp") >= since).groupBy("node_id", F.substring("timestamp", 1, 13).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return {"statistics": statistics, "health": rollups.node_health(statistics, now), "hours": hours, "peak": hours.agg(F.max("n").alias("peak"))}


def map_screen(t, since: str, sensors: dict[str, tuple[float, float]], config: Config = DEFAULT) -> Frames:
    """Origins and arcs of a window, and how many drawable events lie outside it."""
    origins = rollups.map_marks(rollups.attack_origins(t.events, t.reputation, since, config.map_origins + 1), config.map_origins)
    paths = rollups.attack_paths(t.events, t.reputation, since, config.map_paths)
    nodes = t.nodes if "location" in t.nodes.columns else t.nodes.withColumn("location", F.lit(None).cast("string"))
    placed = rollups.placed_nodes(nodes, sensors)
    whole, part = (rollups.attack_extent(t.events, t.reputation, x).select(F.col("events").alias(n)) for x, n in ((None, "whole"), (since, "part")))
    outside = whole.crossJoin(F.broadcast(part)).select(F.greatest(F.lit(0).cast("long"), F.col("whole") - F.col("part")).alias("outside_window"))  # one row each
    return {"origins": origins, "arcs": rollups.map_arcs(paths, origins, placed), "totals": rollups.map_totals(paths), "unknown": rollups.unknown_nodes(paths, nodes), "unplaced": placed.where("latitude is null").select("node_id"), "outside": outside}


def feed_preview(t, now: str, config: Config = DEFAULT, **filters) -> Frames:
    flat, alerts = feed.filtered(feed.indicators(t.events, t.alerts, t.reputation, config=config), feed.feed_alerts(t.alerts, t.reputation, config=config), **filters)
    return {"indicators": flat, "alerts": alerts, "document": feed.feed_document(flat, alerts, now, config=config), "stix": feed.stix_objects(flat, now, config)}


def statistics(t, hour: str, day: str) -> Frames:
    return {
        "counters": rollups.overview(t.events, t.sessions, t.nodes, t.alerts, t.reputation, hour, day), "nodes": t.nodes.orderBy("node_id"),
        "attackers": rollups.top_attackers(t.events, t.reputation, 5), "credentials": rollups.top_credentials(t.events, 5),
    }


def cycle(t, since: str, now: str, path: str, config: Config = DEFAULT) -> Frames:
    """One pass: nodes and sessions that went stale, new alerts, and the feed written below path."""
    nodes = ingest.with_stale_nodes_offline(t.nodes, now, config)
    sessions = ingest.closed_stale_sessions(t.sessions, t.events, now, config)
    findings = stored(rules.evaluated(t.events, t.reputation, since, config), "findings")
    fresh = stored(rules.new_alerts(findings, now, t.alerts, config), "new-alerts")
    alerts = t.alerts.unionByName(fresh)
    # the feed is written in five forms, each of which would go through the log again
    flat, fired = stored(feed.indicators(t.events, alerts, t.reputation, config=config), "indicators"), stored(feed.feed_alerts(alerts, t.reputation, config=config), "feed-alerts")
    feed.write_feed(flat, fired, path, now, config)
    return {"nodes": nodes, "sessions": sessions, "alerts": fresh, "summary": rules.pass_summary(findings, fresh)}


def health_tallies(t, now: str, since: str) -> DataFrame:
    """(health, n)"""
    return rollups.node_health(rollups.node_statistics(t.nodes, t.events, t.alerts, since), now).groupBy("health").agg(F.count(F.lit(1)).alias("n"))


def rule_catalogue(spark, config: Config = DEFAULT) -> DataFrame:
    """(rule, enabled, threshold, window_minutes), enabled ones first."""
    thresholds = {"brute_force": config.brute_force, "credential_spray": config.credential_spray, "high_risk_ip": config.high_risk, "multi_node_scan": config.multi_node}
    rows = [(name, name in config.enabled_rules, thresholds.get(name), config.window_minutes) for name in rules.RULES]
    return spark.createDataFrame(rows, "rule string, enabled boolean, threshold int, window_minutes int").orderBy(F.desc("enabled"), "rule")


def command_patterns(spark) -> DataFrame:
    return spark.createDataFrame([(k, p, level, label) for k, (p, level, label) in enumerate(COMMAND_PATTERNS)], "position int, pattern string, severity string, label string")


def dossier(t, ip: str, now: str) -> Frames:
    """One address as a JSON document without secrets, and as a flat row with reputation_ columns."""
    profile = attacker_profile(t, ip, "")
    lists = [profile[k].agg(F.collect_list(F.struct(*profile[k].columns)).alias(k)) for k in ("commands", "usernames", "nodes", "sessions", "alerts")]
    whole = profile["summary"].select(F.struct(*profile["summary"].columns).alias("summary"))
    for part in lists:  # one row each, of lists that have limits of their own
        whole = whole.crossJoin(F.broadcast(part))
    body = feed.scrubbed(whole.withColumn("generated_at", F.lit(now)))
    reputation = t.reputation.where(F.col("attacker_ip") == ip)
    flat = rollups.attacker_summary(t.events.where(F.col("attacker_ip") == ip)).join(reputation.select("attacker_ip", *(F.col(c).alias(f"reputation_{c}") for c in reputation.columns if c != "attacker_ip")), "attacker_ip", "full")
    return {"json": body.select(feed.checked(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("json")), "csv": flat}
