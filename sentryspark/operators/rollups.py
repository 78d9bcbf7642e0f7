"""Views, rollups and time series over the tables.

Counters over one table come from one conditional aggregation, never from one query each; joins are
on pre-aggregated sides. Distinct counts are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentryspark.config import ALERT_STATUSES, DEFAULT, SEVERITIES, Config
from sentryspark.functions.scalar import coordinates, field, marker_radius, masked, percent, projected, rank, risk, score_band, seconds, stamp_of


def _n(condition=None):
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def _since(rows: DataFrame, since: str | None, column: str = "timestamp") -> DataFrame:
    return rows if since is None else rows.where(F.col(column) >= since)


def _kind(name: str):
    return F.col("event_type") == name


# -- views ------------------------------------------------------------------


def commands(events: DataFrame) -> DataFrame:
    return events.where(_kind("command")).select("event_id", "node_id", "session_id", "attacker_ip", "timestamp", field("command").alias("command"))


def public_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("password", masked(F.col("password")))


def attacker_summary(events: DataFrame) -> DataFrame:
    """One row per address: first and last time, events, sessions, nodes, and events of four kinds."""
    return (
        events.where("attacker_ip is not null")
        .groupBy("attacker_ip")
        .agg(
            F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), _n().alias("event_count"),
            F.count_distinct("session_id").alias("session_count"), F.count_distinct("node_id").alias("node_count"),
            _n(_kind("login_attempt")).alias("login_attempts"), _n(_kind("login_success")).alias("login_successes"), _n(_kind("command")).alias("command_count"), _n(_kind("file_download")).alias("download_count"),
        )
    )


def session_counters(events: DataFrame) -> DataFrame:
    return (
        events.where("session_id is not null")
        .groupBy("session_id")
        .agg(
            _n().alias("event_count"), F.max("timestamp").alias("last_event"), _n(_kind("command")).alias("command_count"), _n(_kind("login_attempt")).alias("login_attempts"),
            _n(_kind("login_success")).alias("login_successes"), _n(_kind("file_download")).alias("download_count"),
        )
    )


# -- activity ---------------------------------------------------------------

_WIDTH = {"hour": 13, "day": 10}


def activity(events: DataFrame, since: str, by: str = "hour") -> DataFrame:
    """(bucket, total, attacks, logins, commands, ips); buckets are prefixes of the time."""
    return (
        _since(events, since)
        .groupBy(F.substring("timestamp", 1, _WIDTH[by]).alias("bucket"))
        .agg(_n().alias("total"), _n(~_kind("heartbeat")).alias("attacks"), _n(_kind("login_attempt")).alias("logins"), _n(_kind("command")).alias("commands"), F.count_distinct("attacker_ip").alias("ips"))
    )


def filled(counts: DataFrame, since: str, now: str, by: str = "hour") -> DataFrame:
    """counts (bucket, ...) with zeroes for the buckets from `since` to `now` that have no row."""
    step = 3600 if by == "hour" else 86400
    spark = counts.sparkSession
    whole = lambda x: F.floor(seconds(F.lit(x)) / step) * step
    spine = spark.range(1).select(F.explode(F.sequence(whole(since), whole(now), F.lit(step).cast("long"))).alias("at")).select(F.substring(stamp_of(F.col("at")), 1, _WIDTH[by]).alias("bucket"))
    out = spine.join(counts, "bucket", "left")
    return out.select("bucket", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts.columns if c != "bucket"))


def counts_of(rows: DataFrame, column: str, since: str | None = None) -> DataFrame:
    """(column, n)"""
    return _since(rows, since).groupBy(column).agg(_n().alias("n"))


def filled_counts(alerts: DataFrame, column: str, values: tuple[str, ...], status: str | None = None) -> DataFrame:
    """(column, n) for each of values, those without a row included."""
    rows = alerts if status is None else alerts.where(F.col("status") == status)
    found = rows.groupBy(column).agg(_n().alias("n"))
    spine = alerts.sparkSession.range(1).select(F.explode(F.array(*(F.lit(x) for x in values))).alias(column))
    return spine.join(found, column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def severity_counts(alerts: DataFrame, status: str | None = None) -> DataFrame:
    return filled_counts(alerts, "severity", SEVERITIES, status)


def status_counts(alerts: DataFrame) -> DataFrame:
    return filled_counts(alerts, "status", ALERT_STATUSES)


def alert_type_stats(alerts: DataFrame, since: str | None = None) -> DataFrame:
    return (
        _since(alerts, since)
        .groupBy("alert_type")
        .agg(_n().alias("total"), _n(F.col("status") == "open").alias("open_count"), _n(F.col("severity") == "high").alias("high_count"), F.count_distinct("attacker_ip").alias("distinct_ips"), F.max("timestamp").alias("last_fired"))
    )


# -- top lists --------------------------------------------------------------


def top_commands(events: DataFrame, limit: int = 10, since: str | None = None) -> DataFrame:
    rows = _since(commands(events), since).where("command is not null").groupBy("command").agg(_n().alias("attempts"), F.count_distinct("attacker_ip").alias("distinct_ips"), F.max("timestamp").alias("last_seen"))
    return rows.orderBy(F.desc("attempts"), "command").limit(limit)


def top_credentials(events: DataFrame, limit: int = 20) -> DataFrame:
    """User names only; passwords never leave the log."""
    rows = events.where(F.col("event_type").isin("login_attempt", "login_success")).withColumn("username", field("username")).where("username is not null")
    return rows.groupBy("username").agg(_n().alias("attempts"), F.count_distinct("attacker_ip").alias("distinct_ips")).orderBy(F.desc("attempts"), "username").limit(limit)


def top_countries(events: DataFrame, reputation: DataFrame, limit: int = 8) -> DataFrame:
    placed = reputation.where("country is not null and country <> ''").select("attacker_ip", "country")
    rows = placed.join(attacker_summary(events), "attacker_ip").groupBy("country").agg(_n().alias("ips"), F.sum("event_count").alias("events"))
    return rows.orderBy(F.desc("events"), "country").limit(limit)


def top_attackers(events: DataFrame, reputation: DataFrame, limit: int = 20) -> DataFrame:
    top = attacker_summary(events).orderBy(F.desc("event_count"), "attacker_ip").limit(limit)
    return top.join(reputation.select("attacker_ip", "country", "city", "latitude", "longitude", "abuse_score", "profile_score"), "attacker_ip", "left").orderBy(F.desc("event_count"), "attacker_ip")


# -- one address ------------------------------------------------------------


def commands_of(events: DataFrame, ip: str, limit: int = 25) -> DataFrame:
    rows = commands(events.where(F.col("attacker_ip") == ip)).where("command is not null").groupBy("command").agg(_n().alias("times"), F.max("timestamp").alias("last_seen"))
    return rows.orderBy(F.desc("times"), F.desc("last_seen"), "command").limit(limit)


def usernames_of(events: DataFrame, ip: str, limit: int = 15) -> DataFrame:
    rows = events.where((F.col("attacker_ip") == ip) & F.col("event_type").isin("login_attempt", "login_success")).withColumn("username", field("username")).where("username is not null")
    return rows.groupBy("username").agg(_n().alias("attempts"), _n(_kind("login_success")).alias("successes")).orderBy(F.desc("attempts"), "username").limit(limit)


def nodes_of(events: DataFrame, ip: str) -> DataFrame:
    return events.where(F.col("attacker_ip") == ip).groupBy("node_id").agg(_n().alias("events"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def daily_of(events: DataFrame, ip: str, since: str) -> DataFrame:
    return _since(events.where(F.col("attacker_ip") == ip), since).groupBy(F.substring("timestamp", 1, 10).alias("day")).agg(_n().alias("n"))


def hourly_of_node(events: DataFrame, node: str, since: str) -> DataFrame:
    return _since(events.where(F.col("node_id") == node), since).groupBy(F.substring("timestamp", 1, 13).alias("bucket")).agg(_n().alias("n"))


# -- map --------------------------------------------------------------------


def _places(reputation: DataFrame, *columns: str) -> DataFrame:
    return reputation.where("latitude is not null and longitude is not null").select("attacker_ip", *columns)


def attack_origins(events: DataFrame, reputation: DataFrame, since: str | None = None, limit: int = 200) -> DataFrame:
    """Addresses with coordinates and what they did, busiest first."""
    own = (
        _since(events, since)
        .where("attacker_ip is not null")
        .groupBy("attacker_ip")
        .agg(_n().alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("node_id").alias("nodes"), _n(_kind("login_success")).alias("login_successes"), F.max("timestamp").alias("last_seen"))
    )
    where = _places(reputation, "country", "city", "latitude", "longitude", "abuse_score", "profile_score")
    return own.join(where, "attacker_ip").withColumn("risk_score", risk(F.col("abuse_score"), F.col("profile_score"))).orderBy(F.desc("events"), "attacker_ip").limit(limit)


def attack_paths(events: DataFrame, reputation: DataFrame, since: str | None = None, limit: int = 400) -> DataFrame:
    """(attacker_ip, node_id, events, last_seen) of addresses with coordinates, busiest first."""
    own = _since(events, since).where("attacker_ip is not null").groupBy("attacker_ip", "node_id").agg(_n().alias("events"), F.max("timestamp").alias("last_seen"))
    return own.join(_places(reputation), "attacker_ip").orderBy(F.desc("events"), "attacker_ip", "node_id").limit(limit)


def attack_extent(events: DataFrame, reputation: DataFrame, since: str | None = None) -> DataFrame:
    own = _since(events, since).where("attacker_ip is not null").groupBy("attacker_ip").agg(_n().alias("events"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    placed = own.join(_places(reputation), "attacker_ip")
    return placed.agg(F.coalesce(F.sum("events"), F.lit(0).cast("long")).alias("events"), F.count(F.lit(1)).alias("origins"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def placed_nodes(nodes: DataFrame, configured: dict[str, tuple[float, float]]) -> DataFrame:
    """nodes with latitude and longitude: as configured, else read from `location`; null where neither has them."""
    lat, lon = coordinates(F.coalesce("location", F.lit("")))
    for node, (a, b) in configured.items():
        lat, lon = F.when(F.col("node_id") == node, F.lit(float(a))).otherwise(lat), F.when(F.col("node_id") == node, F.lit(float(b))).otherwise(lon)
    return nodes.withColumn("latitude", lat).withColumn("longitude", lon)


def map_arcs(paths: DataFrame, origins: DataFrame, sensors: DataFrame) -> DataFrame:
    """Paths between placed ends, with map positions of both."""
    x, y = projected(F.col("latitude"), F.col("longitude"))
    at = lambda rows, key, p: rows.where("latitude is not null and longitude is not null").select(key, x.alias(f"{p}_x"), y.alias(f"{p}_y"))
    return paths.join(at(origins, "attacker_ip", "origin"), "attacker_ip").join(at(sensors, "node_id", "sensor"), "node_id")


def map_marks(origins: DataFrame, limit: int) -> DataFrame:
    """The busiest `limit` of attack_origins() as marks: map position, radius against the busiest of them, score band, share of their events in percent, whether a login succeeded.

    origins should have up to limit + 1 rows: `truncated` says of all marks whether there are more than are drawn.
    """
    by = Window.orderBy(F.desc("events"), "attacker_ip")  # limit + 1 rows at most
    rows = origins.withColumn("place", F.row_number().over(by)).withColumn("truncated", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)
    whole = Window.partitionBy()
    x, y = projected(F.col("latitude"), F.col("longitude"))
    return rows.withColumns({
        "x": x, "y": y, "radius": marker_radius(F.col("events"), F.max("events").over(whole)), "band": score_band(F.col("risk_score")), "share": percent(F.col("events"), F.sum("events").over(whole)), "breached": F.col("login_successes") > 0,
    }).drop("place")


def unknown_nodes(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, events) of sensors that traffic names and the fleet doesn't have."""
    return paths.join(nodes.select("node_id"), "node_id", "left_anti").groupBy("node_id").agg(F.sum("events").alias("events"))


def map_totals(paths: DataFrame) -> DataFrame:
    """(node_id, events, attackers, share) of the paths given; share is of all their events, in percent."""
    own = paths.groupBy("node_id").agg(F.sum("events").alias("events"), F.count_distinct("attacker_ip").alias("attackers"))
    whole = own.agg(F.sum("events").alias("all"))
    return own.crossJoin(F.broadcast(whole)).select("node_id", "events", "attackers", F.round(F.col("events") * 100.0 / F.col("all"), 1).alias("share"))  # one row


# -- nodes ------------------------------------------------------------------


def lag(rows: DataFrame):
    return seconds(F.col("received_at")) - seconds(F.col("timestamp"))


def node_statistics(nodes: DataFrame, events: DataFrame, alerts: DataFrame, since: str) -> DataFrame:
    """Every node with its traffic, lag in seconds, and counters since `since`."""
    new, beat = F.col("timestamp") >= since, _kind("heartbeat")
    own = events.groupBy("node_id").agg(
        _n().alias("events_total"), F.count_distinct("session_id").alias("sessions_total"), F.count_distinct("attacker_ip").alias("attackers_total"), F.max("timestamp").alias("last_event"),
        F.max(F.when(beat, F.col("timestamp"))).alias("last_heartbeat"), F.avg(lag(events)).alias("avg_lag_seconds"), F.max(lag(events)).alias("max_lag_seconds"),
        _n(new).alias("events_recent"), _n(new & ~beat).alias("attacks_recent"), _n(new & beat).alias("heartbeats_recent"),
    )
    fired = _since(alerts, since).where("session_id is not null").select("alert_id", "session_id")
    # only the sessions of recent alerts, not those of all time, are made distinct
    touched = events.select("session_id", "node_id").join(fired.select("session_id").distinct(), "session_id", "left_semi").distinct()
    per = fired.join(touched, "session_id").groupBy("node_id").agg(F.count_distinct("alert_id").alias("alerts_recent"))
    out = nodes.join(own, "node_id", "left").join(per, "node_id", "left")
    zero = ["events_total", "sessions_total", "attackers_total", "events_recent", "attacks_recent", "heartbeats_recent", "alerts_recent"]
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero})


def node_health(statistics: DataFrame, now: str, config: Config = DEFAULT) -> DataFrame:
    """(node_id, reference, missed, health): how many heartbeats are missing at `now`."""
    last = F.greatest("last_seen", "last_event")
    missed = F.floor((seconds(F.lit(now)) - seconds(last)) / config.heartbeat_seconds)
    health = F.when(last.isNull(), "unknown").when(missed >= config.missed_critical, "critical").when(missed >= config.missed_warning, "warning").otherwise("healthy")
    return statistics.select("node_id", last.alias("reference"), missed.alias("missed"), health.alias("health"))


# -- overview ---------------------------------------------------------------


def ingest_lag(events: DataFrame, rows: int = 500) -> DataFrame:
    """Mean seconds between event and arrival of the rows that arrived last."""
    last = events.select("timestamp", "received_at", "seq").orderBy(F.desc("received_at"), F.desc("seq")).limit(rows)
    return last.agg(F.round(F.coalesce(F.avg(lag(last)), F.lit(0.0)), 2).alias("avg_ingest_lag_seconds"))


def overview(events: DataFrame, sessions: DataFrame, nodes: DataFrame, alerts: DataFrame, reputation: DataFrame, hour: str, window: str) -> DataFrame:
    """One row of headline counters; hour and window are the times since which recent rows count."""
    at = F.col("timestamp")
    parts = [
        events.agg(
            _n().alias("total_events"), _n(at >= hour).alias("events_last_hour"), _n(at >= window).alias("events_in_window"), _n((at >= window) & ~_kind("heartbeat")).alias("attacks_in_window"),
            F.count_distinct("attacker_ip").alias("unique_attackers"), F.count_distinct(F.when(at >= window, F.col("attacker_ip"))).alias("attackers_in_window"), F.max("timestamp").alias("latest_event"),
        ),
        sessions.agg(_n().alias("total_sessions"), _n(F.col("status") == "active").alias("active_sessions"), _n(F.col("start_time") >= window).alias("sessions_in_window")),
        nodes.agg(_n(F.col("status") == "online").alias("nodes_online"), _n().alias("nodes_total")),
        alerts.agg(_n(F.col("status") == "open").alias("open_alerts"), _n((F.col("status") == "open") & (F.col("severity") == "high")).alias("open_high_alerts"), _n(at >= window).alias("alerts_in_window")),
        reputation.agg(_n().alias("enriched_ips"), _n(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("placed_ips")),
        ingest_lag(events),
    ]
    out = parts[0]
    for part in parts[1:]:  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out.withColumn("nodes_stale", F.greatest(F.lit(0).cast("long"), F.col("nodes_total") - F.col("nodes_online")))


# -- vocabularies -----------------------------------------------------------


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.coalesce(column, F.lit("")) != "").select(column).distinct().orderBy(column)


def severity_ranked(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("severity_rank", rank(F.col("severity")))
