"""Searches over addresses, sessions and alerts: filters, whitelisted orders, pages; and lists for one key.

A filter dictionary becomes a conjunction of columns; keys that aren't known are ignored, an unknown order is the
default one. Every order ends with the key, so pages are stable.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentryspark.config import SEVERITIES
from sentryspark.functions.scalar import at_least, classified, contains, field, first_pattern, once, rank, risk, seconds
from sentryspark.operators.rollups import attacker_summary, public_sessions, session_counters
from sentryspark.sources.tables import stored

Filters = dict[str, object]


def _text(filters: Filters, key: str) -> str:
    return str(filters.get(key) or "").strip()


def _where(rows: DataFrame, conditions: list[Column]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def _like(filters: Filters, *columns: str) -> list[Column]:
    query = _text(filters, "q")
    return [reduce(lambda a, b: a | b, (F.coalesce(contains(F.col(c), query), F.lit(False)) for c in columns))] if query else []


def _equal(filters: Filters, **columns: str) -> list[Column]:
    return [F.col(c) == _text(filters, key) for key, c in columns.items() if _text(filters, key)]


def page(rows: DataFrame, orders: dict[str, list[str]], sort: str | None, default: str, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    by = [F.desc(x[1:]) if x.startswith("-") else F.asc(x) for x in orders.get(sort or default, orders[default])]
    return rows.orderBy(*by, F.asc(key)).offset(max(0, offset)).limit(limit)


def clamped(page_number: int, per_page: int) -> tuple[int, int]:
    """(limit, offset) of a page; numbers out of range are moved into it."""
    size = min(500, max(10, per_page))
    return size, (max(1, page_number) - 1) * size


def pages(total: int, page_number: int, per_page: int) -> dict[str, object]:
    count = max(1, -(-total // per_page))
    now = min(max(1, page_number), count)
    return {"page": now, "pages": count, "has_prev": now > 1, "has_next": now < count, "first": (now - 1) * per_page + 1 if total else 0, "last": min(total, now * per_page)}


# -- addresses --------------------------------------------------------------


def attackers(events: DataFrame, reputation: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per address: summary, reputation, alert counts, risk score."""
    fired = alerts.groupBy("attacker_ip").agg(F.count(F.lit(1)).alias("alert_count"), F.count_if(F.col("severity") == "high").alias("high_alerts"), F.count_if(F.col("status") == "open").alias("open_alerts"))
    known = reputation.select(
        "attacker_ip", "country", "city", "latitude", "longitude", "abuse_score", "profile_score", F.col("source").alias("reputation_source"), F.col("last_updated").alias("reputation_updated"), F.lit(True).alias("enriched")
    )
    rows = attacker_summary(events).join(known, "attacker_ip", "left").join(fired, "attacker_ip", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("alert_count", "high_alerts", "open_alerts")})
    return rows.withColumn("enriched", F.coalesce("enriched", F.lit(False))).withColumn("risk_score", risk(F.col("abuse_score"), F.col("profile_score")))


#: Orders by name; a minus sign means descending.
ATTACKER_ORDERS = {
    "last_seen": ["-last_seen"], "first_seen": ["-first_seen"], "events": ["-event_count"], "sessions": ["-session_count"], "logins": ["-login_attempts"], "commands": ["-command_count"],
    "downloads": ["-download_count"], "nodes": ["-node_count"], "score": ["-risk_score", "-event_count"], "alerts": ["-alert_count", "-event_count"], "ip": [],
}


def matching_attackers(rows: DataFrame, filters: Filters, events: DataFrame) -> DataFrame:
    """Filters: q, country, min_score, alerts_only, high_only, breached_only, enriched (yes or no), since, node."""
    flags = {"alerts_only": F.col("alert_count") > 0, "high_only": F.col("high_alerts") > 0, "breached_only": F.col("login_successes") > 0}
    conditions = _like(filters, "attacker_ip", "country", "city") + _equal(filters, country="country") + [c for k, c in flags.items() if filters.get(k)]
    if filters.get("min_score"):
        conditions.append(F.col("risk_score") >= int(str(filters["min_score"])))
    if filters.get("enriched") in ("yes", "no"):
        conditions.append(F.col("enriched") == (filters["enriched"] == "yes"))
    if filters.get("since"):
        conditions.append(F.col("last_seen") >= str(filters["since"]))
    out = _where(rows, conditions)
    if _text(filters, "node"):
        out = out.join(events.where(F.col("node_id") == _text(filters, "node")).select("attacker_ip").distinct(), "attacker_ip", "left_semi")
    return out


def search_attackers(events, reputation, alerts, filters: Filters | None = None, sort: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, Callable[[], int]]:
    """A page, and a function that counts all matching rows."""
    found = matching_attackers(attackers(events, reputation, alerts), filters or {}, events)
    return page(found, ATTACKER_ORDERS, sort, "last_seen", "attacker_ip", limit, offset), found.count


# -- sessions ---------------------------------------------------------------


def session_rows(sessions: DataFrame, events: DataFrame, reputation: DataFrame) -> DataFrame:
    """Sessions with masked password, reputation, counters and duration in whole seconds."""
    rows = public_sessions(sessions).join(reputation.select("attacker_ip", "country", "city", "abuse_score", "profile_score"), "attacker_ip", "left").join(session_counters(events), "session_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("event_count", "command_count", "login_attempts", "login_successes", "download_count")})
    return rows.withColumn("duration_seconds", seconds(F.col("end_time")) - seconds(F.col("start_time")))


SESSION_ORDERS = {"start_time": ["-start_time"], "duration": ["-duration_seconds"], "events": ["-event_count"], "commands": ["-command_count"], "logins": ["-login_attempts"], "ip": ["attacker_ip"], "node": ["node_id", "-start_time"]}


def matching_sessions(rows: DataFrame, filters: Filters) -> DataFrame:
    """Filters: q, status, node, protocol, ip, breached_only, commands_only, since."""
    conditions = _like(filters, "session_id", "attacker_ip", "username") + _equal(filters, status="status", node="node_id", protocol="protocol", ip="attacker_ip")
    flags = {"breached_only": F.col("login_successes") > 0, "commands_only": F.col("command_count") > 0}
    conditions += [c for k, c in flags.items() if filters.get(k)]
    if filters.get("since"):
        conditions.append(F.col("start_time") >= str(filters["since"]))
    return _where(rows, conditions)


def search_sessions(sessions, events, reputation, filters: Filters | None = None, sort: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, Callable[[], int]]:
    found = matching_sessions(session_rows(sessions, events, reputation), filters or {})
    return page(found, SESSION_ORDERS, sort, "start_time", "session_id", limit, offset), found.count


def transcript(events: DataFrame, session_id: str | None = None) -> DataFrame:
    """Events of a session, or of all, for reading: whether a password was given, never which; the gap to the line before if it is a minute or more."""
    rows = events.where("session_id is not null") if session_id is None else events.where(F.col("session_id") == session_id)
    keys = ["username", "command", "download_url", "file_name", "file_hash", "status", "duration_seconds", "destination_ip", "destination_port", "source_port", "agent_version"]
    head = ["session_id", "event_id", "event_type", "timestamp", "node_id", "attacker_ip", "protocol"]
    line = Window.partitionBy("session_id").orderBy("timestamp", "received_at", "seq")
    at = seconds(F.col("timestamp"))
    gap = at - F.last(at, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select(*head, "received_at", "seq", once(F.from_json("details", "map<string,string>")).alias("own"))
    rows = rows.select("*", once(first_pattern(F.element_at("own", F.lit("command")))).alias("place"))
    severity, label = classified(F.col("place"))
    value = lambda k: F.element_at("own", F.lit(k))
    return rows.select(
        *head, *(value(k).alias(k) for k in keys),
        F.when(value("password").isNull(), 0).otherwise(1).alias("had_password"), F.when(gap >= 60, gap).alias("gap_seconds"), F.row_number().over(line).cast("long").alias("line"), severity.alias("risk"), label.alias("risk_label"),
    )


def transcript_counts(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.where("session_id is not null").groupBy("session_id").agg(
        F.count_if(kind == "login_attempt").alias("failed_logins"), F.count_if(kind == "login_success").alias("successes"), F.count_if(kind == "command").alias("commands"), F.count_if(kind == "file_download").alias("downloads")
    )


def adjacent_sessions(sessions: DataFrame) -> DataFrame:
    """(session_id, prev, next, position, sessions) among those of the same address, newest first.

    Sessions are dealt by ranges of address and time, so one address's lie in as many partitions as its size asks for, and each partition is looked at alone.
    What crosses borders is small: of each partition the number of its rows and the border ids of its first and its last address, from which every
    address that lies across them gets the places and neighbours of its parts.
    """
    rows = sessions.where("attacker_ip is not null").select("session_id", "attacker_ip", F.coalesce("start_time", F.lit("")).alias("at"))
    rows = stored(rows.repartitionByRange("attacker_ip", F.desc("at"), "session_id").withColumn("part", F.spark_partition_id()), "session-ranges")
    line = Window.partitionBy("part", "attacker_ip").orderBy(F.desc("at"), "session_id")
    own = rows.select("*", F.lag("session_id").over(line).alias("before"), F.lead("session_id").over(line).alias("after"), F.row_number().over(line).cast("long").alias("place"), F.count(F.lit(1)).over(Window.partitionBy("part", "attacker_ip")).alias("n"))
    groups = own.groupBy("part", "attacker_ip").agg(F.max("n").alias("n"), F.max(F.when(F.col("place") == 1, F.col("session_id"))).alias("first"), F.max(F.when(F.col("place") == F.col("n"), F.col("session_id"))).alias("last"))
    ends = rows.groupBy("part").agg(F.min("attacker_ip").alias("least"), F.max("attacker_ip").alias("most"))
    # two rows a partition at most: only its first and last address can go on in another
    border = groups.join(F.broadcast(ends), "part").where((F.col("attacker_ip") == F.col("least")) | (F.col("attacker_ip") == F.col("most")))
    across, whole = Window.partitionBy("attacker_ip").orderBy("part"), Window.partitionBy("attacker_ip")
    carried = border.select(
        "part", "attacker_ip", F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("n").over(whole).alias("all"), F.lag("last").over(across).alias("from"), F.lead("first").over(across).alias("to"),
    )
    out = own.join(F.broadcast(carried), ["part", "attacker_ip"], "left")
    return out.select(
        "session_id", "attacker_ip", F.coalesce("before", F.when(F.col("place") == 1, F.col("from"))).alias("prev"), F.coalesce("after", F.when(F.col("place") == F.col("n"), F.col("to"))).alias("next"),
        (F.col("place") + F.coalesce("ahead", F.lit(0))).alias("position"), F.coalesce("all", "n").alias("sessions"),
    )


def events_of(events: DataFrame, ip: str, limit: int = 200) -> DataFrame:
    keys = ["username", "command", "file_name", "download_url", "status"]
    rows = events.where(F.col("attacker_ip") == ip).orderBy(F.desc("timestamp"), F.desc("seq")).limit(limit)
    return rows.select("event_id", "node_id", "session_id", "event_type", "timestamp", "protocol", *(field(k).alias(k) for k in keys))


# -- alerts -----------------------------------------------------------------


def alert_rows(alerts: DataFrame, reputation: DataFrame) -> DataFrame:
    return alerts.join(reputation.select("attacker_ip", "country", "city", "abuse_score", "profile_score"), "attacker_ip", "left").withColumn("severity_rank", rank(F.col("severity")))


ALERT_ORDERS = {"timestamp": ["-timestamp"], "severity": ["-severity_rank", "-timestamp"], "type": ["alert_type", "-timestamp"], "ip": ["attacker_ip", "-timestamp"], "status": ["status", "-timestamp"]}


def matching_alerts(rows: DataFrame, filters: Filters) -> DataFrame:
    """Filters: q, status, severity, type, ip, session, min_severity, since."""
    conditions = _like(filters, "attacker_ip", "description", "session_id", "alert_type") + _equal(filters, status="status", severity="severity", type="alert_type", ip="attacker_ip", session="session_id")
    if _text(filters, "min_severity") in SEVERITIES:
        conditions.append(at_least(F.col("severity"), _text(filters, "min_severity")))
    if filters.get("since"):
        conditions.append(F.col("timestamp") >= str(filters["since"]))
    return _where(rows, conditions)


def search_alerts(alerts, reputation, filters: Filters | None = None, sort: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, Callable[[], int]]:
    found = matching_alerts(alert_rows(alerts, reputation), filters or {})
    return page(found, ALERT_ORDERS, sort, "timestamp", "alert_id", limit, offset), found.count
