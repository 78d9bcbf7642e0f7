"""Explicit schemas of the five tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in columns.items()])


S, D, I, L = StringType, DoubleType, IntegerType, LongType
#: seq is the order of arrival, which the session fold depends on.
EVENTS = _table(seq=L, event_id=S, node_id=S, session_id=S, event_type=S, timestamp=S, attacker_ip=S, protocol=S, details=S, received_at=S)
SESSIONS = _table(session_id=S, node_id=S, attacker_ip=S, protocol=S, username=S, password=S, start_time=S, end_time=S, status=S)
NODES = _table(node_id=S, hostname=S, location=S, ip_address=S, status=S, last_seen=S)
REPUTATION = _table(attacker_ip=S, country=S, city=S, latitude=D, longitude=D, abuse_score=I, source=S, profile_score=I, last_updated=S)
ALERTS = _table(alert_id=S, attacker_ip=S, session_id=S, alert_type=S, severity=S, timestamp=S, description=S, status=S)
TABLES = {"events": EVENTS, "sessions": SESSIONS, "nodes": NODES, "reputation": REPUTATION, "alerts": ALERTS}
