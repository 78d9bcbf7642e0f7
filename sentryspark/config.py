"""Settings of the engine; every operator takes one as an argument and nothing reads a clock or the environment."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of the event contract.
EVENT_TYPES = ("heartbeat", "connection", "login_attempt", "login_success", "command", "file_download", "session_end")
PROTOCOLS = ("ssh", "telnet", "ftp", "smb", "http", "mysql", "mssql", "sip", "tftp", "upnp", "mqtt", "memcache", "mongo", "printer", "pptp", "epmap")
SEVERITIES = ("low", "medium", "high")
ALERT_STATUSES = ("open", "acknowledged", "closed")
MASK = "***MASKED***"
#: Namespace of the name-based ids of alerts and feed objects.
ID_NAMESPACE = "c35ac7c6-2707-528e-8e1e-398e87b6b396"
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@dataclass(frozen=True)
class Config:
    known_nodes: tuple[str, ...] = ("node-01", "node-02", "node-03")
    strict_nodes: bool = True
    schema_version: str = "1.3"
    heartbeat_seconds: int = 60
    offline_seconds: int = 180
    stale_session_seconds: int = 3600
    window_minutes: int = 5
    brute_force: int = 5
    credential_spray: int = 5
    high_risk: int = 75
    multi_node: int = 2
    cooldown_minutes: int = 30
    #: In the order in which rules run; unknown names are ignored.
    enabled_rules: tuple[str, ...] = ("brute_force", "credential_spray", "high_risk_ip", "suspicious_command", "malware_staging", "multi_node_scan", "post_auth_activity")
    #: Rules whose findings are one per event and never cool down.
    no_cooldown: tuple[str, ...] = ("suspicious_command", "malware_staging")
    feed_severity: str = "medium"
    feed_statuses: tuple[str, ...] = ("open", "acknowledged")
    feed_name: str = "Decoy sensor threat feed"
    feed_producer: str = "sentryspark"
    feed_notice: str = "Attempted credentials are masked. Indicators are observations of decoy sensors; corroborate them before blocking."
    feed_alerts: int = 10_000
    missed_warning: int = 2
    missed_critical: int = 5
    map_origins: int = 150
    map_paths: int = 200


DEFAULT = Config()
