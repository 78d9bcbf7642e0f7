"""Detection rules over a rolling window, and what becomes of their findings.

Every rule gives the same columns, so a pass is a union. Findings get name-based ids; those known already,
repeated in the pass, or cooling down are dropped in closed form, by windows over an id and over an address and type, without a loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentryspark.config import DEFAULT, Config
from sentryspark.functions.scalar import bucket, classified, field, first_pattern, once, rank, seconds, stamp_of, uuid5

FINDING = ["alert_type", "attacker_ip", "severity", "timestamp", "description", "session_id", "dedupe_key"]
Rule = Callable[[DataFrame, DataFrame, str, Config], DataFrame]


def _findings(rows: DataFrame, kind: str, severity, stamp, text, key, session=None) -> DataFrame:
    session = F.lit(None).cast("string") if session is None else session
    return rows.select(
        F.lit(kind).alias("alert_type"), "attacker_ip", severity.alias("severity"), stamp.alias("timestamp"), text.alias("description"), session.alias("session_id"),
        F.concat_ws("|", F.lit(kind), *key).alias("dedupe_key"),
    )


def _in_window(events: DataFrame, since: str, *kinds: str) -> DataFrame:
    rows = events.where((F.col("timestamp") >= since) & F.col("attacker_ip").isNotNull())
    return rows.where(F.col("event_type").isin(*kinds)) if kinds else rows


def address_counters(events: DataFrame, since: str) -> DataFrame:
    """What the rules about addresses ask for, by one aggregation of the window; sets of sensors are as large as the fleet at most."""
    rows = _in_window(events, since)
    tried = F.col("event_type") == "login_attempt"
    named = F.when(F.col("event_type").isin("login_attempt", "login_success"), field("username"))
    return rows.withColumn("name", named).groupBy("attacker_ip").agg(
        F.count_if(tried).alias("attempts"), F.size(F.collect_set(F.when(tried, F.col("node_id")))).alias("tried_nodes"), F.max(F.when(tried, F.col("timestamp"))).alias("last_try"),
        F.count_distinct("name").alias("usernames"), F.max(F.when(F.col("name").isNotNull(), F.col("timestamp"))).alias("last_name"),
        F.array_sort(F.collect_set("node_id")).alias("nodes"), F.max("timestamp").alias("last_ts"),
    )


# The wording of descriptions, here and in the rules below.


def _brute_force(config: Config) -> tuple:
    text = F.format_string(f"%d failed login attempts from %s across %d node(s) within {config.window_minutes} minutes", "attempts", "attacker_ip", "tried_nodes")
    level = F.when(F.col("attempts") >= 4 * config.brute_force, "high").otherwise("medium")
    return F.col("attempts") >= config.brute_force, level, F.col("last_try"), text, [F.col("attacker_ip"), bucket(F.col("last_try"), config)]


def _credential_spray(config: Config) -> tuple:
    text = F.format_string(f"%s tried %d distinct usernames within {config.window_minutes} minutes", "attacker_ip", "usernames")
    return F.col("usernames") >= config.credential_spray, F.lit("medium"), F.col("last_name"), text, [F.col("attacker_ip"), bucket(F.col("last_name"), config)]


def _multi_node_scan(config: Config) -> tuple:
    n = F.size("nodes")
    text = F.format_string("%s observed on %d separate sensors (%s) — coordinated scanning", F.col("attacker_ip"), n, F.array_join("nodes", ","))
    return n >= config.multi_node, F.when(n == 2, "medium").otherwise("high"), F.col("last_ts"), text, [F.col("attacker_ip"), n.cast("string"), bucket(F.col("last_ts"), config)]


#: Rules over address_counters: condition, severity, time, description and key of a finding.
ADDRESS_RULES = {"brute_force": _brute_force, "credential_spray": _credential_spray, "multi_node_scan": _multi_node_scan}


def address_findings(events: DataFrame, since: str, config: Config, names: list[str]) -> DataFrame:
    """The findings of several rules about addresses, from one aggregation."""
    return findings_of(address_counters(events, since), config, names)


def findings_of(counters: DataFrame, config: Config, names: list[str]) -> DataFrame:
    """The findings of several rules about addresses, from address_counters() or what equals them."""
    made = []
    for name in names:
        holds, level, stamp, text, key = ADDRESS_RULES[name](config)
        made.append(F.when(holds, F.struct(F.lit(name).alias("alert_type"), level.alias("severity"), stamp.alias("timestamp"), text.alias("description"), F.concat_ws("|", F.lit(name), *key).alias("dedupe_key"))))
    rows = counters.select("attacker_ip", F.explode(F.array_compact(F.array(*made))).alias("found"))
    return rows.select("found.alert_type", "attacker_ip", "found.severity", "found.timestamp", "found.description", F.lit(None).cast("string").alias("session_id"), "found.dedupe_key")


def brute_force(events: DataFrame, reputation: DataFrame, since: str, config: Config = DEFAULT) -> DataFrame:
    """Many login attempts from one address."""
    return address_findings(events, since, config, ["brute_force"])


def credential_spray(events: DataFrame, reputation: DataFrame, since: str, config: Config = DEFAULT) -> DataFrame:
    """Many different user names from one address."""
    return address_findings(events, since, config, ["credential_spray"])


def high_risk_ip(events: DataFrame, reputation: DataFrame, since: str, config: Config = DEFAULT) -> DataFrame:
    """Addresses with a high score, whatever the window is."""
    abuse, profile = (F.coalesce(c, F.lit(0)) for c in ("abuse_score", "profile_score"))
    risky = reputation.where((abuse >= config.high_risk) | (profile >= config.high_risk))
    why = F.concat_ws(" and ", F.when(abuse >= config.high_risk, F.format_string("AbuseIPDB score %d", abuse)), F.when(profile >= config.high_risk, F.format_string("local profile score %d", profile)))
    place = F.when(F.coalesce("country", F.lit("")) != "", F.format_string(" (%s)", "country")).otherwise("")
    text = F.concat(F.col("attacker_ip"), place, F.lit(" flagged high risk: "), why)
    return _findings(risky, "high_risk_ip", F.lit("high"), F.col("last_updated"), text, [F.col("attacker_ip"), F.floor(abuse / 10).cast("string"), F.floor(profile / 10).cast("string")])


def event_findings(events: DataFrame, since: str, config: Config, names: list[str]) -> DataFrame:
    """Findings about single events, from one scan: commands that match a pattern, and downloads. A command is parsed and classified once."""
    kinds = {"suspicious_command": "command", "malware_staging": "file_download"}
    rows = _in_window(events, since, *(kinds[x] for x in names))
    load = F.coalesce(*(F.nullif(field(x), F.lit("")) for x in ("file_name", "download_url", "file_hash")), F.lit("unknown artefact"))
    fetched = F.col("event_type") == "file_download"
    rows = rows.select("attacker_ip", "event_id", "event_type", "node_id", "timestamp", "session_id", once(F.when(fetched, load).otherwise(F.coalesce(field("command"), F.lit("")))).alias("what"))
    rows = rows.select("*", once(F.when(fetched, 0).otherwise(first_pattern(F.col("what")))).alias("place")).where("place is not null")
    level, label = classified(F.col("place"))
    kind = F.when(fetched, "malware_staging").otherwise("suspicious_command")
    text = F.concat(F.when(fetched, "payload fetched").otherwise(label), F.lit(" on "), "node_id", F.lit(": "), F.substring("what", 1, 200))
    return rows.select(kind.alias("alert_type"), "attacker_ip", F.when(fetched, "high").otherwise(level).alias("severity"), "timestamp", text.alias("description"), "session_id", F.concat_ws("|", kind, "event_id").alias("dedupe_key"))


def suspicious_command(events: DataFrame, reputation: DataFrame, since: str, config: Config = DEFAULT) -> DataFrame:
    """Each command that matches a pattern."""
    return event_findings(events, since, config, ["suspicious_command"])


def malware_staging(events: DataFrame, reputation: DataFrame, since: str, config: Config = DEFAULT) -> DataFrame:
    """Each download."""
    return event_findings(events, since, config, ["malware_staging"])


def multi_node_scan(events: DataFrame, reputation: DataFrame, since: str, config: Config = DEFAULT) -> DataFrame:
    """One address on several sensors."""
    return address_findings(events, since, config, ["multi_node_scan"])


def post_auth_activity(events: DataFrame, reputation: DataFrame, since: str, config: Config = DEFAULT) -> DataFrame:
    """Sessions with an accepted login and commands in the window; each login counts each command, in any order.

    Logins and commands are counted by one aggregation, and a session's counts then meet, so its rows never multiply.
    """
    accepted = (F.col("event_type") == "login_success") & F.col("attacker_ip").isNotNull()
    ran = (F.col("event_type") == "command") & (F.col("timestamp") >= since)
    rows = events.where(F.col("session_id").isNotNull() & (accepted | ran)).groupBy("session_id", "attacker_ip", "node_id")
    rows = rows.agg(F.count_if(accepted).alias("logins"), F.count(F.when(ran, F.col("event_id"))).alias("commands"), F.max(F.when(ran, F.col("timestamp"))).alias("last_ts"))
    # sums by session meet the groups with logins: no window gathers a session's or an address's rows
    typed = rows.groupBy("session_id").agg(F.max("last_ts").alias("last_ts"), F.sum("commands").alias("commands")).where("last_ts is not null")
    return post_auth_findings(rows.where("logins > 0").drop("last_ts", "commands"), typed)


def post_auth_findings(logins: DataFrame, typed: DataFrame) -> DataFrame:
    """Findings of (session_id, attacker_ip, node_id, logins) with the session's (session_id, commands, last_ts)."""
    rows = logins.join(typed, "session_id").withColumn("n", F.col("logins") * F.col("commands"))
    text = F.format_string("authenticated session %s on %s executed %d command(s) after a successful login", "session_id", "node_id", "n")
    return _findings(rows, "post_auth_activity", F.lit("high"), F.col("last_ts"), text, [F.col("session_id"), F.col("n").cast("string")], F.col("session_id"))


#: The registry: a further rule is a further entry.
RULES: dict[str, Rule] = {
    "brute_force": brute_force, "credential_spray": credential_spray, "high_risk_ip": high_risk_ip, "suspicious_command": suspicious_command,
    "malware_staging": malware_staging, "multi_node_scan": multi_node_scan, "post_auth_activity": post_auth_activity,
}


def window_start(events: DataFrame, config: Config = DEFAULT, minutes: int | None = None) -> str | None:
    """The time `minutes` before the latest event; none for an empty table."""
    last = events.agg(stamp_of(seconds(F.max("timestamp")) - 60 * (minutes or config.window_minutes)).alias("since")).first()
    return last["since"]


#: Rules that share a pass: by their names, what gives the findings of several of them.
SHARED = [(tuple(ADDRESS_RULES), address_findings), (("suspicious_command", "malware_staging"), event_findings)]


def evaluated(events: DataFrame, reputation: DataFrame, since: str, config: Config = DEFAULT) -> DataFrame:
    """The findings of all enabled rules, with rule_order. Rules that read the same rows share a scan: four in all."""
    names = [x for x in config.enabled_rules if x in RULES]
    if not names:
        raise ValueError("no known rule is enabled")
    together = [(make, [x for x in names if x in of]) for of, make in SHARED]
    passes = [make(events, since, config, own) for make, own in together if own]
    passes += [RULES[x](events, reputation, since, config) for x in names if not any(x in of for of, _ in SHARED)]
    return in_order(passes, config)


def in_order(passes: list[DataFrame], config: Config = DEFAULT) -> DataFrame:
    """The findings of several passes, with rule_order."""
    out = passes[0]
    for one in passes[1:]:
        out = out.unionByName(one)
    places = F.create_map(*(F.lit(x) for k, name in enumerate(config.enabled_rules) for x in (name, k)))
    return out.withColumn("rule_order", F.element_at(places, F.col("alert_type")))


def order() -> list:
    """Worst first, then latest; ties by rule and key, the last key first."""
    return [rank(F.col("severity")).desc(), F.col("timestamp").desc(), F.col("rule_order"), F.col("dedupe_key").desc()]


def with_ids(findings: DataFrame) -> DataFrame:
    return findings.withColumn("alert_id", uuid5(F.col("dedupe_key")))


def new_alerts(findings: DataFrame, now: str, existing: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """The findings that become alerts, in the columns of the alerts table and with status open.

    A finding is dropped if its id exists already or came earlier in the pass, or if an open alert of
    the same address and type is younger than the cooldown at `now`: an existing one, or one that
    an earlier finding of the pass made. Rules in config.no_cooldown only look at ids.
    """
    rows = with_ids(findings)
    age = seconds(F.lit(now)) - seconds(F.col("timestamp"))
    rows = rows.withColumn("fresh", F.coalesce(age < 60 * config.cooldown_minutes, F.lit(False)) & ~F.col("alert_type").isin(*config.no_cooldown))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("alert_id").orderBy(*order())) == 1)
    if existing is None:
        rows = rows.withColumn("known", F.lit(False)).withColumn("cooling", F.lit(False))
    else:
        ids = existing.select("alert_id").distinct().withColumn("known", F.lit(True))
        old = seconds(F.lit(now)) - seconds(F.col("timestamp"))
        young = existing.where((F.col("status") == "open") & (old < 60 * config.cooldown_minutes)).select("attacker_ip", "alert_type").distinct().withColumn("cooling", F.lit(True))
        rows = rows.join(ids, "alert_id", "left").join(young, ["attacker_ip", "alert_type"], "left")
        rows = rows.withColumn("known", F.coalesce("known", F.lit(False))).withColumn("cooling", F.coalesce("cooling", F.lit(False)) & ~F.col("alert_type").isin(*config.no_cooldown))
    rows = rows.withColumn("candidate", F.col("first") & ~F.col("known"))
    # as one sortable value, of which the largest comes first
    rows = rows.withColumn("place", F.struct(rank(F.col("severity")), "timestamp", -F.col("rule_order"), "dedupe_key"))
    # the leader of an address and type is a maximum, found by partial aggregation and joined back: rules that never cool down have none
    leaders = rows.where(F.col("candidate") & F.col("fresh")).groupBy("attacker_ip", "alert_type").agg(F.max("place").alias("leader"))
    rows = rows.join(leaders, ["attacker_ip", "alert_type"], "left")
    kept = rows.where(F.col("candidate") & ~F.col("cooling") & ~F.coalesce(F.col("leader") > F.col("place"), F.lit(False)))
    return kept.select("alert_id", "attacker_ip", "session_id", "alert_type", "severity", "timestamp", "description", F.lit("open").alias("status"))


def with_statuses(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """alerts after status changes (alert_id, status, seq); the last of an id holds, unknown ids change nothing."""
    last = changes.groupBy("alert_id").agg(F.max_by("status", "seq").alias("_status"))
    return alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce("_status", "status")).select(*alerts.columns)


def pass_summary(findings: DataFrame, created: DataFrame) -> DataFrame:
    """(alert_type, findings, created, suppressed)."""
    made = created.groupBy("alert_type").agg(F.count(F.lit(1)).alias("created"))
    seen = findings.groupBy("alert_type").agg(F.count(F.lit(1)).alias("findings"))
    return seen.join(made, "alert_type", "left").select("alert_type", "findings", F.coalesce("created", F.lit(0).cast("long")).alias("created"), (F.col("findings") - F.coalesce("created", F.lit(0))).alias("suppressed"))
