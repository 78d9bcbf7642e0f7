"""Validation of events, and the folds that turn the event log into sessions, nodes and reputation.

An event comes as a line of JSON, which is parsed once; reasons for which it is rejected are collected by one expression over the parsed fields. Folds are single aggregations over order of arrival (seq), so their result doesn't depend on
partitioning, and replaying a batch changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentryspark.config import DEFAULT, EVENT_TYPES, PROTOCOLS, Config
from sentryspark.functions import jsontext
from sentryspark.functions.scalar import field, is_address, is_private, joined_sources, once, profile_score, seconds, truncated

FIELDS = ("event_id", "node_id", "event_type", "timestamp", "session_id", "attacker_ip", "protocol", "details")
#: For each type, the keys that details may have, those it must have, and those of which one is needed.
DETAILS = {
    "heartbeat": (("status", "agent_version"), ("status",), ()),
    "connection": (("destination_ip", "destination_port", "source_port"), (), ()),
    "login_attempt": (("username", "password"), ("username",), ()),
    "login_success": (("username",), (), ()),
    "command": (("command",), ("command",), ()),
    "file_download": (("download_url", "file_hash", "file_name"), (), ("download_url", "file_hash")),
    "session_end": (("status", "duration_seconds"), ("status",), ()),
}
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def _array(values) -> Column:
    return F.array(*(F.lit(x) for x in values)) if values else F.array().cast("array<string>")


def _reason(condition: Column, text: Column | str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(text) if isinstance(text, str) else text)


_read = jsontext.reader(FIELDS[:-1])


def parsed(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """lines with `event`, what jsontext.reader() finds in them; each line is parsed once."""
    return lines.withColumn("event", _read(F.col(line_col)))


def validated(lines: DataFrame, config: Config = DEFAULT, profile: str = "storage", line_col: str = "line") -> DataFrame:
    """lines with `event` as in parsed(), and `errors`, an array of reasons that is empty for a valid event.

    As in stages: keys that are missing or unknown end the check, then an unknown type does; further reasons accumulate.
    Absent and null keys differ. Profile `collector` or `sensor` also asks for an address that parses and for
    required details that are strings with more than white space; `collector` for strings in all fields, too.
    """
    if profile not in ("storage", "collector", "sensor"):
        raise ValueError(f"unknown profile {profile}")
    get = lambda name: F.col(f"event.{name}")
    missing = F.array_except(_array(FIELDS), get("keys"))
    unknown = F.sort_array(F.array_except(get("keys"), _array(FIELDS)))
    kind, beat, strict = get("event_type"), get("event_type") == "heartbeat", profile != "storage"
    falsy, string = lambda name: F.array_contains(get("falsy"), name), lambda name: get(f"kinds.{name}") == "string"

    # fixed values: the wording of reasons
    shape = F.array_compact(F.concat(
        F.transform(missing, lambda x: F.format_string("missing top-level field '%s' (use null, do not omit)", x)),
        F.array(_reason(F.size(unknown) > 0, F.concat(F.lit("unexpected top-level field(s): "), F.array_join(unknown, ", ")))),
    ))
    number = F.translate(F.regexp_replace(F.regexp_replace(get("event_id"), "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""), "-", "")
    reasons = [
        _reason(~F.coalesce(number.rlike("^[0-9a-fA-F]{32}$"), F.lit(False)), "event_id must be a valid UUID string"),
        _reason(falsy("node_id"), "node_id must be non-null"),
    ]
    if config.strict_nodes:
        reasons.append(_reason(~falsy("node_id") & ~(string("node_id") & get("node_id").isin(*config.known_nodes)), F.format_string("node_id '%s' is not a registered node", get("node_id"))))
    stamp = get("timestamp")
    shaped = string("timestamp") & stamp.rlike(STAMP)
    reasons.append(_reason(~shaped, "timestamp must be ISO 8601 UTC, e.g. 2026-07-19T15:00:00Z"))
    reasons.append(_reason(shaped & seconds(stamp).isNull(), F.format_string("timestamp '%s' is not a real date/time", stamp)))
    for name in ("session_id", "attacker_ip", "protocol"):
        reasons.append(_reason(beat & get(name).isNotNull(), f"{name} must be null for heartbeat events"))
        empty = falsy(name) if strict else get(name).isNull() | (string(name) & (get(name) == ""))
        reasons.append(_reason(~beat & empty, F.format_string(f"{name} must be non-null for '%s' events", kind)))
    if profile == "collector":
        for name in ("event_id", "session_id", "attacker_ip", "protocol"):
            reasons.append(_reason(get(name).isNotNull() & ~string(name), f"{name} must be a string"))
    reasons.append(_reason(get("protocol").isNotNull() & ~(string("protocol") & get("protocol").isin("", *PROTOCOLS)), F.format_string("protocol '%s' is not an allowed one", get("protocol"))))
    if strict:
        reasons.append(_reason(~beat & ~falsy("attacker_ip") & ~is_address(get("attacker_ip")), "attacker_ip must be an address"))
    inner, whole, void = get("inner"), get("details_kind") == "object", get("details_kind") == "null"
    reasons.append(_reason(void, "details must be an object, never null"))
    reasons.append(_reason(~whole & ~void, F.concat(F.lit("details must be a JSON object, not "), get("details_kind"))))
    allowed = F.create_map(*(x for k, v in DETAILS.items() for x in (F.lit(k), _array(v[0]))))
    extra = F.sort_array(F.array_except(F.map_keys(inner), F.element_at(allowed, kind)))
    reasons.append(_reason(whole & (F.size(extra) > 0), F.concat(F.lit("details key(s) not allowed for '"), kind, F.lit("': "), F.array_join(extra, ", "))))
    flag = lambda x, name: F.coalesce(F.element_at(inner, F.lit(x))[name], F.lit(True))
    for name, (_, required, any_of) in DETAILS.items():
        for x in required:
            reasons.append(_reason(whole & (kind == name) & flag(x, "blank" if strict else "void"), f"details.{x} is required and must be non-null for '{name}'"))
        if any_of:
            none = reduce(lambda a, b: a & b, (flag(x, "falsy" if strict else "void") for x in any_of))
            reasons.append(_reason(whole & (kind == name) & none, f"'{name}' requires at least one of: {', '.join(any_of)}"))
    named = string("event_type") & kind.isin(*EVENT_TYPES)
    errors = (
        F.when(get("keys").isNull(), F.array(F.lit("event must be a JSON object")))
        .when((F.size(missing) > 0) | (F.size(unknown) > 0), shape)
        .when(~F.coalesce(named, F.lit(False)), F.array(F.concat(F.lit("event_type '"), F.coalesce(kind, F.lit("null")), F.lit("' is not an allowed type"))))
        .otherwise(F.array_compact(F.array(*reasons)))
    )
    return parsed(lines, line_col).withColumn("errors", once(errors))


def problem_counts(checked: DataFrame, limit: int | None = None) -> DataFrame:
    """(problem, n), most frequent first."""
    out = checked.select(F.explode("errors").alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "problem")
    return out if limit is None else out.limit(limit)


def batch_rejections(batches: DataFrame, most: int = 20) -> DataFrame:
    """(batch_id, reason) for batches of (batch_id, header_node, line) that are refused as a whole: too large, or with events of another node."""
    node = F.get_json_object("line", "$.node_id")
    per = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max((~node.eqNullSafe(F.col("header_node"))).cast("int")).alias("foreign"))
    why = F.when(F.col("n") > most, F.lit(f"more than {most} events")).when(F.col("foreign") == 1, F.lit("node_id differs from the sender's"))
    return per.select("batch_id", why.alias("reason")).where("reason is not null")


def normalized(checked: DataFrame) -> DataFrame:
    """Valid lines as rows of the events table, from validated() ones with the columns seq and received_at.

    details is JSON text in canonical form: keys in order at every depth, a space after commas and colons, numbers as Python writes them.
    """
    get = lambda name: F.col(f"event.{name}").alias(name)
    return checked.where(F.size("errors") == 0).select(
        "seq", get("event_id"), get("node_id"), get("session_id"), get("event_type"), truncated(F.col("event.timestamp")).alias("timestamp"), get("attacker_ip"), get("protocol"), get("details"), "received_at",
    )


def rebased(events: DataFrame, anchor: str) -> DataFrame:
    """events shifted in time so that the latest is at `anchor`; unreadable times stay."""
    latest = events.agg(F.max(seconds(F.col("timestamp"))).alias("_latest"))
    moved = seconds(F.col("timestamp")) - F.col("_latest") + seconds(F.lit(anchor))
    stamp = F.date_format(F.timestamp_seconds(moved), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.crossJoin(F.broadcast(latest)).withColumn("timestamp", F.coalesce(stamp, "timestamp")).drop("_latest")  # one row


def outcomes(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """events with `outcome`: accepted, or duplicate if the id arrived before or is in `history`."""
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("seq")) == 1
    rows = events.withColumn("_first", first)
    if history is None:
        return rows.withColumn("outcome", F.when(F.col("_first"), "accepted").otherwise("duplicate")).drop("_first")
    known = history.select("event_id").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "event_id", "left")
    return rows.withColumn("outcome", F.when(F.col("_first") & F.col("_known").isNull(), "accepted").otherwise("duplicate")).drop("_first", "_known")


def folded_sessions(events: DataFrame, *more: Column) -> DataFrame:
    """The sessions table: one aggregation of the event log, or of a stream of it; more are further sums.

    First arrivals give node, address and protocol, last ones user name and password; start_time is the
    earliest time. The last session_end to arrive closes the session, as failed if it says so.
    """
    seq = F.col("seq")
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), seq))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), seq))
    ends = F.when(F.col("event_type") == "session_end", seq)
    status = F.when(field("status").isin("failed", "error"), "failed").otherwise("closed")
    return (
        events.where("session_id is not null")
        .groupBy("session_id")
        .agg(
            F.min_by("node_id", "seq").alias("node_id"), first(F.col("attacker_ip")).alias("attacker_ip"), first(F.col("protocol")).alias("protocol"),
            last(field("username")).alias("username"), last(field("password")).alias("password"), F.min("timestamp").alias("start_time"),
            F.max_by("timestamp", ends).alias("end_time"), F.coalesce(F.max_by(status, ends), F.lit("active")).alias("status"), *more,
        )
    )


def closed_stale_sessions(sessions: DataFrame, events: DataFrame, now: str, config: Config = DEFAULT) -> DataFrame:
    """sessions in which active ones without an event for longer than the timeout are failed."""
    last = events.where("session_id is not null").groupBy("session_id").agg(F.max("timestamp").alias("_last"))
    rows = sessions.join(last, "session_id", "left")
    stale = (F.col("status") == "active") & (seconds(F.lit(now)) - seconds(F.coalesce("_last", "start_time")) > config.stale_session_seconds)
    stale = F.coalesce(stale, F.lit(False))
    return rows.withColumn("end_time", F.when(stale, F.coalesce("end_time", "start_time")).otherwise(F.col("end_time"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status"))).drop("_last")


def touched_nodes(events: DataFrame) -> DataFrame:
    """(node_id, last_seen, status): every node that sent something is online."""
    return events.groupBy("node_id").agg(F.max("timestamp").alias("last_seen")).withColumn("status", F.lit("online"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new merged in: a value of new replaces the old one unless it is null. new has each key once."""
    columns = old.columns
    right = new.select(*(F.col(c).alias(f"_{c}") for c in new.columns))
    joined = old.join(right, old[key] == right[f"_{key}"], "full")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in columns))


def with_stale_nodes_offline(nodes: DataFrame, now: str, config: Config = DEFAULT) -> DataFrame:
    age = seconds(F.lit(now)) - seconds(F.col("last_seen"))
    gone = (F.col("status") == "online") & F.coalesce(age > config.offline_seconds, F.lit(True))
    return nodes.withColumn("status", F.when(gone, "offline").otherwise(F.col("status")))


def merged_reputation(old: DataFrame, new: DataFrame) -> DataFrame:
    """Reputation after new lookups: nulls never erase, sources are joined, last_updated is the new one's, a first profile score defaults to 0."""
    right = new.select(*(F.col(c).alias(f"_{c}") for c in new.columns))
    rows = old.join(right, F.col("attacker_ip") == F.col("_attacker_ip"), "full")
    out = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in old.columns}
    out["source"] = joined_sources(F.col("source"), F.col("_source"))
    out["profile_score"] = F.coalesce("_profile_score", "profile_score", F.lit(0))
    out["last_updated"] = F.when(F.col("_attacker_ip").isNotNull(), F.col("_last_updated")).otherwise(F.col("last_updated"))
    return rows.select(*(e.alias(c) for c, e in out.items()))


def enrichment_queue(events: DataFrame, reputation: DataFrame, now: str, max_age_days: int = 7, limit: int = 100, include_private: bool = False, v6: bool = True) -> DataFrame:
    """(attacker_ip) of addresses without a reputation or with an old one, in order; private ones are left out before the limit."""
    seen = events.where("attacker_ip is not null").select("attacker_ip").distinct()
    rows = seen.join(reputation.select("attacker_ip", "last_updated"), "attacker_ip", "left")
    age = seconds(F.lit(now)) - seconds(F.col("last_updated"))
    rows = rows.where(F.col("last_updated").isNull() | (age > max_age_days * 86400)).select("attacker_ip")
    if not include_private:
        rows = rows.where(~is_private(F.col("attacker_ip"), v6))
    return rows.orderBy("attacker_ip").limit(limit)


def profile_inputs(events: DataFrame) -> DataFrame:
    """Per address: sessions, nodes, distinct commands and distinct user names, besides counts of events."""
    kind = F.col("event_type")
    named = F.when(kind.isin("login_attempt", "login_success"), field("username"))
    return (
        events.where("attacker_ip is not null")
        .groupBy("attacker_ip")
        .agg(
            F.count(F.lit(1)).alias("event_count"), F.count_distinct("session_id").alias("session_count"), F.count_distinct("node_id").alias("node_count"),
            F.count_distinct(F.when(kind == "command", field("command"))).alias("distinct_commands"), F.count_distinct(named).alias("distinct_usernames"),
        )
    )


def profile_inputs_of(events: DataFrame, addresses: DataFrame) -> DataFrame:
    """profile_inputs() for each of (attacker_ip), with a row of zeroes for an address that has no events."""
    wanted = addresses.select("attacker_ip").where("attacker_ip is not null").distinct()
    found = profile_inputs(events.join(wanted, "attacker_ip", "left_semi"))
    return wanted.join(found, "attacker_ip", "left").select("attacker_ip", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in found.columns if c != "attacker_ip"))


def ingest_report(lines: DataFrame, history: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """(outcome, n) of lines (line, seq, received_at): accepted, duplicate and rejected, each with a row.

    As outcomes() has them, but counted by id: lines are parsed once, and no id's lines are put in order to tell the first.
    """
    checked = validated(lines, config).select((F.size("errors") == 0).alias("good"), F.col("event.event_id").alias("event_id"))
    per = checked.groupBy("good", F.when(F.col("good"), F.col("event_id")).alias("event_id")).agg(F.count(F.lit(1)).alias("n"))
    fresh = F.col("good")
    if history is not None:
        per = per.join(history.select("event_id").distinct().withColumn("known", F.lit(True)), "event_id", "left")
        fresh = fresh & F.col("known").isNull()
    accepted, rejected = F.count_if(fresh), F.coalesce(F.sum(F.when(~F.col("good"), F.col("n"))), F.lit(0).cast("long"))
    duplicate = F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0).cast("long")) - accepted
    named = F.array(*(F.struct(F.lit(name).alias("outcome"), n.alias("n")) for name, n in (("accepted", accepted), ("duplicate", duplicate), ("rejected", rejected))))
    return per.agg(named.alias("all")).select(F.explode("all").alias("x")).select("x.*")


def validation_report(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(lines, conforming, not_conforming) of a file of lines."""
    bad = F.count_if(F.size("errors") > 0)
    return validated(lines, config).agg(F.count(F.lit(1)).alias("lines"), (F.count(F.lit(1)) - bad).alias("conforming"), bad.alias("not_conforming"))


def enriched(queue: DataFrame, lookups: DataFrame, inputs: DataFrame, now: str) -> DataFrame:
    """Reputation rows for a queue of addresses, from a dimension of lookup results (attacker_ip, country, city, latitude, longitude, abuse_score, source).

    Loopback and 172.* addresses are the lab's own, with scores of 0. An address that the dimension lacks has
    a failed lookup: its row says so and has no scores, so that a merge keeps earlier ones.
    """
    local = F.col("attacker_ip").isin("127.0.0.1", "::1", "localhost") | F.col("attacker_ip").startswith("172.")
    rows = queue.join(lookups.withColumn("_found", F.lit(True)), "attacker_ip", "left").join(inputs.select("attacker_ip", "session_count", "distinct_commands"), "attacker_ip", "left")
    found = F.coalesce("_found", F.lit(False)) & ~local
    zero = F.lit(0).cast("long")
    score = profile_score(F.col("abuse_score"), F.coalesce("session_count", zero), F.coalesce("distinct_commands", zero))
    return rows.select(
        "attacker_ip", F.when(local, "Local Lab").when(found, F.col("country")).alias("country"), F.when(local, "Local Lab").when(found, F.col("city")).alias("city"),
        F.when(found, F.col("latitude")).alias("latitude"), F.when(found, F.col("longitude")).alias("longitude"),
        F.when(local, 0).when(found, F.col("abuse_score")).cast("int").alias("abuse_score"), F.when(local, "Local Lab").when(found, F.col("source")).otherwise("Error Fallback").alias("source"),
        F.when(local, 0).when(found, score).cast("int").alias("profile_score"), F.lit(now).alias("last_updated"),
    )
