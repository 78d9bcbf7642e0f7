"""The published feed: indicators and alerts as nested rows, filtered, masked, and written as JSON, CSV and STIX.

Every writer gets the same rows and lets Spark's writers do the writing. Secrets are masked by the schema before anything is
written, and a check over the written columns fails the job if one slips through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from sentryspark.config import DEFAULT, MASK, Config
from sentryspark.functions.scalar import at_least, confidence, rank, severity_of, uuid5
from sentryspark.operators.rollups import attacker_summary

#: Indicators and alerts that one document may have.
DOCUMENT_ROWS = 10_000
#: Keys whose values never leave local storage.
SENSITIVE = ("password", "passwd", "pwd", "secret", "node_key", "x-node-key", "api_key")


def indicators(events: DataFrame, alerts: DataFrame, reputation: DataFrame, floor: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """One flat row per address with a publishable alert. Alerts are aggregated before the joins."""
    chosen = alerts.where(at_least(F.col("severity"), floor or config.feed_severity) & F.col("status").isin(*config.feed_statuses))
    own = chosen.groupBy("attacker_ip").agg(
        F.count("alert_id").alias("alert_count"), F.array_sort(F.collect_set("alert_type")).alias("alert_types"), F.max(rank(F.col("severity"))).alias("severity_rank"), F.max("timestamp").alias("latest_alert")
    )
    known = reputation.select("attacker_ip", "country", "city", "latitude", "longitude", "abuse_score", "profile_score", F.col("source").alias("reputation_source"))
    rows = own.join(known, "attacker_ip", "left").join(attacker_summary(events), "attacker_ip", "left")
    zero = ["event_count", "session_count", "node_count", "login_attempts", "command_count", "download_count"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero})
    return rows.withColumn("severity", severity_of(F.col("severity_rank"))).withColumn("confidence", confidence(*(F.col(c) for c in ("abuse_score", "profile_score", "node_count", "download_count", "command_count"))))


def nested(flat: DataFrame) -> DataFrame:
    """Indicators in the feed's shape."""
    part = lambda **names: F.struct(*(F.col(v).alias(k) for k, v in names.items()))
    sources = F.filter(F.split(F.coalesce("reputation_source", F.lit("")), ","), lambda x: x != "")
    return flat.select(
        "attacker_ip", "first_seen", "last_seen", "confidence", "severity", "alert_count", "alert_types",
        part(events="event_count", sessions="session_count", nodes_touched="node_count", login_attempts="login_attempts", commands="command_count", downloads="download_count").alias("activity"),
        part(country="country", city="city", latitude="latitude", longitude="longitude").alias("geo"),
        F.struct("abuse_score", "profile_score", sources.alias("sources")).alias("scores"),
    )


def feed_alerts(alerts: DataFrame, reputation: DataFrame, floor: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """The latest publishable alerts, up to config.feed_alerts."""
    rows = alerts.where(at_least(F.col("severity"), floor or config.feed_severity) & F.col("status").isin(*config.feed_statuses))
    rows = rows.orderBy(F.desc("timestamp"), "alert_id").limit(config.feed_alerts)
    return rows.join(reputation.select("attacker_ip", "country", "abuse_score", "profile_score"), "attacker_ip", "left").select(
        "alert_id", "attacker_ip", "session_id", "alert_type", "severity", "timestamp", "description", "status", "country", "abuse_score", "profile_score"
    )


def filtered(flat: DataFrame, alerts: DataFrame, since: str | None = None, country: str | None = None, alert_type: str | None = None, min_confidence: int = 0) -> tuple[DataFrame, DataFrame]:
    """Indicators and alerts that pass; min_confidence only applies to indicators."""
    if since:
        flat, alerts = flat.where(F.col("last_seen") >= since), alerts.where(F.col("timestamp") >= since)
    if country:
        flat, alerts = flat.where(F.col("country") == country), alerts.where(F.col("country") == country)
    if alert_type:
        flat, alerts = flat.where(F.array_contains("alert_types", alert_type)), alerts.where(F.col("alert_type") == alert_type)
    if min_confidence:
        flat = flat.where(F.col("confidence") >= min(100, max(0, min_confidence)))
    return flat, alerts


# -- secrets ----------------------------------------------------------------


def _scrubbed(column: Column, kind: DataType, key: str = "") -> Column:
    if key.lower() in SENSITIVE and not isinstance(kind, StructType | ArrayType):
        return F.when(column.isNull() | (column.cast("string") == ""), column.cast("string")).otherwise(F.lit(MASK))
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.struct(*(_scrubbed(column[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: _scrubbed(x, kind.elementType, key))
    return column


def scrubbed(rows: DataFrame) -> DataFrame:
    """rows with every value under a sensitive key masked, at any depth; nulls and empty strings stay."""
    return rows.select(*(_scrubbed(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in rows.schema.fields))


def checked(text: Column) -> Column:
    """JSON text, or a failure if a sensitive key has an unmasked value."""
    keys = "|".join(SENSITIVE)
    leak = text.rlike(rf'(?i)"({keys})"\s*:\s*(?!null|""|"\*\*\*MASKED\*\*\*")')
    return F.when(leak, F.raise_error(F.lit("an unmasked secret reached a sink"))).otherwise(text)


# -- writers ----------------------------------------------------------------


def _head(counts: Column, generated_at: str, floor: str | None, config: Config) -> Column:
    return F.struct(
        F.lit(config.feed_name).alias("name"), F.lit(config.feed_producer).alias("producer"), F.lit(config.schema_version).alias("schema_version"), F.lit(generated_at).alias("generated_at"),
        F.lit(floor or config.feed_severity).alias("min_severity"), F.array(*(F.lit(x) for x in config.feed_statuses)).alias("statuses"), counts.alias("counts"), F.lit(config.feed_notice).alias("notice"),
    )


def feed_rows(flat: DataFrame, alerts: DataFrame, generated_at: str, floor: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """The feed as rows (part, json): one `feed` with the header and counts, then one for each `indicator` and `alert`. No row gathers others."""
    rows, fired = scrubbed(nested(flat)), scrubbed(alerts)
    line = lambda frame, part: frame.select(F.lit(part).alias("part"), checked(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"})).alias("json"))
    counts = flat.agg(F.count(F.lit(1)).alias("indicators")).crossJoin(F.broadcast(alerts.agg(F.count(F.lit(1)).alias("alerts"))))  # one row each
    head = counts.select(F.lit("feed").alias("part"), F.to_json(_head(F.struct("indicators", "alerts"), generated_at, floor, config), {"ignoreNullFields": "false"}).alias("json"))
    return head.unionByName(line(rows, "indicator")).unionByName(line(fired, "alert"))


def feed_document(flat: DataFrame, alerts: DataFrame, generated_at: str, floor: str | None = None, most: int = DOCUMENT_ROWS, config: Config = DEFAULT) -> DataFrame:
    """The whole feed as one row `json`: header, indicators, alerts. Fails for more than `most` indicators or alerts; feed_rows and write_feed have no such bound."""
    rows, fired = scrubbed(nested(flat)).limit(most + 1), scrubbed(alerts).limit(most + 1)
    many = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("indicators"), F.count(F.lit(1)).alias("n"))
    also = fired.agg(F.array_sort(F.collect_list(F.struct(*fired.columns))).alias("alerts"), F.count(F.lit(1)).alias("m"))
    head = _head(F.struct(F.col("n").alias("indicators"), F.col("m").alias("alerts")), generated_at, floor, config)
    both = many.crossJoin(F.broadcast(also))  # one row each
    text = checked(F.to_json(F.struct(head.alias("feed"), "indicators", "alerts"), {"ignoreNullFields": "false", "pretty": "true"}))
    return both.select(F.when(F.greatest("n", "m") > most, F.raise_error(F.lit("too many rows for one document"))).otherwise(text).alias("json"))


def flattened(flat: DataFrame) -> DataFrame:
    """Indicators as the 20 columns of the CSV file; lists are joined by semicolons."""
    return flat.select(
        "attacker_ip", "first_seen", "last_seen", "severity", "confidence", "alert_count", F.array_join("alert_types", ";").alias("alert_types"), "country", "city", "latitude", "longitude", "abuse_score", "profile_score",
        F.regexp_replace(F.coalesce("reputation_source", F.lit("")), ",", ";").alias("sources"), F.col("event_count").alias("events"), F.col("session_count").alias("sessions"),
        F.col("node_count").alias("nodes_touched"), "login_attempts", F.col("command_count").alias("commands"), F.col("download_count").alias("downloads"),
    )


def stix_time(stamp: Column) -> Column:
    return F.when(stamp.contains("."), stamp).when(F.coalesce(stamp, F.lit("")) != "", F.regexp_replace(stamp, "Z", ".000Z"))


def stix_objects(flat: DataFrame, now: str, config: Config = DEFAULT) -> DataFrame:
    """(id, json): the identity and one indicator object per address; ids follow from names. IPv6 addresses get an IPv6 pattern."""
    identity = F.concat(F.lit("identity--"), uuid5(F.lit(config.feed_producer)))
    moment = stix_time(F.lit(now))
    n = lambda c: F.col(c).cast("string")
    # fixed values: the wording of descriptions
    text = F.concat(F.concat_ws(
        ". ",
        F.concat(F.lit("Observed on "), n("node_count"), F.lit(" honeypot sensor(s)")), F.concat(n("session_count"), F.lit(" session(s)")), F.concat(n("login_attempts"), F.lit(" login attempt(s)")),
        F.when(F.col("command_count") > 0, F.concat(n("command_count"), F.lit(" command(s) executed"))), F.when(F.col("download_count") > 0, F.concat(n("download_count"), F.lit(" payload download(s)"))),
        F.when(F.coalesce("country", F.lit("")) != "", F.concat(F.lit("geolocated to "), "country")), F.concat(F.lit("AbuseIPDB score "), n("abuse_score")),
    ), F.lit("."))
    family = F.when(F.col("attacker_ip").contains(":"), "ipv6-addr").otherwise("ipv4-addr")
    one = F.concat(F.lit("indicator--"), uuid5(F.concat(F.lit("indicator|"), "attacker_ip")))
    labels = F.when(F.size("alert_types") > 0, F.col("alert_types")).otherwise(F.array(F.lit("scanning")))
    objects = flat.select(one.alias("id"), F.to_json(F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), one.alias("id"), identity.alias("created_by_ref"), moment.alias("created"), moment.alias("modified"),
        F.concat(F.lit("Honeypot activity from "), "attacker_ip").alias("name"), text.alias("description"), F.array(F.lit("malicious-activity")).alias("indicator_types"),
        F.concat(F.lit("["), family, F.lit(":value = '"), "attacker_ip", F.lit("']")).alias("pattern"), F.lit("stix").alias("pattern_type"), F.lit("2.1").alias("pattern_version"),
        F.coalesce(stix_time(F.col("first_seen")), moment).alias("valid_from"), "confidence", labels.alias("labels"),
    )).alias("json"))
    who = flat.sparkSession.range(1).select(identity.alias("id"), F.to_json(F.struct(
        F.lit("identity").alias("type"), F.lit("2.1").alias("spec_version"), identity.alias("id"), moment.alias("created"), moment.alias("modified"), F.lit(config.feed_producer).alias("name"),
        F.lit("system").alias("identity_class"), F.array(F.lit("technology")).alias("sectors"),
    )).alias("json"))
    return who.unionByName(objects)


def stix_bundle(flat: DataFrame, now: str, config: Config = DEFAULT) -> DataFrame:
    """(position, id, json): the objects of a bundle; position 0 is the identity, which comes first."""
    return stix_objects(flat, now, config).withColumn("position", F.when(F.col("id").startswith("identity--"), 0).otherwise(1))


def bundle_document(flat: DataFrame, now: str, most: int = DOCUMENT_ROWS, config: Config = DEFAULT) -> DataFrame:
    """The bundle as one row `json` with type, id and objects, its id following from its time. Fails for more than `most` indicators."""
    rows = stix_bundle(flat, now, config).limit(most + 2)
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("position", "id", "json"))).alias("all"))
    text = F.concat(F.lit('{"type":"bundle","id":"bundle--'), uuid5(F.lit("bundle|" + now)), F.lit('","objects":['), F.array_join(F.transform("all", lambda x: x.json), ","), F.lit("]}"))
    return whole.select(F.when(F.size("all") > most + 1, F.raise_error(F.lit("too many objects for one document"))).otherwise(checked(text)).alias("json"))


def write_feed(flat: DataFrame, alerts: DataFrame, path: str, now: str, config: Config = DEFAULT) -> dict[str, str]:
    """Write indicators and alerts as JSON lines and CSV, and STIX objects as JSON lines, below path; returns the folders by name.

    CSV quotes every value. Without rows there is no header, as there is no file.
    """
    rows, fired = scrubbed(nested(flat)), scrubbed(alerts)
    out = {name: f"{path}/{name}" for name in ("indicators_json", "alerts_json", "indicators_csv", "alerts_csv", "stix")}
    for name, frame in (("indicators_json", rows), ("alerts_json", fired)):
        frame.select(checked(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"})).alias("value")).write.text(out[name])
    for name, frame in (("indicators_csv", flattened(flat)), ("alerts_csv", fired)):
        frame.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(out[name])
    stix_objects(flat, now, config).select(checked(F.col("json")).alias("value")).write.text(out["stix"])
    return out
