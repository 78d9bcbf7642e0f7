"""Sensor logs to events: shell-sensor lines, service-sensor incidents and connection records.

Each mapper is a projection of JSON lines to an array of envelopes which is then exploded; one line may
give none, one or many. Nothing is parsed row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentryspark.config import URL_NAMESPACE
from sentryspark.functions.jsontext import canonical
from sentryspark.functions.scalar import is_usable, once, uuid5

REDACTED = "***REDACTED***"
#: Fixed values of the shell sensor's log.
SHELL_TYPES = {
    "cowrie.session.connect": "connection", "cowrie.login.failed": "login_attempt", "cowrie.login.success": "login_success",
    "cowrie.command.input": "command", "cowrie.session.file_download": "file_download", "cowrie.session.closed": "session_end",
}
#: Fixed values of the service sensor's logs: protocols by module, and origins by what they report.
SERVICE_PROTOCOLS = {
    "ftpd": "ftp", "smbd": "smb", "httpd": "http", "mysqld": "mysql", "mssqld": "mssql", "SipSession": "sip", "TftpServerHandler": "tftp",
    "upnpd": "upnp", "mqttd": "mqtt", "Memcache": "memcache", "mongod": "mongo", "printerd": "printer", "pptpd": "pptp", "epmapper": "epmap",
}
ACCEPT_ORIGINS = ("dionaea.connection.tcp.accept", "dionaea.connection.tls.accept", "dionaea.connection.tcp.reject")
LOGIN_ORIGINS = ("dionaea.modules.python.ftp.login", "dionaea.modules.python.mysql.login", "dionaea.modules.python.mssql.login")
COMMAND_ORIGINS = {
    "dionaea.modules.python.ftp.command": ("command", "arguments"), "dionaea.modules.python.mssql.cmd": ("cmd", None), "dionaea.modules.python.mysql.command": ("command", "args"),
    "dionaea.modules.python.sip.command": ("method", None), "dionaea.modules.python.mqtt.publish": ("publishtopic", "publishmessage"), "dionaea.modules.python.mqtt.subscribe": ("subscribetopic", None),
}
DOWNLOAD_ORIGINS = ("dionaea.download.offer", "dionaea.download.complete.hash")
END_ORIGIN = "dionaea.connection.free"

_ENVELOPE = "array<struct<event_type:string,details:string>>"


#: What is read of a service sensor's line, and of the connection that an incident is about; nested values come as text.
_SERVICE = "origin string, timestamp string, src_ip string, src_port string, dst_ip string, dst_port string, connection struct<type:string,protocol:string>, data string, credentials string, ftp struct<commands:string>"
_LINK = "struct<id:string,protocol:string,remote_ip:string,remote_port:string,local_ip:string,local_port:string>"


def _get(path: str, line: str | Column = "line") -> Column:
    return F.get_json_object(line, f"$.{path}")


def _value(key: str, of: str) -> Column:
    return F.element_at(F.col(of), F.lit(key))


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def _details(ignore_null: bool = False, **parts: Column) -> Column:
    """A JSON object with these keys in order of their names; null values stay unless they are to be left out."""
    return F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": str(ignore_null).lower()})


def _envelope(kind: str, details: Column) -> Column:
    return F.struct(F.lit(kind).alias("event_type"), details.alias("details"))


def as_utc(stamp: Column) -> Column:
    """A time with the mark of UTC, which one without an offset lacks; empty ones are null."""
    ready = stamp.endswith("Z") | stamp.rlike(r"[+-]..:..$")
    return F.when(F.coalesce(stamp, F.lit("")) != "", F.when(ready, stamp).otherwise(F.concat(stamp, F.lit("Z"))))


def rendered(verb: Column, arguments: Column) -> Column:
    """One command as text: verb and arguments, which are a scalar or a JSON list of them. A password that is sent as a command is redacted; no verb gives null."""
    listed = F.from_json(arguments, "array<string>")
    parts = F.array_join(F.filter(listed, lambda x: x.isNotNull() & (x != "")), " ")
    tail = F.when(F.coalesce(arguments, F.lit("")) == "", F.lit("")).when(arguments.startswith("[") & listed.isNotNull(), parts).otherwise(arguments)
    text = F.when(F.upper(verb) == "PASS", F.concat(verb, F.lit(f" {REDACTED}"))).otherwise(F.trim(F.concat_ws(" ", verb, F.nullif(tail, F.lit("")))))
    return F.when(F.coalesce(verb, F.lit("")) != "", text)


def shell_events(lines: DataFrame, node_id: str, protocol: str = "ssh", prefix_session: bool = False) -> DataFrame:
    """Events of a shell sensor's lines; prefix_session puts the node before session ids, which several sensors may share otherwise."""
    get = lambda key: _value(key, "own")
    kind = F.col("_kind")
    details = (
        F.when(kind == "login_attempt", _details(username=get("username"), password=get("password")))
        .when(kind == "login_success", _details(username=get("username")))
        .when(kind == "command", _details(command=get("input")))
        .when(kind == "file_download", _details(download_url=get("url"), file_hash=get("shasum"), file_name=get("outfile")))
        .when(kind == "session_end", _details(status=F.lit("closed"), duration_seconds=get("duration").try_cast("double")))
        .when(kind == "connection", _details(destination_ip=get("dst_ip"), destination_port=get("dst_port").try_cast("int"), source_port=get("src_port").try_cast("int")))
    )
    session = F.concat(F.lit(f"{node_id}:"), get("session")) if prefix_session else get("session")
    rows = lines.select("line", once(F.from_json("line", "map<string,string>")).alias("own"))
    rows = rows.select("line", "own", once(_mapped(SHELL_TYPES, get("eventid"))).alias("_kind")).where("_kind is not null")
    return rows.select(
        "line", F.lit(0).alias("index"), F.lit(node_id).alias("node_id"), kind.alias("event_type"), get("timestamp").alias("timestamp"),
        session.alias("session_id"), get("src_ip").alias("attacker_ip"), F.lit(protocol).alias("protocol"), details.alias("details"),
    )


def skipped_shell_events(lines: DataFrame, limit: int = 5) -> DataFrame:
    """(eventid, n) of lines that give no event, most frequent first."""
    name = F.coalesce(_get("eventid"), F.lit("unknown"))
    rows = lines.where(_mapped(SHELL_TYPES, _get("eventid")).isNull()).groupBy(name.alias("eventid")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "eventid").limit(limit)


def _incident_events() -> Column:
    """From the columns own, data (a map) and link (its connection)."""
    origin, data, link = F.col("own.origin"), lambda x: _value(x, "data"), lambda x: F.col(f"link.{x}")
    command = F.lit(None).cast("string")
    for name, (verb, arguments) in COMMAND_ORIGINS.items():
        command = F.when(origin == name, rendered(data(verb), data(arguments) if arguments else F.lit(None).cast("string"))).otherwise(command)
    return (
        F.when(origin.isin(*ACCEPT_ORIGINS), F.array(_envelope("connection", _details(destination_ip=link("local_ip"), destination_port=link("local_port").try_cast("int"), source_port=link("remote_port").try_cast("int")))))
        .when(origin.isin(*LOGIN_ORIGINS), F.array(_envelope("login_attempt", _details(username=data("username"), password=F.nullif(data("password"), F.lit(""))))))
        .when(origin.isin(*COMMAND_ORIGINS), F.transform(F.array_compact(F.array(command)), lambda x: _envelope("command", _details(command=x))))
        .when(origin.isin(*DOWNLOAD_ORIGINS), F.array(_envelope("file_download", _details(download_url=data("url"), file_hash=data("md5hash"), file_name=data("file")))))
        .when(origin == END_ORIGIN, F.array(_envelope("session_end", _details(status=F.lit("closed")))))
    )


def _pairs(text: Column, first: str, second: str) -> Column:
    """(a, b) structs of a list of objects or of an object of lists."""
    pair = "struct<a:string,b:string>"
    listed = F.from_json(text, f"array<struct<`{first}`:string,`{second}`:string>>")
    objects = F.transform(F.filter(listed, lambda x: x.isNotNull()), lambda x: F.struct(x[first].alias("a"), x[second].alias("b")))
    both = F.from_json(text, f"struct<`{first}`:array<string>,`{second}`:array<string>>")
    values = F.coalesce(both[second], F.array().cast("array<string>"))
    lists = F.transform(both[first], lambda x, k: F.struct(x.alias("a"), F.get(values, k).alias("b")))
    empty = F.array().cast(f"array<{pair}>")
    return F.when(text.startswith("["), F.coalesce(objects, empty)).otherwise(F.coalesce(lists, empty))


def _record_events() -> Column:
    """All events that were folded into one connection record, from the columns own, pairs and typed."""
    own = lambda x: F.col(f"own.{x}")
    start = F.array(_envelope("connection", _details(destination_ip=own("dst_ip"), destination_port=own("dst_port").try_cast("int"), source_port=own("src_port").try_cast("int"))))
    logins = F.transform("pairs", lambda x: _envelope("login_attempt", _details(username=x["a"], password=F.nullif(x["b"], F.lit("")))))
    commands = F.transform(F.filter("typed", lambda x: x.isNotNull()), lambda x: _envelope("command", _details(command=x)))
    end = F.array(_envelope("session_end", _details(status=F.lit("closed"))))
    return F.concat(start, logins, commands, end)


def service_rows(lines: DataFrame, node_id: str) -> DataFrame:
    """Events of a service sensor's lines, of either log, with `incident`: whether the line is one; the format is told line by line, and each line is parsed once.

    Lines without a usable address, a readable time or a known protocol give none. Session ends are without durations.
    """
    has_origin = F.array_contains(F.json_object_keys("line"), "origin")
    rows = lines.select("line", once(F.struct(F.from_json("line", _SERVICE).alias("own"), F.coalesce(has_origin, F.lit(False)).alias("incident"))).alias("all")).select("line", "all.own", "all.incident")
    rows = rows.select("*", once(F.from_json("own.data", "map<string,string>")).alias("data"))
    empty = F.array().cast("array<struct<a:string,b:string>>")
    record = ~F.col("incident") & F.coalesce(F.col("own.connection.type").isin("accept", "reject"), F.lit(False))
    parts = F.struct(
        F.from_json(_value("connection", "data"), _LINK).alias("link"), F.when(record, _pairs(F.col("own.credentials"), "username", "password")).otherwise(empty).alias("pairs"),
        F.when(record, _pairs(F.col("own.ftp.commands"), "command", "arguments")).otherwise(empty).alias("sent"),
    )
    rows = rows.select("*", once(parts).alias("parts")).select("line", "own", "incident", "data", "parts.link", "parts.pairs", once(F.transform("parts.sent", lambda x: rendered(x["a"], x["b"]))).alias("typed"))
    incident, own = F.col("incident"), lambda x: F.col(f"own.{x}")
    service = F.when(incident, F.col("link.protocol")).otherwise(own("connection.protocol"))
    ip = F.when(incident, F.col("link.remote_ip")).otherwise(own("src_ip"))
    seed = F.concat_ws("|", *(F.coalesce(own(x), F.lit("None")) for x in ("src_ip", "src_port", "dst_ip", "dst_port", "timestamp")))
    session = F.when(incident, F.substring(F.nullif(F.col("link.id"), F.lit("")), 1, 16)).otherwise(F.substring(F.sha2(seed, 256), 1, 16))
    head = F.struct(as_utc(own("timestamp")).alias("timestamp"), F.concat(F.lit(f"{node_id}:"), session).alias("session_id"), ip.alias("attacker_ip"), _mapped(SERVICE_PROTOCOLS, service).alias("protocol"), F.when(incident, _incident_events()).when(record, _record_events()).alias("events"))
    rows = rows.select("line", "incident", once(head).alias("head")).select("line", "incident", "head.*")
    rows = rows.where(F.col("timestamp").isNotNull() & F.col("session_id").isNotNull() & F.col("protocol").isNotNull() & is_usable(F.col("attacker_ip")))
    return rows.select("*", F.posexplode("events").alias("index", "event")).select("line", "index", F.lit(node_id).alias("node_id"), "event.event_type", "timestamp", "session_id", "attacker_ip", "protocol", "event.details", "incident")


def micros(stamp: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(stamp, "Z$", "")))


def with_durations(rows: DataFrame) -> DataFrame:
    """service_rows() with `_lasted` in the details of incidents' session ends."""
    ended = F.col("incident") & (F.col("event_type") == "session_end") & F.col("_lasted").isNotNull()
    return rows.withColumn("details", F.when(ended, _details(status=F.lit("closed"), duration_seconds=F.col("_lasted"))).otherwise(F.col("details"))).drop("_lasted", "incident")


def service_events(lines: DataFrame, node_id: str) -> DataFrame:
    """service_rows() in which an incident's session end has its duration, from the session's latest earlier accept; a connection record has no end to measure."""
    out = service_rows(lines, node_id)
    at = micros(F.col("timestamp"))
    before = Window.partitionBy("session_id").orderBy("timestamp", F.when(F.col("event_type") == "connection", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("incident") & (F.col("event_type") == "connection"), at), ignorenulls=True).over(before)
    return with_durations(out.withColumn("_lasted", F.round((at - opened) / 1e6, 3)))


def skipped_services(lines: DataFrame, limit: int = 6) -> DataFrame:
    """(kind, name, n): origins that are no event's, and protocols without a name in the contract, counted once a connection."""
    origin = _get("origin")
    known = origin.isin(*ACCEPT_ORIGINS, *LOGIN_ORIGINS, *COMMAND_ORIGINS, *DOWNLOAD_ORIGINS, END_ORIGIN)
    service = F.coalesce(_get("data.connection.protocol"), _get("connection.protocol"))
    opens = origin.isin(*ACCEPT_ORIGINS) | (origin.isNull() & _get("connection.type").isin("accept", "reject"))
    unnamed = opens & _mapped(SERVICE_PROTOCOLS, service).isNull()
    kind = F.when(origin.isNotNull() & ~known, "origin").when(F.coalesce(unnamed, F.lit(False)), "protocol")
    rows = lines.select(kind.alias("kind"), F.when(kind == "origin", origin).otherwise(F.coalesce(service, F.lit("unknown"))).alias("name")).where("kind is not null")
    return rows.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind", "name").limit(limit)


def with_stable_ids(events: DataFrame, scheme: str = "sentryspark-backfill") -> DataFrame:
    """events with an event_id that follows from node, line and the event's place in it, so that reading a log again gives the same ids.

    What counts of a line is its canonical JSON, keys in order and without spaces: another layout of the same line gives the same id.
    """
    rows = events.withColumn("seed", canonical(F.col("line"), compact=True))
    seed = F.concat(F.lit(f"{scheme}://"), F.concat_ws("/", "node_id", F.col("index").cast("string"), "seed"))
    return rows.withColumn("event_id", uuid5(seed, URL_NAMESPACE)).drop("line", "index", "seed")
