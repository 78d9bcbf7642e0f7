"""Rollups and rule windows that are kept by partial results, so that reading them never goes back to the log.

A batch of events is reduced once, to sums that add up and to distinct members that unite, and the log is not read again. Rollups keep
these by the hour in levels of runs; windows of rules keep them in panes, of which a pass reads those of its window.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sentryspark.config import DEFAULT, Config
from sentryspark.functions.scalar import field, seconds
from sentryspark.operators import rollups, rules
from sentryspark.sources.store import Runs, names
from sentryspark.sources.tables import removed


def _schema(strings: str, longs: str = "") -> StructType:
    return StructType([StructField(x, StringType()) for x in strings.split()] + [StructField(x, LongType()) for x in longs.split()])


# -- rollups ----------------------------------------------------------------

_SUMS = _schema("hour attacker_ip node_id event_type odd", "first last n lag_sum lags lag_max")
_MEMBERS = _schema("attacker_ip node_id session_id")


def _numbered(stamp: Column) -> tuple[Column, Column]:
    """(number, odd) of a time: its digits as a number, whose order is that of the texts; or 0 and the text, if it has another form.

    Numbers are kept by hashing; Spark finds the least or largest text of each group by sorting all rows. So many rows are reduced with numbers, odd texts being a part of their key.
    """
    plain = stamp.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z")
    return F.when(plain, F.translate(stamp, "-:TZ", "").cast("long")).when(stamp.isNotNull(), 0), F.when(~plain, stamp)


def _text(number: str) -> Column:
    """The time of a number of a reduced row, null if it has none."""
    digits = F.lpad(F.col(number).cast("string"), 14, "0")
    plain = F.concat(*(x for at, size, end in ((1, 4, "-"), (5, 2, "-"), (7, 2, "T"), (9, 2, ":"), (11, 2, ":"), (13, 2, "Z")) for x in (F.substring(digits, at, size), F.lit(end))))
    return F.when(F.col(number).isNotNull(), F.coalesce("odd", plain))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hour", "attacker_ip", "node_id", "event_type", "odd").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), *(F.sum(c).alias(c) for c in ("n", "lag_sum", "lags")), F.max("lag_max").alias("lag_max")
    )


def _whole_hour(since: str) -> None:
    if not since.endswith(":00:00Z"):
        raise ValueError("rollups are kept by the hour: since has to be a full one")


class Rollups:
    """attacker_summary, activity and node_statistics of all events that were added, equal to those of operators.rollups over the log."""

    def __init__(self, spark: SparkSession, path: str, fan_in: int = 8):
        self.sums = Runs(spark, f"{path}/sums", _SUMS, merge=_added, fan_in=fan_in)
        self.members = Runs(spark, f"{path}/members", _MEMBERS, merge=lambda x: x.distinct(), fan_in=fan_in)

    def add(self, events: DataFrame, number: int) -> None:
        """Add the events of batch `number`, which replaces what it added before; read twice: store them."""
        lag = rollups.lag(events)
        digits, odd = _numbered(F.col("timestamp"))
        own = events.select(
            F.substring("timestamp", 1, 13).alias("hour"), "attacker_ip", "node_id", "event_type", odd.alias("odd"), digits.alias("first"), digits.alias("last"), F.lit(1).cast("long").alias("n"),
            F.coalesce(lag, F.lit(0)).cast("long").alias("lag_sum"), F.when(lag.isNotNull(), 1).otherwise(0).cast("long").alias("lags"), lag.cast("long").alias("lag_max"),
        )
        self.sums.add(_added(own), number)
        self.members.add(events.where("session_id is not null").select("attacker_ip", "node_id", "session_id").distinct(), number)

    def attacker_summary(self) -> DataFrame:
        kind = lambda x: F.coalesce(F.sum(F.when(F.col("event_type") == x, F.col("n"))), F.lit(0).cast("long"))
        each = self.sums.rows().where("attacker_ip is not null").groupBy("attacker_ip", "node_id", "odd").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("event_count"),
            kind("login_attempt").alias("login_attempts"), kind("login_success").alias("login_successes"), kind("command").alias("command_count"), kind("file_download").alias("download_count"),
        )
        own = each.groupBy("attacker_ip").agg(
            F.min(_text("first")).alias("first_seen"), F.max(_text("last")).alias("last_seen"), F.count_distinct("node_id").alias("node_count"),
            *(F.sum(c).alias(c) for c in ("event_count", "login_attempts", "login_successes", "command_count", "download_count")),
        )
        sessions = self.members.rows().where("attacker_ip is not null").groupBy("attacker_ip").agg(F.count_distinct("session_id").alias("session_count"))
        out = own.join(sessions, "attacker_ip", "left").withColumn("session_count", F.coalesce("session_count", F.lit(0).cast("long")))
        return out.select("attacker_ip", "first_seen", "last_seen", "event_count", "session_count", "node_count", "login_attempts", "login_successes", "command_count", "download_count")

    def activity(self, since: str, by: str = "hour") -> DataFrame:
        _whole_hour(since)
        kind = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))
        is_ = lambda x: F.col("event_type") == x
        rows = self.sums.rows().where(F.col("hour") >= since[:13]).groupBy(F.substring("hour", 1, {"hour": 13, "day": 10}[by]).alias("bucket"))
        return rows.agg(F.sum("n").alias("total"), kind(~is_("heartbeat")).alias("attacks"), kind(is_("login_attempt")).alias("logins"), kind(is_("command")).alias("commands"), F.count_distinct("attacker_ip").alias("ips"))

    def node_statistics(self, nodes: DataFrame, alerts: DataFrame, since: str) -> DataFrame:
        _whole_hour(since)
        new, beat = F.col("hour") >= since[:13], F.col("event_type") == "heartbeat"
        n = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))
        each = self.sums.rows().groupBy("node_id", "attacker_ip", "odd").agg(
            F.sum("n").alias("events_total"), F.max("last").alias("last_event"), F.max(F.when(beat, F.col("last"))).alias("last_heartbeat"), F.sum("lag_sum").alias("lag_sum"), F.sum("lags").alias("lags"),
            F.max("lag_max").alias("max_lag_seconds"), n(new).alias("events_recent"), n(new & ~beat).alias("attacks_recent"), n(new & beat).alias("heartbeats_recent"),
        )
        own = each.groupBy("node_id").agg(
            F.sum("events_total").alias("events_total"), F.count_distinct("attacker_ip").alias("attackers_total"), F.max(_text("last_event")).alias("last_event"), F.max(_text("last_heartbeat")).alias("last_heartbeat"),
            (F.sum("lag_sum") / F.sum("lags")).alias("avg_lag_seconds"), F.max("max_lag_seconds").alias("max_lag_seconds"), *(F.sum(c).alias(c) for c in ("events_recent", "attacks_recent", "heartbeats_recent")),
        )
        members = self.members.rows().select("node_id", "session_id")
        held = members.groupBy("node_id").agg(F.count_distinct("session_id").alias("sessions_total"))
        fired = alerts.where((F.col("timestamp") >= since) & F.col("session_id").isNotNull()).select("alert_id", "session_id")
        # only the sessions of recent alerts, not those of all time, are made distinct
        touched = members.join(fired.select("session_id").distinct(), "session_id", "left_semi").distinct()
        per = fired.join(touched, "session_id").groupBy("node_id").agg(F.count_distinct("alert_id").alias("alerts_recent"))
        out = nodes.join(own, "node_id", "left").join(held, "node_id", "left").join(per, "node_id", "left")
        zero = ["events_total", "sessions_total", "attackers_total", "events_recent", "attacks_recent", "heartbeats_recent", "alerts_recent"]
        return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero})


# -- panes ------------------------------------------------------------------

_PANES = {
    "counts": _schema("attacker_ip odd", "last_try last_name last_ts attempts"), "members": _schema("attacker_ip kind value"),
    "findings": _schema("alert_type attacker_ip severity timestamp description session_id dedupe_key"), "typed": _schema("session_id odd", "last_ts commands"),
}
_LOGINS = _schema("session_id attacker_ip node_id", "logins")
#: Sessions whose logins are looked up by their prefixes; more of them are joined with all.
FILTERED_SESSIONS = 10_000


class Panes:
    """The findings of all rules over a window, from what its panes hold: equal to rules.evaluated() over the log.

    Panes are mergeable partials of `width` seconds of the events' own time, so late events go where they belong and a window that moves on adds a
    pane and leaves one out. `since` has to begin a pane. Only logins have no window: they are summed by session in runs.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = 60, config: Config = DEFAULT, fan_in: int = 8):
        self.spark, self.path, self.width, self.config = spark, path, width, config
        self.hash = F.shiftrightunsigned(F.xxhash64("session_id"), 1)
        added = lambda x: x.groupBy("session_id", "attacker_ip", "node_id").agg(F.sum("logins").alias("logins"))
        self.logins = Runs(spark, f"{path}/logins", _LOGINS, merge=added, prefix=self.hash, order=["session_id"], fan_in=fan_in)

    def _pane(self, stamp) -> F.Column:
        return (F.floor(seconds(stamp) / self.width) * self.width).cast("long")

    def _write(self, name: str, rows: DataFrame, number: int) -> None:
        out = rows.select(*_PANES[name].fieldNames(), "pane", F.lit(number).cast("long").alias("batch")).hint("rebalance", "pane")  # a large pane is no one task's
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pane", "batch").parquet(f"{self.path}/{name}")

    def _read(self, name: str, since: int) -> DataFrame:
        held = [x for x in names(self.spark, f"{self.path}/{name}") if x.startswith("pane=") and int(x[5:]) >= since]
        if not held:
            return self.spark.createDataFrame([], _PANES[name])
        return self.spark.read.schema(_PANES[name]).option("recursiveFileLookup", True).parquet(*(f"{self.path}/{name}/{x}" for x in held))

    def add(self, events: DataFrame, number: int) -> None:
        """Add the events of batch `number`, which replaces what it added before; read six times: store them."""
        digits, odd = _numbered(F.col("timestamp"))
        rows = events.where("attacker_ip is not null").withColumn("pane", self._pane(F.col("timestamp")))
        tried, named = F.col("event_type") == "login_attempt", F.when(F.col("event_type").isin("login_attempt", "login_success"), field("username"))
        own = rows.withColumn("name", named)
        self._write("counts", own.groupBy("pane", "attacker_ip", odd.alias("odd")).agg(
            F.max(F.when(tried, digits)).alias("last_try"), F.max(F.when(F.col("name").isNotNull(), digits)).alias("last_name"), F.max(digits).alias("last_ts"), F.count_if(tried).alias("attempts"),
        ), number)
        pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        sets = F.array(pair("node", F.col("node_id")), pair("tried", F.when(tried, F.col("node_id"))), pair("name", F.col("name")))
        self._write("members", own.select("pane", "attacker_ip", F.explode(sets).alias("x")).select("pane", "attacker_ip", "x.*").where("value is not null").distinct(), number)
        found = rules.event_findings(events, "", self.config, ["suspicious_command", "malware_staging"])
        self._write("findings", found.withColumn("pane", self._pane(F.col("timestamp"))), number)
        ran = events.where("session_id is not null and event_type = 'command'").withColumn("pane", self._pane(F.col("timestamp")))
        self._write("typed", ran.groupBy("pane", "session_id", odd.alias("odd")).agg(F.max(digits).alias("last_ts"), F.count("event_id").alias("commands")), number)
        accepted = events.where("session_id is not null and event_type = 'login_success' and attacker_ip is not null")
        self.logins.add(accepted.groupBy("session_id", "attacker_ip", "node_id").agg(F.count(F.lit(1)).alias("logins")), number, size=accepted.count())

    def drop(self, before: str) -> None:
        """Delete the panes that no window needs any more: those before a time."""
        until = self._start(before)
        for name in _PANES:
            for pane in names(self.spark, f"{self.path}/{name}"):
                if pane.startswith("pane=") and int(pane[5:]) < until:
                    removed(self.spark, f"{self.path}/{name}/{pane}")

    def _start(self, stamp: str) -> int:
        start = self.spark.range(1).select(seconds(F.lit(stamp)).alias("s")).first()["s"]
        if start is None or start % self.width:
            raise ValueError(f"{stamp} doesn't begin a pane of {self.width} seconds")
        return start

    def counters(self, since: str) -> DataFrame:
        """Equal to rules.address_counters()."""
        start = self._start(since)
        last = ["last_try", "last_name", "last_ts"]
        each = self._read("counts", start).groupBy("attacker_ip", "odd").agg(F.sum("attempts").alias("attempts"), *(F.max(c).alias(c) for c in last))
        sums = each.groupBy("attacker_ip").agg(F.sum("attempts").alias("attempts"), *(F.max(_text(c)).alias(c) for c in last))
        value = lambda kind: F.when(F.col("kind") == kind, F.col("value"))
        sets = self._read("members", start).groupBy("attacker_ip").agg(F.count_distinct(value("name")).alias("usernames"), F.size(F.collect_set(value("tried"))).alias("tried_nodes"), F.array_sort(F.collect_set(value("node"))).alias("nodes"))
        return sums.join(sets, "attacker_ip")

    def evaluated(self, reputation: DataFrame, since: str) -> DataFrame:
        known, start = self.config.enabled_rules, self._start(since)
        passes = [rules.findings_of(self.counters(since), self.config, [x for x in rules.ADDRESS_RULES if x in known]), self._read("findings", start).where(F.col("alert_type").isin(*known))]
        if "high_risk_ip" in known:
            passes.append(rules.high_risk_ip(self._read("counts", start), reputation, since, self.config))
        if "post_auth_activity" in known:
            typed = self._read("typed", start).groupBy("session_id").agg(F.max(_text("last_ts")).alias("last_ts"), F.sum("commands").alias("commands"))
            wanted = [r["hash"] for r in typed.select(self.hash.alias("hash")).limit(FILTERED_SESSIONS + 1).collect()]
            logins = self.logins.rows(prefixes=wanted if len(wanted) <= FILTERED_SESSIONS else None)
            passes.append(rules.post_auth_findings(logins.groupBy("session_id", "attacker_ip", "node_id").agg(F.sum("logins").alias("logins")), typed))
        return rules.in_order(passes, self.config)
