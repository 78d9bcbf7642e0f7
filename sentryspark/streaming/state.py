"""Folds and timers as keyed state of a stream: sessions, sensors, and how long connections were open.

Each processor keeps for its key what the batch form of the same result would need, so a micro-batch costs its own rows and not the log.
What a stream emits are changes: the latest row of a key is the key's row in the batch form, over all events so far.

Clock and lateness: timers go by the watermark, and that is on the time of arrival, not on that of the events. Rows that arrive in
order are never late then, however old their events are, and the watermark is the `now` of the batch forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from sentryspark.config import DEFAULT, Config
from sentryspark.functions.scalar import field, seconds
from sentryspark.operators.mappers import micros, service_rows, with_durations
from sentryspark.schema import SESSIONS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACCEPTS_KEPT = 16
ACCEPTS_MS = 86_400_000


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with the state store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _fields(**kinds) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in kinds.items()])


def _named(schema: StructType, *values) -> Row:
    return Row(**dict(zip(schema.fieldNames(), values, strict=True)))


def _clocked(rows: DataFrame, arrived: Column, delay: str) -> DataFrame:
    return rows.withColumn("arrived", arrived).withWatermark("arrived", delay)


# -- sessions ---------------------------------------------------------------

_FIRST, _LAST = ("attacker_ip", "protocol"), ("username", "password")
_FOLD = _fields(
    **{x: kind for name in ("node_id", *_FIRST, *_LAST, "end_time") for x, kind in ((name, StringType), (f"{name}_seq", LongType))}, status=StringType, start_time=StringType, last_event=StringType, last_second=LongType,
)
_PLACE = {name: k for k, name in enumerate(_FOLD.fieldNames())}
#: A session's row, whether it is here because of an event or of time, and the watermark at which it changed.
SESSION_CHANGES = StructType([*SESSIONS.fields, StructField("change", StringType()), StructField("watermark", LongType())])


class SessionFold(StatefulProcessor):
    """The session's row after every micro-batch that has events of it, and when its time is up.

    For each column the order of arrival that its value comes from is kept, so events that arrive out of order, in whatever batch, give the same row.
    """

    def __init__(self, timeout: int | None):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("fold", _FOLD)

    def _row(self, session_id: str, fold: list, stale: bool, change: str, now: int) -> Row:
        get = lambda name: fold[_PLACE[name]]
        end = get("end_time") or get("start_time") if stale else get("end_time")
        return _named(SESSION_CHANGES, session_id, get("node_id"), get("attacker_ip"), get("protocol"), get("username"), get("password"), get("start_time"), end, "failed" if stale else get("status"), change, now)

    def _due(self, fold: list) -> int | None:
        last = fold[_PLACE["last_second"]]
        return None if self.timeout is None or fold[_PLACE["status"]] != "active" or last is None else (last + self.timeout) * 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fold = list(self.kept.get()) if self.kept.exists() else [None] * len(_PLACE)
        old = self._due(fold) if fold[_PLACE["status"]] else None
        fold[_PLACE["status"]] = fold[_PLACE["status"]] or "active"

        def put(name: str, value, seq: int, earliest: bool) -> bool:
            place = _PLACE[f"{name}_seq"]
            if fold[place] is None or (seq < fold[place] if earliest else seq > fold[place]):
                fold[place], fold[_PLACE[name]] = seq, value
                return True
            return False

        for row in rows:
            put("node_id", row["node_id"], row["seq"], True)
            for name in _FIRST + _LAST:
                if row[name] is not None:
                    put(name, row[name], row["seq"], name in _FIRST)
            if row["ended"] is not None and put("end_time", row["timestamp"], row["seq"], False):
                fold[_PLACE["status"]] = row["ended"]
            if row["timestamp"] is not None:
                fold[_PLACE["start_time"]] = min(fold[_PLACE["start_time"]] or row["timestamp"], row["timestamp"])
                if fold[_PLACE["last_event"]] is None or row["timestamp"] > fold[_PLACE["last_event"]]:
                    fold[_PLACE["last_event"]], fold[_PLACE["last_second"]] = row["timestamp"], row["second"]
        self.kept.update(tuple(fold))
        now, due = (timerValues.getCurrentWatermarkInMs(), self._due(fold)) if self.timeout is not None else (0, None)
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        stale = due is not None and now > due
        if due is not None and not stale and due != old:
            self.handle.registerTimer(due)
        yield self._row(key[0], fold, stale, "event", now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fold, now = list(self.kept.get()), timerValues.getCurrentWatermarkInMs()
        due = self._due(fold)
        if due is not None and now == due:
            self.handle.registerTimer(due + 1)  # more than the timeout, not just as much
        elif due is not None and now > due:
            yield self._row(key[0], fold, True, "time", now)


def session_changes(events: DataFrame, config: Config = DEFAULT, arrived: Column | None = None, delay: str = "0 seconds") -> DataFrame:
    """A stream of SESSION_CHANGES from a stream of events: ingest.folded_sessions() kept up to date.

    With `arrived`, a timestamp, sessions without an event for longer than the timeout fail once the watermark on it has passed that, as in
    ingest.closed_stale_sessions(); without, there are no timers. Only events of sessions move that clock.
    """
    status = F.when(field("status").isin("failed", "error"), "failed").otherwise("closed")
    rows = events.where("session_id is not null").select("session_id", "seq", "node_id", "attacker_ip", "protocol", field("username").alias("username"), field("password").alias("password"), F.when(F.col("event_type") == "session_end", status).alias("ended"), "timestamp", seconds(F.col("timestamp")).alias("second"), *([] if arrived is None else [arrived.alias("arrived")]))
    timed = arrived is not None
    rows = rows.withWatermark("arrived", delay) if timed else rows
    return rows.groupBy("session_id").transformWithState(SessionFold(config.stale_session_seconds if timed else None), SESSION_CHANGES, "Update", "EventTime" if timed else "None")


# -- sensors ----------------------------------------------------------------

NODE_CHANGES = _fields(node_id=StringType, last_seen=StringType, status=StringType, change=StringType, watermark=LongType)


class NodeClock(StatefulProcessor):
    """A sensor is online when it sends, and offline when it has been silent for too long."""

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("seen", _fields(last_seen=StringType, second=LongType))

    def _due(self, second: int | None) -> int | None:
        return None if second is None else (second + self.silence) * 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, second = self.kept.get() if self.kept.exists() else (None, None)
        old = self._due(second)
        for row in rows:
            if row["timestamp"] is not None and (seen is None or row["timestamp"] > seen):
                seen, second = row["timestamp"], row["second"]
        self.kept.update((seen, second))
        now, due = timerValues.getCurrentWatermarkInMs(), self._due(second)
        silent = due is None or now > due
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        if not silent and due != old:
            self.handle.registerTimer(due)
        yield _named(NODE_CHANGES, key[0], seen, "offline" if silent else "online", "event", now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen, second = self.kept.get()
        now, due = timerValues.getCurrentWatermarkInMs(), self._due(second)
        if now == due:
            self.handle.registerTimer(due + 1)
        elif now > due:
            yield _named(NODE_CHANGES, key[0], seen, "offline", "time", now)


_SEEN = StructType([StructField("node_id", StringType()), StructField("timestamp", StringType()), StructField("arrived", TimestampType())])


def _latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch a row for each sensor: its latest time and arrival."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by([("node_id", "ascending"), ("timestamp", "descending")])  # nulls come last
        last = rows.group_by("node_id", use_threads=False).aggregate([("timestamp", "first"), ("arrived", "max")])
        yield from last.rename_columns(["node_id", "timestamp", "arrived"]).cast(batch.schema).to_batches()


def node_changes(events: DataFrame, arrived: Column, config: Config = DEFAULT, delay: str = "0 seconds") -> DataFrame:
    """A stream of NODE_CHANGES from a stream of events: ingest.touched_nodes() and with_stale_nodes_offline() kept up to date.

    Sensors are few and their events many: only the latest of each Arrow batch are shuffled, so no task gets a sensor's events.
    """
    few = events.select("node_id", "timestamp", arrived.cast("timestamp").alias("arrived")).mapInArrow(_latest, _SEEN)
    rows = _clocked(few.withColumn("second", seconds(F.col("timestamp"))), F.col("arrived"), delay)
    return rows.groupBy("node_id").transformWithState(NodeClock(config.offline_seconds), NODE_CHANGES, "Update", "EventTime")


# -- how long connections were open ------------------------------------------


class OpenConnections(StatefulProcessor):
    """Session ends with the seconds since the session's latest accept before them.

    A session keeps its latest accepts, a fixed number of them at most, and forgets them when nothing has come for a time: what is never freed doesn't stay.
    """

    def __init__(self, most: int, ttl: int):
        self.most, self.ttl = most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.accepts, self.until = handle, handle.getMapState("accepts", _fields(at=LongType), _fields(stamp=StringType)), handle.getValueState("until", _fields(ms=LongType))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = {k[0]: v[0] for k, v in self.accepts.iterator()}
        own = sorted(rows, key=lambda r: (r["timestamp"], r["event_type"] != "connection"))
        fresh = {}
        for row in own:
            lasted = None
            if row["event_type"] == "session_end" and row["at"] is not None:
                earlier = max(((stamp, at) for at, stamp in known.items() if stamp <= row["timestamp"]), default=None)
                lasted = None if earlier is None else round((row["at"] - earlier[1]) / 1e6, 3)
            if row["event_type"] == "connection" and row["at"] is not None:
                known[row["at"]] = fresh[row["at"]] = row["timestamp"]
            yield _named(_OPEN, *(row[x] for x in _OPEN.fieldNames()[:-1]), lasted)
        for at, stamp in fresh.items():
            self.accepts.updateValue((at,), (stamp,))
        for at in sorted(known)[: -self.most]:
            self.accepts.removeKey((at,))
        if known:
            self._forget_at(max(row["ms"] for row in own) + self.ttl)

    def _forget_at(self, ms: int) -> None:
        old = self.until.get()[0] if self.until.exists() else None
        if old is None or old < ms:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
            self.until.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.accepts.clear()
        self.until.clear()
        return iter(())


_OPEN = _fields(line=StringType, index=IntegerType, node_id=StringType, event_type=StringType, timestamp=StringType, session_id=StringType, attacker_ip=StringType, protocol=StringType, details=StringType)
_OPEN = StructType([*_OPEN.fields, *_fields(_lasted=DoubleType).fields])


def service_stream(lines: DataFrame, node_id: str, arrived: Column | None = None, most: int = ACCEPTS_KEPT, ttl: int = ACCEPTS_MS) -> DataFrame:
    """mappers.service_events() of a stream of lines, for incidents whose accept and end lie in whatever batches, the accept not after the end's.

    arrived is the time of arrival, by default the batch's. Events that aren't incidents' have nothing to wait for and pass by the state.
    """
    rows = service_rows(lines, node_id)
    incidents = rows.where("incident").withColumn("at", micros(F.col("timestamp")))
    incidents = _clocked(incidents, F.current_timestamp() if arrived is None else arrived, "0 seconds").withColumn("ms", F.unix_millis("arrived"))
    timed = incidents.groupBy("session_id").transformWithState(OpenConnections(most, ttl), _OPEN, "Append", "EventTime")
    others = rows.where("not incident").withColumn("_lasted", F.lit(None).cast("double"))
    return with_durations(timed.withColumn("incident", F.lit(True)).unionByName(others))
