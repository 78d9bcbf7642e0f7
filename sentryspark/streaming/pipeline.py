"""Live ingest and live rollups with Structured Streaming.

Delivery is at least once: batches write to a folder of their own, which a retry overwrites, and an event that an
earlier batch accepted is a duplicate, however old it is. Rollups over the log are recomputed or windowed; the fold of sessions is never cut by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from sentryspark.config import DEFAULT, Config
from sentryspark.functions.scalar import seconds
from sentryspark.operators.ingest import normalized, outcomes, validated
from sentryspark.operators.rules import evaluated, new_alerts
from sentryspark.schema import ALERTS, EVENTS
from sentryspark.sources.tables import new_folder, removed
from sentryspark.streaming.ids import Ids

def _stored(spark: SparkSession, path: str, schema: StructType, part: str, before: int | None) -> DataFrame:
    """The rows below path, of the parts that come before `before`; none if nothing was written yet."""
    try:
        rows = spark.read.schema(StructType([*schema.fields, StructField(part, LongType())])).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    rows = rows if before is None else rows.where(F.col(part) < before)
    return rows.select(*schema.fieldNames())


def stored_events(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The event log below out; `before` leaves out that batch and later ones."""
    return _stored(spark, f"{out}/events", EVENTS, "batch", before)


def numbered(rows: DataFrame, first: int) -> tuple[DataFrame, int]:
    """Stored rows with a column `row`, from monotonically_increasing_id(), with `seq` in its place: first, first + 1, ... without gaps; and the number after the last."""
    parts = sorted(rows.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition of the batch
    starts, at = {}, first
    for r in parts:
        starts[r["part"]] = at
        at += r["n"]
    table = rows.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "part long, start long")
    seq = F.col("start") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", F.shiftright("row", 33)).join(F.broadcast(table), "part").withColumn("seq", seq).drop("part", "start", "row"), at


def ingested(batch: DataFrame, batch_id: int, out: str, received_at, config: Config = DEFAULT) -> None:
    """Add a batch of lines (column `value`) to the log below out: valid new events to events, others with their reasons to rejected.

    An event is a duplicate if its id came before in the batch, or in any batch before, however long ago: see ids.Ids. Lines are numbered
    in order of arrival through all batches. A batch that is tried again replaces what it left.
    """
    spark = batch.sparkSession
    lines = batch.select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("row"), received_at.alias("received_at"))
    path = new_folder(spark, "ingest-checked")
    lines.write.parquet(f"{path}/lines")
    known = Ids(spark, f"{out}/ids")
    first = known.runs.state(batch_id)["note"].get("lines", 0)
    counted, after = numbered(spark.read.schema(lines.schema).parquet(f"{path}/lines"), first)
    validated(counted, config).write.parquet(f"{path}/checked")
    checked = spark.read.parquet(f"{path}/checked")
    rows = normalized(checked)
    fresh = outcomes(rows, known.known(rows, batch_id)).where("outcome = 'accepted'").drop("outcome")
    fresh.write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")
    checked.where(F.size("errors") > 0).drop("event").write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
    known.add(spark.read.schema(EVENTS).parquet(f"{out}/events/batch={batch_id}"), batch_id, {"lines": after})
    removed(spark, path)


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, received_at=None, trigger: dict | None = None, files: int = 100, config: Config = DEFAULT) -> StreamingQuery:
    """Start ingesting JSON lines that land in folder `source`; by default all that is there, then stop."""
    stream = spark.readStream.option("maxFilesPerTrigger", files).text(source)
    arrival = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if received_at is None else received_at
    step = lambda batch, number: ingested(batch, number, out, arrival, config)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_time(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """events with `at`, a timestamp, and a watermark on it."""
    return events.withColumn("at", F.timestamp_seconds(seconds(F.col("timestamp")))).withWatermark("at", delay)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream without events whose id came within the watermark's delay; state stays bounded."""
    return event_time(events, delay).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def windowed_activity(events: DataFrame, width: str = "5 minutes", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of tumbling windows, or sliding ones."""
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return event_time(events, delay).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def inactive_sessions(events: DataFrame, config: Config = DEFAULT, delay: str = "1 hour") -> DataFrame:
    """(session_id, first_event, last_event, n) of stretches of a session that ended with inactivity, once the watermark has passed it.

    A pause as long as the timeout ends a stretch. Spark's session windows still join rows that are just the gap apart, so theirs is shorter by a microsecond.
    """
    window = F.session_window("at", f"{config.stale_session_seconds - 1} seconds 999999 microseconds")
    rows = event_time(events, delay).where("session_id is not null").groupBy(window, "session_id")
    return rows.agg(F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"), F.count(F.lit(1)).alias("n")).select("session_id", "first_event", "last_event", "n")


def alert_pass(spark: SparkSession, out: str, reputation: DataFrame, since: str, now: str, number: int, config: Config = DEFAULT) -> DataFrame:
    """Evaluate the rules over the log below out and add what is new to its alerts, as pass `number`; a retry overwrites its own."""
    path = f"{out}/alerts"
    old = _stored(spark, path, ALERTS, "pass", number)
    fresh = new_alerts(evaluated(stored_events(spark, out), reputation, since, config), now, old, config)
    fresh.write.mode("overwrite").parquet(f"{path}/pass={number}")
    return spark.read.parquet(f"{path}/pass={number}")


def cycle(spark: SparkSession, source: str, out: str, checkpoint: str, reputation: Callable[[], DataFrame], since: str, now: str, number: int) -> DataFrame:
    """One cycle of a live system: take in what has landed, then evaluate the rules."""
    ingest(spark, source, out, checkpoint).awaitTermination()
    return alert_pass(spark, out, reputation(), since, now, number)
