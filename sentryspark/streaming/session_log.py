"""The sessions table kept up to date by a stream of any number of sessions, and failed by the clock.

The fold is Spark's own streaming aggregation, of the same expressions as the batch form, so no row and no state goes through Python. Timers are
rows: an active session's row lies in a pane of the time at which it is due, and a batch that moves the clock reads only the panes it passes.
state.session_changes() emits the same changes from one operator, at the price of several calls between Python and the JVM for every session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sentryspark.config import DEFAULT, Config
from sentryspark.functions.scalar import seconds
from sentryspark.operators.ingest import folded_sessions
from sentryspark.schema import SESSIONS
from sentryspark.sources.store import _Manifests, names
from sentryspark.sources.tables import new_folder, removed

#: Seconds of due times that lie together.
PANE = 600
_CHANGES = StructType([*SESSIONS.fields, StructField("change", StringType()), StructField("batch", LongType())])
_WAITING = StructType([*SESSIONS.fields, *(StructField(x, LongType()) for x in ("due", "pane", "batch"))])


def session_folds(events: DataFrame, arrived: Column) -> DataFrame:
    """A stream of folds of the sessions that a micro-batch has events of, for update mode; arrived is a second."""
    return folded_sessions(events.withColumn("_arrived", arrived), F.max("timestamp").alias("last_event"), F.max("_arrived").alias("arrived"))


class SessionLog:
    """Changes of sessions below path: a session's latest is its row in ingest.closed_stale_sessions() over all events so far, at the latest arrival among those of sessions."""

    def __init__(self, spark: SparkSession, path: str, config: Config = DEFAULT):
        self.spark, self.path, self.config, self.manifests = spark, path, config, _Manifests(spark, path)

    def _changes(self) -> DataFrame:
        return self.spark.read.schema(_CHANGES).parquet(f"{self.path}/changes")

    def add(self, folds: DataFrame, number: int) -> None:
        """Add session_folds() of batch `number`, which replaces what it added before."""
        before = (self.manifests.last(number) or {"now": 0})["now"]
        path = new_folder(self.spark, "session-folds")
        folds.write.parquet(path)  # what comes from the stream's state is computed once
        rows = self.spark.read.schema(folds.schema).parquet(path)
        now = max(before, rows.agg(F.max("arrived").alias("now")).first()["now"] or 0)
        rows = rows.withColumn("due", F.when(F.col("status") == "active", seconds(F.coalesce("last_event", "start_time")) + self.config.stale_session_seconds))
        waiting = rows.where(F.col("due") >= now).withColumn("pane", F.floor(F.col("due") / PANE)).withColumn("batch", F.lit(number).cast("long"))
        waiting.select(*SESSIONS.fieldNames(), "due", "pane", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pane", "batch").parquet(f"{self.path}/waiting")
        stale = F.coalesce(F.col("due") < now, F.lit(False))
        failed = {"end_time": F.when(stale, F.coalesce("end_time", "start_time")).otherwise(F.col("end_time")), "status": F.when(stale, "failed").otherwise(F.col("status"))}
        own = rows.withColumns(failed).select(*SESSIONS.fieldNames(), F.lit("event").alias("change"))
        over = self._over(rows, before, now, number)
        if over is not None:
            own = own.unionByName(over.withColumns(failed).select(*SESSIONS.fieldNames(), F.lit("time").alias("change")))
        own.write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")
        self.manifests.put({"number": number, "now": now})
        for pane in self._panes():
            if (pane + 1) * PANE <= before:  # the batch before has passed it, and is not tried again
                removed(self.spark, f"{self.path}/waiting/pane={pane}")
        removed(self.spark, path)

    def _panes(self) -> list[int]:
        return [int(x[5:]) for x in names(self.spark, f"{self.path}/waiting") if x.startswith("pane=")]

    def _over(self, rows: DataFrame, before: int, now: int, number: int) -> DataFrame | None:
        """Sessions of earlier batches that are due before `now`, weren't at the batch before, and have no later event."""
        passed = [f"{self.path}/waiting/pane={x}" for x in self._panes() if before // PANE <= x <= now // PANE]
        if not passed:
            return None
        held = self.spark.read.option("basePath", f"{self.path}/waiting").schema(_WAITING).parquet(*passed)
        held = held.where((F.col("batch") < number) & (F.col("due") >= before) & (F.col("due") < now)).drop("pane")
        oldest = held.agg(F.min("batch").alias("batch")).first()["batch"]
        if oldest is None:
            return None
        later = rows.select("session_id", F.lit(number).cast("long").alias("_later"))
        if oldest + 1 < number:
            seen = self._changes().where((F.col("batch") > oldest) & (F.col("batch") < number) & (F.col("change") == "event"))
            later = later.unionByName(seen.select("session_id", F.col("batch").alias("_later")))
        last = later.groupBy("session_id").agg(F.max("_later").alias("_later"))
        return held.join(last, "session_id", "left").where(F.coalesce(F.col("_later") <= F.col("batch"), F.lit(True))).drop("_later", "batch")

    def rows(self) -> DataFrame:
        """The sessions table after the latest batch."""
        own = [x for x in SESSIONS.fieldNames() if x != "session_id"]
        last = F.max_by(F.struct(*own), F.struct("batch", F.col("change") == "time")).alias("last")
        return self._changes().groupBy("session_id").agg(last).select("session_id", "last.*")
