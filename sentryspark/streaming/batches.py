"""Batches that sensors sent, as files in a landing folder: each is judged as a whole, and its events are ingested.

A file is one JSON object with node_id, node_key and events. Spark's own file stream tracks which files a micro-batch had, in its
checkpoint and on whatever file system they lie, so a restart repeats a micro-batch with the same files; what it writes replaces what the failed
try wrote. The name of a file is the batch's id. Many small batches land packed: each is a line of a file, with its id before a tab,
as a file for each would cost more to list and open than to read.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.streaming import StreamingQuery

from sentryspark.config import DEFAULT, Config
from sentryspark.functions.jsontext import loaded
from sentryspark.sources.tables import new_folder, removed
from sentryspark.streaming.pipeline import ingested

MOST = 20
_BATCH = pa.struct([("sender", pa.string()), ("digest", pa.string()), ("nodes", pa.list_(pa.string())), ("events", pa.list_(pa.string()))])


def _text(value) -> str | None:
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) else None


def _read(bodies: pa.Array) -> pa.Array:
    out = []
    for body in bodies.to_pylist():
        batch, _ = loaded(body)
        events = batch.get("events") if isinstance(batch, dict) else None
        if not isinstance(events, list):
            out.append({"sender": _text(batch.get("node_id")) if isinstance(batch, dict) else None})
            continue
        key = batch.get("node_key")
        out.append({
            "sender": _text(batch.get("node_id")), "digest": hashlib.sha256(key.encode("utf-8", "replace")).hexdigest() if isinstance(key, str) else None,
            "nodes": [_text(x.get("node_id")) if isinstance(x, dict) else None for x in events], "events": [json.dumps(x).replace("\n", " ") for x in events],
        })
    return pa.array(out, _BATCH)


_reader = F.arrow_udf(_read, from_arrow_type(_BATCH))


def landed(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """A stream of (value, file): the batches that land in a folder, each read whole."""
    stream = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).text(folder)
    return stream.select("value", F.col("_metadata.file_path").alias("file"))


def landed_packed(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """As landed(), of files in which each line is a batch: its id, a tab, its object without line breaks. `file` is the id; a line without a tab has none and is a body that can't be read as one."""
    stream = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    named = F.instr("value", "\t") > 0
    return stream.select(F.when(named, F.col("value").substr(F.instr("value", "\t") + 1, F.length("value"))).otherwise(F.col("value")).alias("value"), F.when(named, F.substring_index("value", "\t", 1)).alias("file"))


def judged(batches: DataFrame, keys: dict[str, str], most: int = MOST) -> DataFrame:
    """(batch_id, sender, status, reason, events) of (value, file).

    status is 200, or 422 for a body without a list of events or with none or too many, 401 for a sender without the right key, 403 for events in another
    sensor's name; a bad body comes first, then the key, the size, the names. keys: sensors with the SHA-256 of their keys, in hex.
    """
    own = batches.withColumn("batch", _reader(F.col("value")))
    digest = F.element_at(F.create_map(*(F.lit(x) for pair in keys.items() for x in pair)), F.col("batch.sender")) if keys else F.lit(None).cast("string")
    size = F.coalesce(F.size("batch.events"), F.lit(0))
    known = F.coalesce(digest == F.col("batch.digest"), F.lit(False))
    foreign = F.exists("batch.nodes", lambda x: ~x.eqNullSafe(F.col("batch.sender")))
    say = lambda status, reason=None: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    why = F.when(F.col("batch.events").isNull() | (size == 0), say(422, "no events")).when(~known, say(401, "unknown sender or key"))
    why = why.when(size > most, say(422, f"more than {most} events")).when(foreign, say(403, "node_id differs from the sender's")).otherwise(say(200))
    out = own.withColumn("why", why)
    return out.select(F.regexp_replace("file", r"^.*/", "").alias("batch_id"), "batch.sender", "why.status", "why.reason", "batch.events", "file")


def taken_in(batches: DataFrame, number: int, out: str, keys: dict[str, str], received_at, most: int = MOST, config: Config = DEFAULT) -> None:
    """Add micro-batch `number` of (value, file): what was decided of each batch to out/batches, events of good ones to the log as pipeline.ingested() does."""
    spark = batches.sparkSession
    path = new_folder(spark, "judged")
    judged(batches, keys, most).write.parquet(path)
    rows = spark.read.parquet(path)
    rows.drop("events").write.mode("overwrite").parquet(f"{out}/batches/batch={number}")
    ingested(rows.where("status = 200").select(F.explode("events").alias("value")), number, out, received_at, config)
    removed(spark, path)


def take_in(spark: SparkSession, source: str, out: str, checkpoint: str, keys: dict[str, str], received_at=None, trigger: dict | None = None, files: int = 100, most: int = MOST, config: Config = DEFAULT) -> StreamingQuery:
    """Start taking in batches that land in folder `source`; by default all that is there, then stop."""
    arrival = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if received_at is None else received_at
    step = lambda batch, number: taken_in(batch, number, out, keys, arrival, most, config)
    return landed(spark, source, files).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
