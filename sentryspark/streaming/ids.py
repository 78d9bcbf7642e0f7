"""The ids of all events ever accepted, asked by batches.

Ids lie in levels of runs, partitioned by a prefix of their hash, in files with Bloom filters. A batch with few ids sends them
as a filter to the files of their prefixes only: row groups whose range or Bloom filter excludes them are not read. A batch
with many ids joins them with the files of their prefixes. Either way no id is ever too old to be found, and a batch reads about a file of its own size for each
of its prefixes and level, whatever the length of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sentryspark.sources.store import Runs

SCHEMA = StructType([StructField("event_id", StringType())])
#: Ids that go to the files as a filter, at most: Spark makes a chain of comparisons of it.
FILTERED_IDS = 256
#: Bytes of a joined batch's ids that may be broadcast.
BROADCAST_BYTES = 32 << 20
OPTIONS = {"parquet.bloom.filter.enabled#event_id": "true", "parquet.bloom.filter.fpp#event_id": "0.0001", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20)}


class Ids:
    def __init__(self, spark: SparkSession, path: str, fan_in: int = 8, filtered: int = FILTERED_IDS):
        self.spark, self.filtered = spark, filtered
        self.hash = F.shiftrightunsigned(F.xxhash64("event_id"), 1)
        self.runs = Runs(spark, path, SCHEMA, prefix=self.hash, order=["event_id"], fan_in=fan_in, options=OPTIONS)

    def known(self, batch: DataFrame, before: int) -> DataFrame:
        """(event_id) of those ids of `batch` that a batch before number `before` added. batch is read three times at most, its ids only: store it."""
        if not self.runs.state(before)["runs"]:
            return self.spark.createDataFrame([], SCHEMA)
        ids = batch.select("event_id").where("event_id is not null")
        asked = ids.select("event_id", self.hash.alias("hash")).limit(self.filtered + 1).collect()  # FILTERED_IDS + 1 rows at most
        if len(asked) <= self.filtered:
            return self._filtered({r["event_id"]: r["hash"] for r in asked}, before)
        size = ids.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("event_id")).alias("most"), F.collect_set(F.pmod(self.hash, F.lit(self.runs.most))).alias("parts")).first()  # runs.most parts at most
        small = size["n"] * (64 + size["most"]) <= BROADCAST_BYTES
        return self.runs.rows(before, size["parts"]).join(F.broadcast(ids) if small else ids, "event_id", "left_semi").distinct()

    def _filtered(self, asked: dict[str, int], before: int) -> DataFrame:
        if not asked:
            return self.spark.createDataFrame([], SCHEMA)
        own = self.spark.newSession()  # settings of its own: a long list is to reach the files as it is, not as a range
        own.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(len(asked)))
        probe = Runs(own, self.runs.path, SCHEMA, prefix=self.hash, fan_in=self.runs.fan_in)
        found = probe.rows(before, sorted(asked.values())).where(F.col("event_id").isin(list(asked))).distinct().collect()  # of the ids asked for
        return self.spark.createDataFrame([(r["event_id"],) for r in found], SCHEMA)

    def add(self, batch: DataFrame, number: int, note: dict | None = None) -> None:
        """Add the ids of batch `number`, which none before has."""
        size = batch.count()
        self.runs.options = OPTIONS | {"parquet.bloom.filter.expected.ndv#event_id": str(max(1000, min(size, self.runs.PART_ROWS)))}  # a file of any level has about as many
        self.runs.add(batch.select("event_id"), number, note, size)
