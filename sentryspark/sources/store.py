"""Tables that grow by numbered batches: levels of runs, and snapshots by buckets.

Both are folders of Parquet with small text files that say what is valid. A text file comes into being by one rename, so a reader sees
a table before a batch or after it, and a batch that is tried again begins from what was valid before it. What a
batch replaces is deleted only when the next one is in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sentryspark.sources.tables import removed

Merge = Callable[[DataFrame], DataFrame]


# -- small files ------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    where, files = _path(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file whole or not at all."""
    where, files = _path(spark, path)
    part, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(where, False)
    if not files.rename(part, where):
        raise OSError(f"could not rename to {path}")


def get_text(spark: SparkSession, path: str) -> str:
    where, files = _path(spark, path)
    source = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


class _Manifests:
    """States by batch number; the last few are kept."""

    KEPT = 3

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/_manifest"

    def _numbers(self) -> list[int]:
        return [int(x[:-5]) for x in names(self.spark, self.path) if x.endswith(".json")]

    def last(self, before: int | None = None) -> dict | None:
        """The state after the latest batch, or the latest before number `before`."""
        known = [x for x in self._numbers() if before is None or x < before]
        return json.loads(get_text(self.spark, f"{self.path}/{max(known):020d}.json")) if known else None

    def put(self, state: dict) -> None:
        number = state["number"]
        put_text(self.spark, f"{self.path}/{number:020d}.json", json.dumps(state))
        for old in sorted(x for x in self._numbers() if x < number)[: -self.KEPT]:
            removed(self.spark, f"{self.path}/{old:020d}.json")


# -- levels of runs ---------------------------------------------------------


class Runs:
    """Rows of batches in levels of runs: fan_in runs of a level are merged into one of the next, so a row is rewritten once a level.

    merge makes the rows of several runs one run's, such as by adding partial sums; without it rows are kept as they are. With
    prefix, a whole number of 0 or more for each row, a run is partitioned by prefix modulo fan_in ** level: a file then has about as many rows as a
    batch, however large the log is, and readers who know the prefixes they want open only these. A batch whose number of rows is given begins
    with more parts, so that none has many more than PART_ROWS, and no task a whole batch.
    """

    PART_ROWS = 250_000

    def __init__(self, spark: SparkSession, path: str, schema: StructType, merge: Merge | None = None, prefix: Column | None = None, order: list[str] | None = None, fan_in: int = 8, most: int = 4096, options: dict[str, str] | None = None):
        self.spark, self.path, self.schema, self.merge, self.prefix, self.order = spark, path, schema, merge, prefix, order
        self.fan_in, self.most, self.options, self.manifests = fan_in, 1, options or {}, _Manifests(spark, path)
        while self.most * fan_in <= most:  # a power of fan_in, so that a row's prefix in a run follows from that in a larger one
            self.most *= fan_in

    def state(self, before: int | None = None) -> dict:
        return self.manifests.last(before) or {"number": -1, "runs": [], "gone": [], "note": {}}

    def _parts(self, size: int) -> int:
        """Parts of a batch of so many rows: a power of fan_in, too."""
        parts = 1
        while parts * self.PART_ROWS < size and parts < self.most:
            parts *= self.fan_in
        return parts

    def _folder(self, run: dict) -> str:
        return f"{self.path}/{run['name']}"

    def _written(self, rows: DataFrame, name: str, level: int, parts: int) -> dict:
        run = {"name": name, "level": level, "parts": parts, "full": []}
        if self.prefix is not None:
            part = F.pmod(self.prefix, F.lit(run["parts"])).cast("int")
            rows = rows.withColumn("prefix", part)
            rows = (rows.coalesce(1) if run["parts"] == 1 else rows.repartition("prefix")).sortWithinPartitions("prefix", *(self.order or []))
            rows.write.mode("overwrite").options(**self.options).partitionBy("prefix").parquet(self._folder(run))
            run["full"] = [int(x[7:]) for x in names(self.spark, self._folder(run)) if x.startswith("prefix=")]
        else:
            rows = rows.sortWithinPartitions(*self.order) if self.order else rows
            rows.write.mode("overwrite").options(**self.options).parquet(self._folder(run))
        return run

    def _rows(self, run: dict, prefixes: list[int] | None = None) -> DataFrame | None:
        reader = self.spark.read.schema(self.schema)
        if self.prefix is None:
            return reader.parquet(self._folder(run))
        wanted = set(run["full"]) if prefixes is None else set(run["full"]) & {x % run["parts"] for x in prefixes}
        if not wanted:
            return None
        return reader.option("recursiveFileLookup", True).parquet(*(f"{self._folder(run)}/prefix={x}" for x in sorted(wanted)))

    def rows(self, before: int | None = None, prefixes: list[int] | None = None) -> DataFrame:
        """The rows of all runs; with merge, those of several runs are not merged yet. With prefixes, only files that may hold these."""
        found = [x for run in self.state(before)["runs"] if (x := self._rows(run, prefixes)) is not None]
        out = self.spark.createDataFrame([], self.schema)
        for one in found:
            out = out.union(one)
        return out

    def add(self, rows: DataFrame, number: int, note: dict | None = None, size: int = 0) -> None:
        """Add batch `number`, which replaces that batch if it was added before. note is kept with the state; size is the number of rows, about."""
        before = self.state(number)
        runs, gone = list(before["runs"]), []
        made = self._written(rows.select(*self.schema.fieldNames()), f"run-{number:012d}-0", 0, self._parts(size))
        runs.append(made)
        level = 0
        while len(full := [x for x in runs if x["level"] == level]) >= self.fan_in:
            whole = None
            for run in full:
                one = self._rows(run)
                whole = one if whole is None else whole if one is None else whole.union(one)
            whole = self.spark.createDataFrame([], self.schema) if whole is None else whole
            whole = self.merge(whole).select(*self.schema.fieldNames()) if self.merge else whole
            runs = [x for x in runs if x["level"] != level] + [self._written(whole, f"run-{number:012d}-{level + 1}", level + 1, min(self.most, self.fan_in * max(x["parts"] for x in full)))]
            gone += [x["name"] for x in full]
            level += 1
        self.manifests.put({"number": number, "runs": runs, "gone": gone, "note": note or {}})
        for name in before["gone"]:  # replaced by the batch before, which is not tried again
            removed(self.spark, f"{self.path}/{name}")


# -- snapshots by buckets ----------------------------------------------------


class Snapshot:
    """One row a key, in buckets of keys. An upsert reads and writes only the buckets that its keys fall into; a commit file says which version of each bucket is valid."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.manifests = spark, path, schema, key, _Manifests(spark, path)
        self.buckets = (self.manifests.last() or {}).get("count", buckets)

    def state(self, before: int | None = None) -> dict:
        return self.manifests.last(before) or {"number": -1, "count": self.buckets, "buckets": {}, "gone": []}

    def bucket(self, column: str | Column | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if column is None else column), F.lit(self.buckets)).cast("int")

    def rows(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        held = self.state(before)["buckets"]
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in held.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths)

    def upsert(self, new: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Merge new rows, as batch `number`, with the old ones of their buckets: merge(old, new) gives the buckets' rows. Gives the touched buckets."""
        before = self.state(number)
        touched = sorted(r[0] for r in new.select(self.bucket()).distinct().collect())  # `buckets` rows at most
        if not touched:
            self.manifests.put(before | {"number": number, "gone": []})
            return []
        merged = merge(self.rows(number, touched), new).select(*self.schema.fieldNames())
        folder = f"{self.path}/version={number}"
        merged.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        made = {x[7:] for x in names(self.spark, folder) if x.startswith("bucket=")}
        held = {b: v for b, v in before["buckets"].items() if int(b) not in touched} | {b: number for b in made}
        gone = [f"version={before['buckets'][str(b)]}/bucket={b}" for b in touched if str(b) in before["buckets"]]
        self.manifests.put({"number": number, "count": self.buckets, "buckets": held, "gone": gone})
        for name in before["gone"]:
            removed(self.spark, f"{self.path}/{name}")
        return touched
