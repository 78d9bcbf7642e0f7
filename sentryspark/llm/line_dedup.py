"""Line dedup over levelled sorted runs of line hashes.

A run is a table with one entry for each line key that its batch of documents was the first to have: its 128-bit hash, the
number of documents that hold it and the largest of their ids. Runs are bucketed and sorted by key, one file a
bucket, so joins between them merge sorted files without a shuffle. Each new batch is written as such a table,
too, and merge-anti-joined with the runs: keys that none has become its own run, the others are updates of
counts. Runs live in levels; when a level has FAN_IN runs, they are merged into one of the next
level, so a line hash is rewritten once a level. No key is in two runs.

Which lines are repeated is known once all batches are in. The repeated keys then go to the texts, as sorted arrays in a broadcast,
or, if they are too many for that, as a list for each document, by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.llm.common import discarded, fits, joined, new_path, removed, stored

SPACE_BYTES = b" \t\n\v\f\r"
MIN_POINTS = 20
MIN_DOCS = 3
#: Batches that a bulk load is dealt into, and runs a level holds before they are merged.
BATCHES = 4
FAN_IN = 2
#: Bytes of a repeated key in the arrays of the broadcast, and of a batch's texts that are put together at once.
KEY_BYTES = 32
BATCH_BYTES = 16 << 20


def line_key(line: bytes) -> bytes | None:
    """The 16-byte hash of a line's key; None for keys under MIN_POINTS code points."""
    key = line.strip(SPACE_BYTES).lower()
    if len(key) < MIN_POINTS or len(key) < 4 * MIN_POINTS and len(key.decode("utf-8", "replace")) < MIN_POINTS:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, nums = [], [], batch.column("id").to_pylist()
        for num, text in zip(nums, batch.column("text"), strict=True):
            own = {line_key(x) for x in (text.as_py() or "").encode().split(b"\n")}
            own.discard(None)
            keys += own
            ids += [num] * len(own)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["id", "key"])


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key) for each distinct key of each row."""
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(_keys, "id long, key binary")


@contextmanager
def _sorted_scans(spark: SparkSession):
    """Bucketed tables with one file a bucket are read as sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levels of sorted runs of (key, n_docs, max_id), and updates of their counts, kept in the shared folder."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.fan_in, self.levels = spark, fan_in, []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.updates: list[DataFrame] = []
        self._paths: dict[str, str] = {}

    def _written(self, rows: DataFrame) -> str:
        """The name of a new table with rows, which are partitioned by key."""
        path = new_path(self.spark, "line-run")
        name = path.rpartition("/")[2].replace("-", "_")
        with _sorted_scans(self.spark):
            rows.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self._paths[name] = path
        return name

    def _dropped(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            removed(self.spark, self._paths.pop(name))

    def add(self, keys: DataFrame) -> None:
        """Add a batch of distinct (id, key) rows; a document must lie in one batch. Compacts levels that are full."""
        entries = keys.groupBy("key").agg(F.count("id").alias("n_docs"), F.max("id").alias("max_id"))
        batch = self._written(entries.repartition(self.buckets, "key"))
        if not self.runs():
            self._placed(batch, 0)
            return
        with _sorted_scans(self.spark):
            own = self.spark.table(batch)
            seen = [own.join(self.spark.table(run).select("key").hint("merge"), "key", "left_semi") for run in self.runs()]
            update = seen[0]
            for one in seen[1:]:
                update = update.union(one)
            self.updates.append(stored(update, "line-update"))
            new = self._written(self.unseen(own))
        self._dropped(batch)
        self._placed(new, 0)

    def _placed(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            with _sorted_scans(self.spark):
                merged = self._written(self._merged(full))
            self._dropped(*full)
            self._placed(merged, level + 1)

    def _merged(self, runs: list[str]) -> DataFrame:
        """The entries of runs, no key of which is in two of them: full merge joins, which neither shuffle nor sort."""
        out = self.spark.table(runs[0])
        for run in runs[1:]:
            right = self.spark.table(run).withColumnsRenamed({"n_docs": "n", "max_id": "m"}).hint("merge")
            out = out.join(right, "key", "full").select("key", F.coalesce("n_docs", "n").alias("n_docs"), F.coalesce("max_id", "m").alias("max_id"))
        return out

    def runs(self) -> list[str]:
        """The tables of all levels, those of the lowest, newest level first."""
        return [run for level in self.levels for run in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys that no run holds: a merge-anti-join with one run after another."""
        for run in self.runs():
            keys = keys.join(self.spark.table(run).select("key").hint("merge"), "key", "left_anti")
        return keys

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(key, n_docs, max_id) of the keys that at least min_docs documents hold, over all runs; stored."""
        if not self.runs():
            return self.spark.createDataFrame([], "key binary, n_docs long, max_id long")
        runs = self.spark.table(self.runs()[0])
        for run in self.runs()[1:]:
            runs = runs.union(self.spark.table(run))
        more = self.spark.createDataFrame([], "key binary, n_docs long, max_id long")
        for update in self.updates:
            more = more.union(update)
        more = more.groupBy("key").agg(F.sum("n_docs").alias("n"), F.max("max_id").alias("m"))
        both = runs.join(more, "key", "left").select("key", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("max_id", "m").alias("max_id"))
        return stored(both.where(F.col("n_docs") >= min_docs), "line-repeated")

    def close(self) -> None:
        """Drop all tables."""
        self._dropped(*self.runs())
        discarded(*self.updates)
        self.levels, self.updates = [], []


_OUT = "id long, text string, n_lines long, n_dropped long"


def _filtered(doomed):
    """Texts without the lines that doomed(keys, rows, batch) marks; a line without a key is never asked about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            sizes = np.cumsum([0, *(len(x.as_py() or "") for x in whole.column("text"))])
            while at < whole.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BATCH_BYTES, "right")) - 1)
                batch, at = whole.slice(at, stop - at), stop
                bodies = [(x.as_py() or "").encode().split(b"\n") for x in batch.column("text")]
                keys = [line_key(x) for body in bodies for x in body]
                rows = np.repeat(np.arange(len(bodies)), list(map(len, bodies)))
                asked = np.array([k for k, key in enumerate(keys) if key is not None], np.int64)
                drop = np.zeros(len(keys), bool)
                if len(asked):
                    drop[asked] = doomed([keys[k] for k in asked], rows[asked], batch)
                ends = np.cumsum(list(map(len, bodies)))
                texts = [b"\n".join(x for x, d in zip(body, drop[end - len(body) : end].tolist(), strict=True) if not d).decode() for body, end in zip(bodies, ends, strict=True)]
                dropped = np.bincount(rows[drop], minlength=len(bodies))
                yield pa.record_batch([batch.column("id"), pa.array(texts, pa.string()), pa.array(list(map(len, bodies)), pa.int64()), pa.array(dropped, pa.int64())], ["id", "text", "n_lines", "n_dropped"])

    return run


def _by_lookup(repeated: DataFrame):
    """Marks lines by repeated keys in sorted arrays, of which the driver gets and sends as many as common.fits() allows."""
    table = repeated.select("key", "max_id").orderBy("key").toArrow().combine_chunks()
    keys = np.frombuffer(b"".join(table.column("key").to_pylist()), "S16")
    shared = repeated.sparkSession.sparkContext.broadcast((keys, table.column("max_id").to_numpy()))

    def doomed(asked: list[bytes], rows: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        known, keepers = shared.value
        own = np.frombuffer(b"".join(asked), "S16")
        if not len(known):
            return np.zeros(len(own), bool)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        ids = batch.column("id")
        nums, valid = ids.fill_null(0).to_numpy(zero_copy_only=False)[rows], ids.is_valid().to_numpy(zero_copy_only=False)[rows]
        return (known[at] == own) & valid & (nums != keepers[at])

    return doomed


def _by_list(asked: list[bytes], rows: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Marks lines by each row's own list."""
    gone = [set(x or ()) for x in batch.column("gone").to_pylist()]
    return np.array([key in gone[row] for key, row in zip(asked, rows.tolist(), strict=True)], bool)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row for each row of docs: id_col, text (kept lines joined by newlines), n_lines, n_dropped.

    Texts split at newlines; null and empty texts are one empty line. A line's key is the line
    without white space at its ends, A-Z lower-cased. Keys of MIN_POINTS code points or more that
    min_docs documents or more hold lose their lines everywhere but in the largest id that has
    them. Rows repeating an id count as one document, and each is filtered. Rows with a null id
    neither count nor lose lines. An empty table gives no rows; only the two columns named are read. Very long texts are split whole, one at a time.
    """
    spark = docs.sparkSession
    path = new_path(spark, "line-keys")
    line_keys(docs, id_col, text_col).where("id is not null").withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("id long, key binary, batch int").parquet(path)
    again = docs.groupBy(docs[id_col].cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and id is not null").limit(1).count()
    keys = keys.distinct() if again else keys
    runs = LineRuns(spark)
    for batch in range(batches):
        runs.add(keys.where(F.col("batch") == batch).select("id", "key"))
    repeated = runs.repeated(min_docs)
    runs.close()
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    if fits(repeated.count(), KEY_BYTES):
        removed(spark, path)
        return texts.mapInArrow(_filtered(_by_lookup(repeated)), _OUT).withColumnRenamed("id", id_col)
    held = joined(keys.select("id", "key"), repeated.select("key", "max_id"), "key", "id", repeated.select("key", F.col("n_docs").alias("n")), keys.count(), "inner")
    gone = held.where("id < max_id").groupBy("id").agg(F.collect_set("key").alias("gone"))
    return texts.join(gone, "id", "left").mapInArrow(_filtered(_by_list), _OUT).withColumnRenamed("id", id_col)


def line_dedup_query(spark, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, line, lower_az AS key FROM (
    SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.*, k.key IS NULL OR l.doc_id = k.keeper AS kept FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
