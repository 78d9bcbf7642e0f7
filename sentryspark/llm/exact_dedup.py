"""Exact dedup by a tree-merge of sorted digest runs.

Every partition of the input makes one sorted run of (digest, check, id) entries, reduced to
one entry for each text and packed into chunks, each of them sorted and known by its first digest, its head. In each round,
FAN_IN neighbouring runs of a digest range (a shard) are merged: Spark orders chunks by their heads, and a streaming pass
merges their entries, of which those before the newest head are done, so that it holds about a chunk of each run. It keeps the
smallest identifier of each digest, after comparing the full SHA-256 (the check) so that two
texts whose 64-bit digests collide stay apart. A digest has at most FAN_IN entries in a group, so
thousands of copies never meet in one task. The last round leaves one run for each shard.

The number of a run is stored with its keys, so nothing depends on how a later job splits the stored table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentryspark.llm.common import fits, fresh, joined, sized, stored

#: White space as the text comparison sees it.
SPACES = r"[\x20\x09-\x0D]+"
#: Runs that meet in one group.
FAN_IN = 8
#: Shards for each shuffle partition, so that hashing deals them evenly.
SHARDS_PER_PARTITION = 8

#: Entries in a chunk, and chunks that are merged at once.
CHUNK = 256
BLOCK = 64

_RUN = "shard int, run int, head long, digests array<long>, shas binary, keep_ids array<long>, keep_rows array<long>, ns array<long>"
_ENTRY = np.dtype([("shard", "i4"), ("run", "i4"), ("digest", "i8"), ("sha", "S32"), ("absent", "?"), ("id", "i8"), ("row", "i8"), ("n", "i8")])


def _order() -> list:
    return ["shard", "run", "digest", "sha", F.col("keep_id").asc_nulls_last(), "keep_row"]


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _entries(shard, run, digest, sha: bytes, ids: pa.Array, rows, n) -> np.ndarray:
    out = np.zeros(len(digest), _ENTRY)
    out["shard"], out["run"], out["digest"], out["sha"], out["row"], out["n"] = shard, run, digest, np.frombuffer(sha, "S32"), rows, n
    out["absent"], out["id"] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    return out


def _smallest(entries: np.ndarray) -> np.ndarray:
    """Entries in order, the first of each (shard, run, digest, sha) with the sum of the counts. The sort is stable, so ordered stretches are merged."""
    entries = entries[np.lexsort([entries[x] for x in ("row", "id", "absent", "sha", "digest", "run", "shard")])]
    first = np.ones(len(entries), bool)
    first[1:] = np.logical_or.reduce([entries[x][1:] != entries[x][:-1] for x in ("shard", "run", "digest", "sha")])
    at = np.flatnonzero(first)
    kept = entries[at]
    kept["n"] = np.add.reduceat(entries["n"], at)
    return kept


def _packed(entries: np.ndarray) -> pa.RecordBatch:
    """Ordered entries as chunks of their shard and run."""
    new = np.ones(len(entries), bool)
    new[1:] = (entries["shard"][1:] != entries["shard"][:-1]) | (entries["run"][1:] != entries["run"][:-1])
    place = np.arange(len(entries))
    starts = np.flatnonzero((place - np.maximum.accumulate(np.where(new, place, 0))) % CHUNK == 0)
    ends = np.append(starts, len(entries)).astype(np.int32)

    def lists(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends), values)

    shas = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * np.int32(32)), pa.py_buffer(np.ascontiguousarray(entries["sha"]).tobytes())])
    shard, run, head = (pa.array(np.ascontiguousarray(entries[x][starts])) for x in ("shard", "run", "digest"))
    digests, rows, ns = (lists(pa.array(np.ascontiguousarray(entries[x]))) for x in ("digest", "row", "n"))
    ids = lists(pa.array(np.ascontiguousarray(entries["id"]), mask=entries["absent"]))
    return pa.record_batch([shard, run, head, digests, shas, ids, rows, ns], ["shard", "run", "head", "digests", "shas", "keep_ids", "keep_rows", "ns"])


def _unpacked(batch: pa.RecordBatch) -> np.ndarray:
    lengths = pc.list_value_length(batch.column("digests")).to_numpy()
    shard, run = (np.repeat(batch.column(x).to_numpy(), lengths) for x in ("shard", "run"))
    digests, rows, ns = (batch.column(x).flatten().to_numpy() for x in ("digests", "keep_rows", "ns"))
    return _entries(shard, run, digests, b"".join(batch.column("shas").to_pylist()), batch.column("keep_ids").flatten(), rows, ns)


def _merged(blocks: Iterator[tuple[np.ndarray, tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
    """Chunks of the smallest entries of blocks, each with the (shard, run, digest) before which no later block has entries."""
    held = np.zeros(0, _ENTRY)
    for block, (shard, run, digest) in blocks:
        held = _smallest(np.concatenate([held, block]))
        done = (held["shard"] < shard) | (held["shard"] == shard) & ((held["run"] < run) | (held["run"] == run) & (held["digest"] < digest))
        if done.any():
            yield _packed(held[done])
        held = held[~done]
    if len(held):
        yield _packed(held)


def _run_of_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of a run from its entries in order."""

    def blocks():
        for batch in batches:
            if batch.num_rows:
                shard, run, digest, rows, n = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("shard", "run", "digest", "keep_row", "n"))
                block = _entries(shard, run, digest, b"".join(batch.column("sha").to_pylist()), batch.column("keep_id"), rows, n)
                yield block, tuple(block[["shard", "run", "digest"]][-1].tolist())

    yield from _merged(blocks())


def _run_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of the runs that arise from those of several, which come by their heads."""

    def blocks():
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield _unpacked(part), tuple(part.column(x)[-1].as_py() for x in ("shard", "run", "head"))

    yield from _merged(blocks())


def repeated(runs: DataFrame) -> DataFrame:
    """(digest, sha, keep_id, keep_row, n) of the entries that stand for several rows. No Python worker is needed beside those of the merge."""
    entry = "struct(get(digests, i) as digest, substring(shas, 32 * i + 1, 32) as sha, get(keep_ids, i) as keep_id, get(keep_rows, i) as keep_row, n)"
    return runs.where("exists(ns, n -> n > 1)").select(F.explode(F.expr(f"filter(transform(ns, (n, i) -> {entry}), x -> x.n > 1)")).alias("entry")).select("entry.*")


def merge_round(runs: DataFrame, fan_in: int, partitions: int) -> DataFrame:
    """One round: neighbouring runs of each shard are merged, retaining the smallest verified identifier. Only chunks are put in order, no entries."""
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .repartition(partitions, "shard", "run")
        .sortWithinPartitions("shard", "run", "head")
        .mapInArrow(_run_of_chunks, _RUN)
    )


def digest_runs(keyed: DataFrame, shards: int) -> DataFrame:
    """The sorted runs of all partitions, without a shuffle. keyed has the run's number; a run that is read in pieces is whole after the first round."""
    return (
        keyed.select(
            F.pmod(F.shiftright("digest", 16), F.lit(shards)).cast("int").alias("shard"),
            "run", "digest", "sha", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n"),
        )
        .sortWithinPartitions(*_order())
        .mapInArrow(_run_of_entries, _RUN)
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after every run of white space became one space. The row with the
    smallest id of a group stays. Null text counts as empty; null ids sort last; of rows that
    repeat both id and text one stays. An empty table gives no rows; other columns are not read. Very long texts are
    hashed whole, and only hashes travel.
    """
    spark = docs.sparkSession
    text = normalised(docs[text_col])
    keyed = stored(
        docs.select(
            docs[id_col].cast("long").alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().alias("run"),
            F.unhex(F.sha2(text, 256)).alias("sha"),
        ).withColumn("digest", F.xxhash64("sha")),
        "exact-keys",
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last, total = keyed.agg(F.max("run"), F.count(F.lit(1))).first()
    left = (last or 0) + 1
    runs = digest_runs(keyed, partitions * SHARDS_PER_PARTITION)
    while True:  # at least once, as a run may have been read in pieces
        runs, left = merge_round(runs, fan_in, partitions), -(-left // fan_in)
        if left == 1:
            break
    groups = stored(repeated(runs), "exact-groups")
    if fits(groups.count()):
        found = keyed.join(F.broadcast(groups), ["digest", "sha"], "left")
    else:
        found = joined(keyed, groups, ["digest", "sha"], "row", groups.select("digest", "sha", "n"), total)
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called.

    Rows repeating both id and text are one document, of which one row stays.
    """
    key, gone_id, gone_key, again = (fresh(docs, x) for x in ("text_key", "gone_id", "gone_key", "gone_again"))
    judged = exact_duplicates(docs, id_col, text_col).where(~F.col("kept"))
    gone = judged.select(F.col(id_col).alias(gone_id), F.col("text_sha256").alias(gone_key), F.col("keep_id").eqNullSafe(F.col(id_col)).alias(again)).distinct()
    gone = stored(gone, "exact-gone")
    others = gone.where(~F.col(again)).drop(again)
    out = docs.withColumn(key, F.sha2(normalised(docs[text_col]), 256))
    out = out.join(sized(others), (out[key] == others[gone_key]) & out[id_col].cast("long").eqNullSafe(others[gone_id]), "left_anti")
    if gone.where(again).limit(1).count():
        out = out.dropDuplicates([id_col, key])
    return out.drop(key)


def exact_dedup_query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
