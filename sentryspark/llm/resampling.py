"""Target-distribution importance resampling over hashed word runs, with overlap chunking of long texts.

A feature is a run of up to n words; it counts in one of BUCKETS bins by its crc32. The share of each bin in a target corpus against that in the
raw one gives a gain, a document's weight is the mean gain of its features, and documents are drawn without replacement by weight plus Gumbel noise
that follows from their ids.

Lengths are skewed: one text can be longer than a partition of others. A text over CHUNK_POINTS is cut at word boundaries into chunks, which are dealt
out over all tasks and stored. Each chunk carries the n-1 words that follow it, so that runs across its end are seen, and owns the runs that begin in
it: sums over chunks are those over the text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentryspark.llm.common import fresh, load, stored, text_slices

BUCKETS = 10_000
CHUNK_POINTS = 1 << 16
MAX_WORDS = 1
MIN_WORDS = 20
DRAWN_PERCENT = 10
SALT = 2024
#: Code points that are looked at at once, and distinct runs whose bins are remembered.
BATCH_POINTS = 4 << 20
REMEMBERED = 1 << 18
#: A-Z to lower case, every other byte of ASCII but digits and a-z to a space.
_WORDS = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def runs_of(words: list[bytes], owned: int, max_words: int) -> list[bytes]:
    """The runs of 1 to max_words words that begin within the first `owned` words."""
    out = words[:owned]
    for n in range(2, max_words + 1):
        out = out + [b" ".join(words[k : k + n]) for k in range(min(owned, len(words) - n + 1))]
    return out


def chunks_of(text: str, points: int, carried: int) -> Iterator[tuple[str, int]]:
    """(chunk with the words it carries, words that it owns): cut after `points` code points, at the end of the word that is there."""
    word = lambda c: c >= "\x80" or c.isalnum()
    at = 0
    while at < len(text):
        end = min(at + points, len(text))
        while end < len(text) and word(text[end]) and word(text[end - 1]):
            end += 1
        owned, stop = len(words_of(text[at:end])), end
        for _ in range(carried):
            while stop < len(text) and not word(text[stop]):
                stop += 1
            while stop < len(text) and word(text[stop]):
                stop += 1
        yield text[at:stop], owned
        at = end


def _chunked(points: int, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                parts = list(chunks_of(row["text"], points, carried))
                for k in range(0, len(parts), 16):
                    some = parts[k : k + 16]
                    yield pa.record_batch(
                        [pa.array([row["row"]] * len(some), pa.int64()), pa.array([row["id"]] * len(some), pa.int64()), pa.array(range(k, k + len(some)), pa.int64()), pa.array([x for x, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())],
                        ["row", "id", "chunk", "text", "owned"],
                    )

    return run


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, points: int = CHUNK_POINTS) -> tuple[DataFrame, DataFrame]:
    """docs as (row, id, text, owned), owned being null, of texts up to `points` code points, and the stored chunks of longer ones, dealt out over all tasks."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    long = F.coalesce(F.length("text") > points, F.lit(False))
    parts = rows.where(long).mapInArrow(_chunked(points, max_words - 1), "row long, id long, chunk long, text string, owned long")
    return rows.where(~long).withColumn("owned", F.lit(None).cast("long")), stored(parts.repartition("row", "chunk").drop("chunk"), "chunks")


class _Bins(dict):
    """Runs to their bins, or to what `of` says of these; forgets all when it is full."""

    def __init__(self, bins: int, of=None):
        super().__init__()
        self.bins, self.of = bins, of

    def __missing__(self, run: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = zlib.crc32(run) % self.bins
        self[run] = found = found if self.of is None else self.of[found]
        return found


def _features(part: pa.RecordBatch, max_words: int) -> Iterator[tuple[list[bytes], int]]:
    for text, owned in zip(part.column("text").to_pylist(), part.column("owned").to_pylist(), strict=True):
        words = words_of(text)
        own = len(words) if owned is None else owned
        yield runs_of(words, own, max_words), own


def bin_counts(rows: DataFrame, max_words: int, bins: int) -> DataFrame:
    """(bin, n) from (row, id, text, owned): features are summed per task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, known = np.zeros(bins, np.int64), _Bins(bins)
        for batch in batches:
            for part in text_slices(batch, "text", BATCH_POINTS):
                seen = Counter()
                for features, _ in _features(part, max_words):
                    seen.update(features)
                np.add.at(sums, np.fromiter(map(known.__getitem__, seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
        used = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(sums[used], pa.int64())], ["bin", "n"])

    return rows.select("text", "owned").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], bins: int) -> list[int]:
    """1000 times the log of each bin's share in the target against that in the raw corpus, both smoothed by one a bin, rounded down."""
    s, t = sum(raw.values()), sum(target.values())
    return [math.floor(1000 * math.log(float(target.get(k, 0) + 1) * float(s + bins) / (float(raw.get(k, 0) + 1) * float(t + bins)))) for k in range(bins)]


def weighed(rows: DataFrame, gain: list[int], max_words: int, bins: int) -> DataFrame:
    """(row, id, n_words, n_features, total) of each row: its features and the sum of their gains."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Bins(bins, shared.value)
        for batch in batches:
            for part in text_slices(batch, "text", BATCH_POINTS):
                found = [(own, len(x), sum(map(known.__getitem__, x))) for x, own in _features(part, max_words)]
                yield pa.record_batch([part.column("row"), part.column("id"), *(pa.array([x[k] for x in found], pa.int64()) for k in range(3))], ["row", "id", "n_words", "n_features", "total"])

    return rows.mapInArrow(run, "row long, id long, n_words long, n_features long, total long")


def floor_div(a, b) -> F.Column:
    """a / b of whole numbers, b positive, rounded down: exact."""
    return F.expr(f"({a} - pmod({a}, {b})) div {b}")


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_words: int = MAX_WORDS, bins: int = BUCKETS, points: int = CHUNK_POINTS) -> DataFrame:
    """(row, id, n_words, n_features, weight) for each row of docs, row being unique; null and empty texts have no features and weight 0."""
    short, long = chunked(docs, id_col, text_col, max_words, points)
    near, far = chunked(target.select(F.lit(None).cast("long").alias("id"), target[target_col].alias("text")), "id", "text", max_words, points)
    whole = lambda a, b: {r["bin"]: r["n"] for r in bin_counts(a.unionByName(b), max_words, bins).collect()}  # noqa: E731  # at most `bins` rows
    gain = gains(whole(short, long), whole(near, far), bins)
    parts = weighed(long, gain, max_words, bins).groupBy("row", "id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "total")))
    own = weighed(short, gain, max_words, bins).unionByName(parts)
    return own.withColumn("weight", F.when(F.col("n_features") > 0, floor_div("total", "n_features")).otherwise(F.lit(0).cast("long"))).drop("total")


def ranked(rows: DataFrame, quota: int) -> DataFrame:
    """(row, rank) of the `quota` highest scores, ties to the smaller id, of stored rows (row, id, score).

    Scores are whole numbers of a range that doesn't grow with the rows, so their counts are a small table: it gives each
    score the place at which its rows begin, and only rows of one score are ordered among themselves.
    """
    counts = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)))
    places = before.select("score", F.coalesce("before", F.lit(0).cast("long")).alias("before")).where(F.col("before") < quota)
    placed = rows.join(places, "score").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("id", "row")))
    return placed.where(F.col("rank") <= quota).select("row", "rank")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_words: int = MAX_WORDS, bins: int = BUCKETS,
    min_words: int = MIN_WORDS, percent: int = DRAWN_PERCENT, salt: int = SALT, points: int = CHUNK_POINTS,
) -> DataFrame:
    """A row for each row of docs: id_col, n_features, weight, score and rank, which is null for documents that aren't drawn.

    Words are runs of digits, a-z and what lies beyond ASCII, A-Z lower-cased. Of the documents with at least min_words words, `percent` percent, rounded down, are
    drawn, those of the highest scores; ties go to the smaller id. Null and empty texts have no features, weight 0, and are not drawn. Rows repeating an id are
    documents of their own with the same noise; a null id counts as an empty one and comes first among ties. An empty table gives no rows, an empty target gains of bins without
    a target feature. Very long texts are counted whole, in chunks. Only the columns named are read.
    """
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    rows = stored(weights(docs, target, id_col, text_col, target_col, max_words, bins, points).withColumn("score", F.col("weight") + gumbel), "weights")
    able = rows.where(F.col("n_words") >= min_words)
    quota = percent * able.count() // 100
    name = fresh(rows, "rank")
    out = rows.join(ranked(able.select("row", "id", "score"), quota).withColumnRenamed("rank", name), "row", "left")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col(name).alias("rank"))


def resampling_query(spark, sf_dir: str) -> DataFrame:
    return resampled(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FEATURES = rf"""SELECT {{id}} AS id, unnest(list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM {{table}}"""
ORACLE = rf"""
WITH RECURSIVE c(i, v, step) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, step + 1 FROM c WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM c WHERE step = 8),
d AS ({_FEATURES.replace("{id}", "doc_id").replace("{table}", "documents")}), b AS ({_FEATURES.replace("{id}", "item_id").replace("{table}", "benchmark")}),
w AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(1, octet_length(encode(word)) + 1), lambda k: ('0x' || hex(encode(word))[2 * k - 1:2 * k])::BIGINT), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::BIGINT)) % 10000 AS bin
      FROM (SELECT DISTINCT word FROM (SELECT word FROM d UNION ALL SELECT word FROM b)), crc),
s AS (SELECT bin, count(*) AS s FROM d JOIN w USING (word) GROUP BY 1), t AS (SELECT bin, count(*) AS t FROM b JOIN w USING (word) GROUP BY 1),
g AS (SELECT bin, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (SELECT unnest(range(10000)) AS bin) LEFT JOIN s USING (bin) LEFT JOIN t USING (bin)),
f AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS total FROM d JOIN w USING (word) JOIN g USING (bin) GROUP BY 1),
o AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
             ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM documents LEFT JOIN f ON f.id = doc_id),
p AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM o),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM p WHERE n_features >= 20)
SELECT p.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM p LEFT JOIN r USING (doc_id)
"""
