"""Phrase collocation mining with pivot partitioning, as in MG-FSM.

Words are ordered by their frequency, and an n-gram's pivot is its rarest word, at its first place if it is there twice. Frequent words get codes in that
order; a word under the minimum can't be in a frequent phrase and cuts the text. Around each word, the stretch of words that are no rarer is
what n-grams with this pivot can consist of: such windows are all that is sent to the pivot's partition, equal ones of a batch once, with their number.
Frequent words, which would make hot partitions, have next to no windows, as nearly all their neighbours are rarer.

A partition mines its windows alone, from short n-grams to longer ones, and gives only n-grams whose pivot is its own, so a count is whole
where it is made. Pivots with too many windows are split by the windows' hash, and a partition that outgrows its buffer is mined in pieces; only their counts meet in
another aggregation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentryspark.llm.common import load, matched, stored, text_slices

MAX_WORDS = 4
MIN_COUNT = 30
#: 100 times a longer candidate's count from this share of a phrase's count on, the phrase is part of it.
SUBSUMED = 80
TOP = 2000
SCALE = 2_000_000
#: Words with a code that says their rank, and bytes that such a word may have; others have a hash, which orders them behind these.
RANKED = 1 << 17
RANKED_BYTES = 256
HASHED = 1 << 62
#: Bits of the filter that tells hashes of frequent words from those of others.
FILTER_BITS = 1 << 23
#: Code points that are looked at at once, distinct words that a task counts before it sends them on.
BATCH_POINTS = 3 << 20
COUNTED = 1 << 18
#: Windows that a partition should have, and those that it mines at once.
PART_WINDOWS = 1 << 19
MINED_WINDOWS = 1 << 21

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Piece marks become a byte that UTF-8 doesn't have, so that no white space but that between words is left.
_MARK = b"\xff"
_MARKS = b".,;:!?\n\v\f\r"
_TABLE = bytes.maketrans(_UPPER + _MARKS + b"\t", _LOWER + _MARK * len(_MARKS) + b" ")


def tokens_of(text: str | None) -> list[bytes]:
    """Words, and _MARK where a piece ends."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).replace(_MARK, b" \xff ").split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for lang, own in seen.items():
            own.pop(_MARK, None)
            words = list(own)
            for k in range(0, len(words), 1 << 16):
                some = words[k : k + (1 << 16)]
                yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array([x.decode() for x in some], pa.string()), pa.array([own[x] for x in some], pa.int64())], ["lang", "word", "n"])
        seen.clear()

    for batch in batches:
        for part in text_slices(batch, "text", BATCH_POINTS):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(tokens_of(text))
            if sum(map(len, seen.values())) > COUNTED:
                yield from emptied()
    yield from emptied()


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) from (lang, text)."""
    return texts.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _hash(lang: str, word: bytes, turn: int) -> int:
    return xxhash.xxh64_intdigest(f"{turn}\0{lang}\0".encode() + word, seed=42) & (HASHED - 1) | HASHED


def coded(words: DataFrame, ranked: int = RANKED) -> tuple[DataFrame, int]:
    """The stored table (lang, word, f, code) of frequent words, and the turn of the hash in which no two codes are equal."""
    best = words.where(F.octet_length("word") <= RANKED_BYTES).orderBy(F.desc("f"), "lang", "word").limit(ranked)
    top = best.select("lang", "word", F.row_number().over(Window.orderBy(F.desc("f"), "lang", "word")).cast("long").alias("rank"))  # RANKED rows at most
    rows = stored(words.join(F.broadcast(stored(top, "ranked-words")), ["lang", "word"], "left"), "frequent-words")
    turn = 0
    while True:
        number = F.xxhash64(F.concat(F.lit(f"{turn}\0"), "lang", F.lit("\0"), "word")).bitwiseAND(F.lit(HASHED - 1)).bitwiseOR(F.lit(HASHED))
        out = rows.select("lang", "word", "f", F.coalesce("rank", number).alias("code"))
        if out.where(F.col("code") >= HASHED).groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0:
            return stored(out, "coded-words"), turn
        turn += 1


class _Codes(dict):
    """Words of one language to codes; 0 for those that aren't frequent, and for the end of a piece, whatever the filter says of its hash."""

    def __init__(self, lang: str, known: dict[bytes, int], turn: int, bits):
        super().__init__({**known, _MARK: 0})
        self.lang, self.turn, self.bits = lang, turn, bits

    def __missing__(self, word: bytes) -> int:
        if self.bits is None:
            return 0
        code = _hash(self.lang, word, self.turn)
        at = code & (FILTER_BITS - 1)
        return code if int(self.bits[at >> 6]) >> (at & 63) & 1 else 0


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row."""
    out = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for column in columns:
        out ^= column.astype(np.uint64)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out


def windows_of(codes: np.ndarray, reach: int) -> list[np.ndarray]:
    """Pivots, their left neighbours, nearest first, and their right ones: what n-grams with the pivot at its first place can consist of; 0 ends a side."""
    n, padded = len(codes), np.concatenate([np.zeros(reach, np.int64), codes, np.zeros(reach, np.int64)])
    left, right = [], []
    for side, step in ((left, -1), (right, 1)):
        on = codes > 0
        for k in range(1, reach + 1):
            near = padded[reach + step * k : reach + step * k + n]
            on = on & (near > 0) & ((near < codes) if step < 0 else (near <= codes))
            side.append(np.where(on, near, 0))
    some = (left[0] > 0) | (right[0] > 0)
    return [column[some] for column in (codes, *left, *right)]


def _sent(shared, turn: int, bits, reach: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = shared.value
        tables: dict[str, _Codes] = {}
        for batch in batches:
            for part in text_slices(batch, "text", BATCH_POINTS):
                codes: list[int] = []
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if lang not in tables:
                        tables[lang] = _Codes(lang, known.get(lang, {}), turn, bits)
                    codes += map(tables[lang].__getitem__, tokens_of(text))
                    codes.append(0)
                columns = windows_of(np.array(codes, np.int64), reach)
                if len(columns[0]):
                    yield from _packed(columns, split, buckets)

    return run


def _packed(columns: list[np.ndarray], split: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, wide, windows): windows in order of their buckets, equal ones once, as a matrix with the counts and then the columns."""
    own = _mixed(columns)
    pivot = columns[0]
    parts = split[np.minimum(pivot, len(split) - 1)]
    bucket = (_mixed([pivot, (own % parts.astype(np.uint64)).astype(np.int64)]) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((own, bucket))
    bucket, columns = bucket[order], [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)  # a window that a clash of hashes splits is sent twice
    starts = np.flatnonzero(new)
    columns = [np.diff(np.append(starts, len(order))), *(c[starts] for c in columns)]
    bucket = bucket[starts]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    out = [[], [], []]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        matrix = np.array([c[a:b] for c in columns])
        wide = bool(matrix.max() >= 1 << 31)
        for value, to in zip((int(bucket[a]), wide, matrix.astype("<i8" if wide else "<i4").tobytes()), out, strict=True):
            to.append(value)
    yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.binary())], ["bucket", "wide", "windows"])


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal rows: the place of one of them, the sum of their n, and for each row the number of its sum."""
    own = _mixed(columns)
    order = np.argsort(own, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    if np.any(new[1:] & (own[order][1:] == own[order][:-1])):  # a clash of hashes
        order = np.lexsort(columns)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    starts = np.flatnonzero(new)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[starts], np.add.reduceat(n[order], starts), which


def mined(columns: list[np.ndarray], whole: np.ndarray, reach: int, min_count: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(n-gram columns, counts, whole) of n-grams around the pivots, by their lengths to the left and right.

    columns: counts of windows, pivots, left and right neighbours. Where `whole` holds, all windows of a pivot are here: n-grams under
    min_count are left out then, with all that hold them.
    """
    n, pivot, left, right = columns[0], columns[1], columns[2 : 2 + reach], columns[2 + reach :]
    reached = {side: np.sum([c > 0 for c in near], axis=0) for side, near in (("left", left), ("right", right))}
    for size in range(1, reach + 1):
        for a in range(size, -1, -1):
            b = size - a
            at = np.flatnonzero((reached["left"] >= a) & (reached["right"] >= b))
            if not len(at):
                continue
            own = [left[k][at] for k in range(a - 1, -1, -1)] + [pivot[at]] + [right[k][at] for k in range(b)]
            first, sums, which = _summed(own, n[at])
            rare = (sums < min_count) & whole[at][first]
            if not a or not b:  # beyond an end that is rare, nothing is frequent
                side = "left" if a else "right"
                gone = at[rare[which]]
                reached[side][gone] = np.minimum(reached[side][gone], size - 1)
            keep = ~rare
            yield [c[first][keep] for c in own], sums[keep], whole[at][first][keep]


def _mining(shared, reach: int, min_count: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, split = shared.value
        held: list[np.ndarray] = []
        bucket, cut, size = None, False, 0

        def emptied(complete: bool) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            columns = list(np.concatenate(held, axis=1))
            held.clear()
            whole = (split[np.minimum(columns[1], len(split) - 1)] == 1) & complete
            for grams, sums, final in mined(columns, whole, reach, min_count):
                rows = np.stack(grams, axis=1)
                for k in range(0, len(rows), 1 << 16):
                    some = rows[k : k + (1 << 16)]
                    codes = pa.ListArray.from_arrays(pa.array(np.arange(0, some.size + 1, some.shape[1]), pa.int32()), pa.array(some.ravel(), pa.int64()))
                    yield pa.record_batch([codes, pa.array(sums[k : k + (1 << 16)], pa.int64()), pa.array(final[k : k + (1 << 16)])], ["codes", "n", "whole"])

        for batch in batches:
            for number, wide, data in zip(batch.column("bucket").to_pylist(), batch.column("wide").to_pylist(), batch.column("windows"), strict=True):
                if number != bucket:
                    yield from emptied(not cut)
                    bucket, cut, size = number, False, 0
                held.append(np.frombuffer(data.as_py(), "<i8" if wide else "<i4").reshape(2 * reach + 2, -1).astype(np.int64))
                size += held[-1].shape[1]
                if size > windows:
                    cut, size = True, 0
                    yield from emptied(False)
        yield from emptied(not cut)

    return run


def frequent_grams(texts: DataFrame, words: DataFrame, turn: int, max_words: int, min_count: int, part_windows: int = PART_WINDOWS, mined_windows: int = MINED_WINDOWS) -> DataFrame:
    """The stored table (codes, n) of the n-grams of 2 to max_words words with at least min_count occurrences, from (lang, text) and coded words."""
    spark: SparkSession = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    buckets = max(4 * tasks, total // part_windows)
    most = max(1, total // buckets)
    top = words.where(F.col("code") < HASHED).select("lang", "word", "f", "code").toArrow()  # RANKED rows at most
    known: dict[str, dict[bytes, int]] = {}
    split = np.ones(top.num_rows + 2, np.int64)  # the last place is for words without a rank
    for lang, word, f, code in zip(*(top.column(c).to_pylist() for c in ("lang", "word", "f", "code")), strict=True):
        known.setdefault(lang, {})[word.encode()] = code
        split[code] = max(1, f // most)
    rest = words.where(F.col("code") >= HASHED).select(F.col("code").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("at"))
    filled = rest.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect()  # FILTER_BITS / 64 rows at most
    bits = None
    if filled:
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        for row in filled:
            bits[row["word"]] = row["bits"] & (1 << 64) - 1
    shared, reach = spark.sparkContext.broadcast((known, split)), max_words - 1
    sent = texts.mapInArrow(_sent(shared, turn, bits, reach, buckets), "bucket long, wide boolean, windows binary")
    dealt = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    found = stored(dealt.mapInArrow(_mining(shared, reach, min_count, mined_windows), "codes array<long>, n long, whole boolean"), "grams")
    again = found.where(~F.col("whole")).groupBy("codes").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return stored(found.where("whole").select("codes", "n").unionByName(again), "frequent-grams")


def phrases(grams: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, words, a) of (codes, n)."""
    each = grams.select("codes", "n", F.posexplode("codes").alias("at", "code"))
    longest = words.agg(F.coalesce(F.max(F.octet_length("word")), F.lit(0))).first()[0]
    named = matched(each, words.select("code", "lang", "word"), "code", "codes", width=96 + longest, how="inner")
    rows = named.groupBy("codes", "n").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))  # MAX_WORDS of each
    return rows.select("lang", F.transform("parts", lambda x: x["word"]).alias("words"), F.col("n").alias("a")).withColumn("phrase", F.array_join("words", " "))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, subsumed: int = SUBSUMED, top: int = TOP,
    ranked: int = RANKED, part_windows: int = PART_WINDOWS, mined_windows: int = MINED_WINDOWS,
) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Texts, A-Z lower-cased, are cut at marks and line ends into pieces, and those at spaces and tabs into words. Phrases have 2 to max_words words and at least min_count
    occurrences. A phrase's score is the lowest over its cuts, of equal ones that after the fewest words; phrases that a longer candidate
    covers are dropped. Null and empty texts have no words, a null language is `und`. Repeated rows all count. Ties in score go to
    the more frequent phrase, then by its bytes. An empty table, or one without frequent phrases, gives no rows. Very long texts are
    read whole. Only the columns named are read. Counts and products are exact: decimals where 64 bits could overflow.
    """
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    counts = stored(word_counts(texts), "words")
    sizes = stored(counts.groupBy("lang").agg(F.sum("f").alias("n")), "languages")
    words, turn = coded(counts.where(F.col("f") >= min_count), ranked)
    grams = frequent_grams(texts, words, turn, max_words, min_count, part_windows, mined_windows)
    found = stored(phrases(grams, words), "phrases")
    known = stored(words.select("lang", F.col("word").alias("phrase"), "f").unionByName(found.select("lang", "phrase", F.col("a").alias("f"))), "known-phrases")
    number, longest = known.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("phrase")), F.lit(0))).first()

    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = found.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    part = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = matched(cuts, known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side], "phrase", number, 96 + longest, "inner")
    cuts = cuts.withColumns({"scaled": wide("a") * SCALE, "whole": wide("l") + wide("r")}).withColumn("score", F.expr("scaled div whole"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = found.where(F.size("words") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array(part(1, F.size("words") - 1), part(2, F.size("words") - 1))).alias("phrase"))
    covering = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))  # longer ones that cover it cover by one word more, too
    kept = best.join(covering, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * subsumed))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return matched(rows, sizes, "lang", "phrase", how="inner").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_query(spark, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents").select("text", "lang"))


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER.decode()}', '{_LOWER.decode()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(ws) >= k),
f AS (SELECT lang, ws[i:i + k - 1] AS ws, k, count(*) AS f FROM s GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k >= 2 AND f >= 30),
x AS (SELECT c.lang, c.ws, c.f AS a, cut, l.f AS l, r.f AS r, 2000000 * c.f::HUGEINT // (l.f + r.f) AS score
      FROM c JOIN (VALUES (1), (2), (3)) v(cut) ON cut < c.k JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:cut] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[cut + 1:c.k]),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
g AS (SELECT DISTINCT c.lang, c.ws FROM c JOIN (SELECT lang, f, ws, k, unnest(range(2, k)) AS size FROM c) q ON q.lang = c.lang AND q.size = c.k AND 100 * q.f >= 80 * c.f
      JOIN (VALUES (1), (2), (3)) v(i) ON i + c.k - 1 <= q.k AND c.ws = q.ws[i:i + c.k - 1]),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.ws, ' ')) AS rank, array_to_string(b.ws, ' ') AS phrase, a, l, r, score::BIGINT AS score
      FROM b ANTI JOIN g ON g.lang = b.lang AND g.ws = b.ws)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
