"""What the training-data operators share: stored tables, size-checked broadcasts and joins that deal out hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentryspark.sources.tables import new_folder as new_path
from sentryspark.sources.tables import removed, stored

#: Bytes up to which a stored table may be broadcast: its rows, counted, times the bytes that one takes in memory.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 160
#: Rows of a key that stay together: this many, or more if over HOT_KEYS keys could have so many.
HOT_ROWS = 1024
HOT_KEYS = 100_000
#: Parts that rows without a key are dealt into.
NULL_PARTS = 1 << 14

__all__ = ["discarded", "fits", "fresh", "hot", "joined", "load", "matched", "new_path", "removed", "sized", "stored", "text_slices"]


def discarded(*tables: DataFrame) -> None:
    """Delete stored() tables that what was stored later has replaced; nothing lazy may still read them."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            removed(table.sparkSession, file.rpartition("/")[0])


def fits(rows: int, width: int = ROW_BYTES) -> bool:
    """Whether so many rows of so many bytes may be broadcast."""
    return rows * width <= BROADCAST_BYTES


def sized(df: DataFrame, rows: int | None = None, width: int = ROW_BYTES) -> DataFrame:
    """Mark a stored table for broadcast if its rows of at most `width` bytes fit; else leave it to a shuffled join."""
    return F.broadcast(df) if fits(df.count() if rows is None else rows, width) else df


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__, ... that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot(counts: DataFrame, key: list[str], total: int) -> DataFrame:
    """(key, hot_parts) of the keys with more than their share of `total` rows, from counts (key, n). At most HOT_KEYS rows, so it may be broadcast."""
    most = max(HOT_ROWS, total // HOT_KEYS)
    return counts.where(F.col("n") > most).select(*key, F.ceil(F.col("n") / most).alias("hot_parts"))


def joined(left: DataFrame, right: DataFrame, key: str | list[str], spread: str, counts: DataFrame, total: int, how: str = "left") -> DataFrame:
    """left joined with right, which has each key once, by a shuffle in which no task gets more than a part of a hot key's rows.

    counts: (key, n), the rows that each key has in left, or at least those of the frequent ones, out of `total`. Hot keys' rows are
    dealt by a hash of column `spread`, and their rows of right go to every part. Rows without a key are dealt, too.
    """
    key = [key] if isinstance(key, str) else key
    many = F.broadcast(hot(counts, key, total))
    part, parts = fresh(left, "part"), F.coalesce(F.col("hot_parts"), F.lit(1).cast("long"))
    absent = F.lit(False)
    for name in key:
        absent = absent | F.col(name).isNull()
    dealt = left.join(many, key, "left").withColumn(part, F.pmod(F.xxhash64(spread), F.when(absent, F.lit(NULL_PARTS).cast("long")).otherwise(parts))).drop("hot_parts")
    copies = right.join(many, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("hot_parts")
    return dealt.join(copies, [*key, part], how).drop(part)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def matched(left: DataFrame, right: DataFrame, key: str | list[str], spread: str, rows: int | None = None, width: int = ROW_BYTES, how: str = "left") -> DataFrame:
    """left joined with the stored table right, which has each key once: a broadcast if right's rows of at most `width` bytes fit, else joined()."""
    key = [key] if isinstance(key, str) else key
    if fits(right.count() if rows is None else rows, width):
        return left.join(F.broadcast(right), key, how)
    left = stored(left, "match")
    return joined(left, right, key, spread, left.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), left.count(), how)


def text_slices(batch, column: str, most: int):
    """Slices of an Arrow batch with at most so many code points of text, or one row."""
    at, total, sizes = 0, 0, [len(x.as_py() or "") for x in batch.column(column)]
    for k, size in enumerate(sizes):
        if k > at and total + size > most:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += size
    if at < len(sizes):
        yield batch.slice(at)
