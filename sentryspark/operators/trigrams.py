"""Substring search over stored text by an index of trigrams.

A table is written in blocks of rows, in order of block, and the index says for each trigram of its text, A-Z lower-cased, which blocks have it. A
query's trigrams name the blocks that can hold a match; of the table only row groups with these are read, and the LIKE test of
functions.scalar.contains() decides as before. Wildcards part a query: each piece of three letters or more narrows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from sentryspark.functions.scalar import LOWER, UPPER, contains

BLOCK_ROWS = 4096
#: Blocks that are named in the filter of a scan; more of them are joined, by ranges of the same column.
FILTERED_BLOCKS = 10_000
POSTING_PARTS = 256
_POSTINGS = StructType([StructField("gram", StringType()), StructField("block", LongType())])


def grams(text) -> F.Column:
    """The distinct trigrams of a text, A-Z lower-cased; none for shorter ones."""
    low = F.translate(text, UPPER, LOWER)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: low.substr(i, F.lit(3)))))


def _part(gram) -> F.Column:
    return F.pmod(F.xxhash64(gram), F.lit(POSTING_PARTS)).cast("int")


def query_grams(query: str) -> list[str]:
    """Trigrams that every match of a query has."""
    low = query.translate(str.maketrans(UPPER, LOWER))
    return sorted({piece[k : k + 3] for piece in re.split("[%_]", low) for k in range(len(piece) - 2)})


def build(rows: DataFrame, columns: list[str], path: str, order: list[str], block_rows: int = BLOCK_ROWS) -> None:
    """Write rows below path/rows in blocks, and the index of `columns` below path/grams.

    Rows that are near each other in `order` share blocks; a table that grows is indexed in parts, each with a path of its own.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.monotonically_increasing_id())
    number = F.shiftleft(F.shiftright("block", 33), 21) + F.floor(F.col("block").bitwiseAND(F.lit((1 << 33) - 1)) / block_rows).cast("long")
    placed.withColumn("block", number).write.mode("overwrite").option("parquet.block.row.count.limit", str(block_rows)).parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    each = stored.select("block", F.explode(F.flatten(F.array(*(F.coalesce(grams(F.col(c)), F.array().cast("array<string>")) for c in columns)))).alias("gram"))
    postings = each.distinct().withColumn("part", _part(F.col("gram")))
    postings.repartition("part").sortWithinPartitions("part", "gram", "block").write.mode("overwrite").partitionBy("part").parquet(f"{path}/grams")


def blocks(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(block) of the blocks that have all trigrams of a query; None if it has none, so that any block may match."""
    wanted = query_grams(query)
    if not wanted:
        return None
    parts = spark.createDataFrame([(x,) for x in wanted], "gram string").select(_part(F.col("gram"))).distinct().collect()  # of the query's own trigrams
    index = spark.read.schema(StructType([*_POSTINGS.fields, StructField("part", IntegerType())])).parquet(f"{path}/grams")
    found = index.where(F.col("part").isin([r[0] for r in parts]) & F.col("gram").isin(wanted))
    return found.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("block")


def search(spark: SparkSession, path: str, columns: list[str], query: str) -> DataFrame:
    """The rows that contain a query in one of the indexed columns, as contains() tells."""
    rows = spark.read.parquet(f"{path}/rows")
    may = blocks(spark, path, query)
    if may is not None:
        named = [r["block"] for r in may.limit(FILTERED_BLOCKS + 1).collect()]
        if len(named) <= FILTERED_BLOCKS:
            # runs of neighbouring blocks become ranges, which statistics of row groups can exclude
            rows = rows.where(_ranges(sorted(named)))
        else:
            rows = rows.join(may, "block", "left_semi")
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(contains(F.col(c), query), F.lit(False))
    return rows.where(test).drop("block")


def _ranges(numbers: list[int], most: int = 64) -> F.Column:
    """Membership in sorted numbers; beyond `most` runs, the nearest runs are read as one, as the LIKE test decides anyway."""
    runs: list[list[int]] = []
    for x in numbers:
        if runs and x == runs[-1][1] + 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    if len(runs) > most:
        cuts = sorted(sorted(range(1, len(runs)), key=lambda k: runs[k][0] - runs[k - 1][1])[-(most - 1) :])
        runs = [[runs[a][0], runs[b - 1][1]] for a, b in zip([0, *cuts], [*cuts, len(runs)], strict=True)]
    out = F.lit(False)
    for a, b in runs:
        out = out | F.col("block").between(a, b)
    return out
