"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentryspark.llm.byte_bpe import round_trips
from sentryspark.llm.common import load, stored
from sentryspark.llm.decontamination import without_leaks
from sentryspark.llm.exact_dedup import without_duplicates
from sentryspark.llm.language_id import fitted_on, of_known_language
from sentryspark.llm.near_dedup import without_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, and those whose letters hardly fit any learned language, go."""
    return of_known_language(docs, fitted_on(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id stays."""
    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by five-word shingles and a similarity of 0.8, the one with the smallest id stays."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, load(spark, sf_dir, "benchmark"))


#: Pre-tokens that a worker keeps: fewer than the codec's own number, as workers hold what other stages left, too.
CACHE = 150_000


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes decoded from them, with the documents' language and source."""
    import public_tokenizers

    return round_trips(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"), cache=CACHE)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]
#: Language ID and byte-level BPE are beyond SQL; a test in tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
