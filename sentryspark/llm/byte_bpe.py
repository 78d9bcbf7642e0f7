"""Byte-level BPE encoding and decoding by a two-tier lookup.

The pattern splits a text into pre-tokens. The first tier is a minimal perfect hash over the
vocabulary: a pre-token that is a token itself costs one probe and one comparison. The second
tier encodes the misses: their bytes form a linked list, and a heap holds the ranks of neighbouring pairs
until no pair can be merged. What a worker has resolved it keeps in a bounded cache.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Pre-tokens that a worker keeps; it starts anew when the cache is full.
CACHE = 600_000


class MinimalPerfectHash:
    """Every key has a slot of its own among len(keys) slots, found by hash and displacement."""

    #: Keys a bucket holds on average.
    LOAD = 4

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = n // self.LOAD + 1
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        seeds, taken = np.zeros(self.buckets, np.int64), np.zeros(n, bool)
        free = 0
        for b in np.argsort(starts[:-1] - starts[1:], kind="stable").tolist():  # fullest first
            own = [int(x) for x in hashes[order[starts[b] : starts[b + 1]]]]
            if not own:
                break
            if len(own) == 1:  # what is left goes to the free slots in turn
                while taken[free]:
                    free += 1
                seeds[b], taken[free] = -free - 1, True
                continue
            seed = 1
            while True:
                slots = {self._mix(h, seed) for h in own}
                if len(slots) == len(own) and not any(taken[s] for s in slots):
                    break
                seed += 1
            seeds[b] = seed
            for s in slots:
                taken[s] = True
        self.seeds = seeds.tolist()

    def _mix(self, h: int, seed: int) -> int:
        h = (h ^ seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (h ^ h >> 32) % self.n

    def slot(self, key: bytes) -> int:
        """The key's slot; a string that isn't a key gets some slot, so the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        return -seed - 1 if seed < 0 else self._mix(h, seed)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBPE:
    """Encodes and decodes texts by the ranks of a vocabulary file; special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import regex

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        tokens = list(self.ranks)
        self.hash = MinimalPerfectHash(tokens)
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * len(tokens)
        for token in tokens:
            self.slots[self.hash.slot(token)] = (token, self.ranks[token])
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.bytes}
        self._cache: dict[str, tuple[int, ...]] = {}
        self._most = cache

    def resolve(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        token, rank = self.slots[self.hash.slot(piece)]
        return (rank,) if token == piece else self.merge(piece)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that isn't a token: the lowest-ranked pair is merged first, the leftmost of equals."""
        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i]
            if end[i] == 0 or j >= n or end[j] != stop:  # one of the two has changed meanwhile
                continue
            end[i], end[j] = stop, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        pieces, cache = self.pattern.findall(text), self._cache
        new = [x for x in set(pieces) if x not in cache]
        if len(cache) + len(new) > self._most:
            cache.clear()
            new = set(pieces)
        for x in new:
            cache[x] = self.resolve(x.encode())
        return list(chain.from_iterable(map(cache.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))


_CODECS: dict[tuple[str, str, int], ByteBPE] = {}


def codec(path: str, pattern: str, cache: int = CACHE) -> ByteBPE:
    key = path, pattern, cache
    if key not in _CODECS:
        _CODECS[key] = ByteBPE(*key)
    return _CODECS[key]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, ids (array of int). Null texts count as empty: no ids. No shuffle; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [np.array(own.encode(x.as_py() or ""), np.int32) for x in batch.column("text")]
            yield pa.record_batch([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The way back: id_col, bytes (binary) of the text that ids_col stands for. Null ids count as none; unknown ids raise KeyError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array([own.decode(x.as_py() or []) for x in batch.column("ids")], pa.binary())], ["id", "bytes"])

    return rows.select(rows[id_col].cast("long").alias("id"), rows[ids_col].alias("ids")).mapInArrow(run, "id long, bytes binary").withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), cache: int = CACHE) -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes decoded from these ids), then the columns of keep.

    Null texts count as empty: no tokens. Rows are judged one by one, so repeats and null ids stay as they are.
    An empty table gives no rows; very long texts are encoded whole. Columns of keep may have any names but those of the result.
    cache is the number of pre-tokens that a worker keeps.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    if clash := sorted({id_col, *made} & set(keep)):
        raise ValueError(f"the result has its own {', '.join(clash)}")
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), *(docs[x].alias(f"kept{k}") for k, x in enumerate(keep)))
    kinds = ", ".join(f"kept{k} {own.schema[f'kept{k}'].dataType.simpleString()}" for k in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, cache)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column("text"):
                ids = own.encode(value.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(sha256(own.joined(ids).encode()).hexdigest())
                text_sha.append(sha256(own.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), *batch.columns[2:]], ["id", *made, *batch.schema.names[2:]])

    out = own.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (kinds and ", " + kinds))
    return out.toDF(id_col, *made, *keep)


def byte_bpe_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trips(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
