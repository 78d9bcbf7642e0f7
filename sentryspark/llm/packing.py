"""Token ids packed into fixed-length rows by best-fit decreasing.

Tasks tokenise their documents and gather pieces until a shard of SHARD_ROWS rows is full; longer
documents are split at the row length, losslessly. A shard's pieces are then placed, longest first,
each into the row with the least room that still holds it; a segment tree over capacities finds
that row in log(row length) steps. Rows are written through Spark as Parquet: the ids as
little-endian bytes of equal length (stacked, an id matrix), cumulative segment lengths,
positions that start again at 0 with each segment, and what each segment is. Nothing is shuffled,
and a task holds one shard at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentryspark.llm.byte_bpe import read_ranks
from sentryspark.llm.common import new_path

ROW_TOKENS = 2048
#: Full rows' worth of tokens that a task gathers before it packs them.
SHARD_ROWS = 1024
_SEGMENT = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
_ROWS = "shard string, row int, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, segments array<struct<doc_id:long,piece:int,start:int,length:int>>"


class CapacityTree:
    """Open rows by the room left in them; finds the smallest room of at least n."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, row) of the row with the least room of at least n, taken out; None if no row has it."""
        node = n + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up, until a right neighbour has rows
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """The pieces of each row; lengths lie between 1 and most. Of equal lengths the earlier comes first."""
    tree, rows = CapacityTree(most), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[k])
        room, row = found or (most, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(k)
        tree.add(room - lengths[k], row)
    return rows


_ENCODINGS: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _ENCODINGS[path, pattern]


def packed(docs: DataFrame, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_tokens: int = ROW_TOKENS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows of row_tokens ids each.

    Columns: shard, row; n_tokens without padding; ids, row_tokens little-endian uint16 (uint32 where
    end_id needs it), padded with end_id; position_ids, as many uint32, 0 where a segment starts and in the
    padding; cu_seqlens, from 0 to n_tokens; segments: doc_id, piece (its number within the document), start, length.
    Each document ends with end_id, so null and empty texts are one token. Repeated rows are packed
    again; ids may be null. An empty table gives no rows; only the two columns named are read.
    """
    if row_tokens < 1:
        raise ValueError("row_tokens must be at least 1")
    kind = np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task, number = _encoding(path, pattern), TaskContext.get().partitionId(), 0
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            rows = best_fit_decreasing([len(p[2]) for p in pieces], row_tokens)
            columns: list[list] = [[] for _ in range(7)]
            for k, members in enumerate(rows):
                ids, positions = np.full(row_tokens, end_id, kind), np.zeros(row_tokens, "<u4")
                ends, segments = [0], []
                for m in members:
                    doc, piece, part = pieces[m]
                    at = ends[-1]
                    ids[at : at + len(part)] = part
                    positions[at : at + len(part)] = np.arange(len(part))
                    ends.append(at + len(part))
                    segments.append({"doc_id": doc, "piece": piece, "start": at, "length": len(part)})
                for column, value in zip(columns, (f"{task:06d}-{number:06d}", k, ends[-1], ids.tobytes(), positions.tobytes(), ends, segments), strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(_SEGMENT)]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "row", "n_tokens", "ids", "position_ids", "cu_seqlens", "segments"])

        for batch in batches:
            for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
                ids = np.append(own.encode_to_numpy(text.as_py() or "", disallowed_special=()), end_id).astype(kind)
                for piece, at in enumerate(range(0, len(ids), row_tokens)):
                    pieces.append((doc.as_py(), piece, ids[at : at + row_tokens]))
                    size += len(pieces[-1][2])
                    if size >= shard_rows * row_tokens:
                        yield shard()
                        pieces, size, number = [], 0, number + 1
        if pieces:
            yield shard()

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, _ROWS)


def write_packed(docs: DataFrame, out: str, *args, **kwargs) -> DataFrame:
    """Write the packed rows of docs below out as Parquet and return them as read back."""
    packed(docs, *args, **kwargs).write.parquet(out)
    return docs.sparkSession.read.schema(_ROWS).parquet(out)


def packing_query(spark, sf_dir: str) -> DataFrame:
    """One row for each segment of the written id matrices: where it lies, and the SHA-256 of its id bytes there."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = write_packed(docs, new_path(spark, "packed"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    return rows.select("shard", "row", "n_tokens", "ids", F.inline("segments")).select(
        "doc_id", "piece", "shard", "row", "start", "length", F.col("n_tokens").alias("row_tokens"), F.sha2(F.substring("ids", F.col("start") * 2 + 1, F.col("length") * 2), 256).alias("ids_sha256")
    )
