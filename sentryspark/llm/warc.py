"""WARC archives: one gzip member per record, written and read back by Spark.

Writing: tasks turn pages into records (headers, HTTP block, gzip member) and gather members into
archives of at most ARCHIVE_BYTES. Each archive is one row, and Spark's text writer puts
each row into a file of its own, so that Spark's committer and file systems do the writing. That
writer ends a row with a separator; it is the zero byte with which a gzip member of under
16 MB of text ends anyway, so it is taken off the archive first. After a longer last record the zero is
padding, which gzip readers skip.

Every archive begins with a warcinfo record.

Reading: a file is one row; a task walks through it from its start, CHUNK bytes at a time. While a member is inflated, its
record is framed by its content length, and block and payload digests are verified; only the block of one record is held. The
file itself is held, too, as Spark reads it as one value, so it may have as many bytes as a task's memory allows, and less than 2 GB.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentryspark.llm.common import fits, joined, new_path, stored

ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 16
#: Payloads of fewer bytes are always stored in full.
MIN_BYTES = 0
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_ID = re.compile(r"<urn:page:(-?\d+|null)>")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    """A url in one header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or a revisit of the page refers_to: the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def info(first: bytes) -> bytes:
    """The warcinfo record of an archive, named after its first member, so that a repeated task writes the same."""
    block = b"software: sentryspark\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(first).hexdigest())
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {_DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Framer:
    """One record, fed with inflated bytes as they come: its headers, then as many bytes of block as its content length says, then its end."""

    END = b"\r\n\r\n"

    def __init__(self):
        self.headers: dict[str, str] | None = None
        self._head, self.block, self._tail = bytearray(), bytearray(), b""
        self._size, self._sha = 0, hashlib.sha1()

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            seen = max(0, len(self._head) - 3)
            self._head += data
            at = self._head.find(self.END, seen)
            if at < 0:
                if not b"WARC/".startswith(bytes(self._head[:5])):
                    raise ValueError("not a WARC record")
                return
            first, *lines = bytes(self._head[:at]).decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("not a WARC record")
            self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            self._size = int(self.headers["content-length"])
            data = bytes(self._head[at + 4 :])
            self._head = bytearray()
        part = data[: self._size - len(self.block)]
        self.block += part
        self._sha.update(part)
        self._tail += data[len(part) :]
        if len(self._tail) > 4:
            raise ValueError(f"the record's length isn't {self._size}")

    @property
    def payload(self) -> bytes | None:
        """What the block carries: of a response what follows its HTTP head, of a resource or conversion all of it."""
        kind = (self.headers or {}).get("warc-type")
        return bytes(self.block).partition(self.END)[2] if kind == "response" else bytes(self.block) if kind in ("resource", "conversion") else None

    def close(self) -> None:
        """Raises ValueError if the frame or a digest doesn't hold."""
        if self.headers is None:
            raise ValueError("not a WARC record")
        if len(self.block) != self._size or self._tail != self.END:
            raise ValueError(f"the record's length isn't {self._size}")
        if (said := self.headers.get("warc-block-digest", "")).startswith("sha1:") and said != f"sha1:{base64.b32encode(self._sha.digest()).decode()}":
            raise ValueError("the block's digest differs")
        payload = self.payload
        if payload is not None and (said := self.headers.get("warc-payload-digest", "")).startswith("sha1:") and said != f"sha1:{sha1_base32(payload)}":
            raise ValueError("the payload's digest differs")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises ValueError or KeyError if frame or digests don't hold."""
    framer = Framer()
    framer.feed(data)
    framer.close()
    return framer.headers, bytes(framer.block)


def records(stream: BinaryIO) -> Iterator[Framer]:
    """The records of an archive in order, a gzip member each, read and inflated CHUNK bytes at a time; zero padding between members is skipped."""
    rest = b""
    while True:
        rest = rest.lstrip(b"\0")
        if not rest:
            if not (rest := stream.read(CHUNK)):
                return
            continue
        inflater, framer = zlib.decompressobj(31), Framer()
        while not inflater.eof:
            if not rest and not (rest := stream.read(CHUNK)):
                raise ValueError("the archive ends within a record")
            framer.feed(inflater.decompress(rest, CHUNK))
            rest = inflater.unconsumed_tail
        rest = inflater.unused_data
        framer.close()
        yield framer


def _number(value: str | None) -> int | None:
    found = _ID.fullmatch(value or "")
    return int(found[1]) if found and found[1] != "null" else None


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        archive = b"".join([member(info(held[0])), *held])
        return pa.record_batch([pa.array([archive[:-1] if archive.endswith(b"\0") else archive], pa.binary())], ["archive"])

    for batch in batches:
        for num, url, html, refers in zip(*(batch.column(x) for x in ("id", "url", "html", "refers_to")), strict=True):
            one = member(record(num.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py()))
            if held and size + len(one) > ARCHIVE_BYTES:
                yield out()
                held, size = [], 0
            held.append(one)
            size += len(one)
    if held:
        yield out()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write a record for each row of pages into archives below path.

    Of rows with equal payloads of at least min_bytes bytes, those with the largest id are
    responses and the others revisit it; null bodies are empty payloads. Rows repeating id and
    payload are all responses, as are rows with a null id in a group that has no other id. An empty table
    makes no record; other columns are not read. Record ids are those of pages, so they repeat where page ids do. Very long bodies make one record each.
    """
    own = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[body_col], F.lit("")).alias("html"))
    large = F.octet_length("html") >= min_bytes
    groups = own.where(large).groupBy(F.sha1("html").alias("digest")).agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null")
    keyed = own.withColumn("digest", F.when(large, F.sha1("html")))
    named = stored(groups, "warc-groups")
    if fits(named.count()):
        found = keyed.join(F.broadcast(named.select("digest", "keeper")), "digest", "left")
    else:
        found = joined(keyed, named.select("digest", "keeper"), "digest", "id", named.select("digest", "n"), own.count())
    found = found.withColumn("refers_to", F.when(~F.col("keeper").eqNullSafe(F.col("id")), F.col("keeper")))
    archives = found.select("id", "url", "html", "refers_to").mapInArrow(_written, "archive binary")
    # the bytes pass through the text writer as they are
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def _row(found: Framer) -> tuple:
    headers, payload = found.headers, found.payload
    said = re.search(rb"(?i)\r\ncontent-length: *(\d+)", bytes(found.block).partition(Framer.END)[0]) if headers.get("warc-type") == "revisit" else None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or (None if payload is None else sha1_base32(payload))
    size = len(payload) if payload is not None else int(said[1]) if said else None
    return _number(headers.get("warc-record-id")), headers.get("warc-type"), headers.get("warc-target-uri"), _number(headers.get("warc-refers-to")), digest, size, payload


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_type", "url", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for found in records(pa.BufferReader(content.as_buffer())):
                rows.append(_row(found))
                size += len(found.block)
                if size > ARCHIVE_BYTES:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark, path: str) -> DataFrame:
    """The records of all archives below path: page_id, record_type, url, refers_to, payload_digest, payload_bytes, payload.

    Records of any type are rows; what a record lacks is null: page_id and refers_to unless ids are those that write_archives gives, payload unless it is
    a response, resource or conversion. Absent digests are computed. A damaged record fails the job.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, record_type string, url string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def warc_query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_archives(spark, path).where("record_type in ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32; the digest's 20 bytes are spelled in groups of 5 bits.
ORACLE = """
WITH t AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT hex, string_agg(CASE d WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111'
        WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END, '' ORDER BY i) AS bits
      FROM (SELECT DISTINCT hex, i, substr(hex, i, 1) AS d FROM t, range(1, 41) r(i)) GROUP BY hex),
c AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, k, 1)::INT + 8 * substr(bits, k + 1, 1)::INT + 4 * substr(bits, k + 2, 1)::INT + 2 * substr(bits, k + 3, 1)::INT + substr(bits, k + 4, 1)::INT, 1), '' ORDER BY k) AS payload_digest
      FROM b, range(1, 161, 5) r(k) GROUP BY hex),
g AS (SELECT hex, max(page_id) AS keeper FROM t GROUP BY hex)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM t JOIN c USING (hex) JOIN g USING (hex)
"""
