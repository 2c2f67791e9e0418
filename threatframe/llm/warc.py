"""Operator 12: WARC archives, written and read as one gzip member per record.

Writing: every task streams its pages to files of its own in the shared folder and reports each finished file as a row;
only files of that manifest count, so what a lost or repeated attempt leaves is never read. Payloads that several pages
share are stored once: the page with the smallest id holds the response, the others are revisits that name it.

Reading: a file is read front to back in blocks. Each gzip member is one record and is inflated incrementally; the header
gives the block's length, the block is hashed as it passes, and lengths, digests and the closing empty lines are verified.
Memory holds one block of file, one of text and, where payloads are asked for, one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatframe.llm.common import read, shared_dir, small_batches, staged

READ_BYTES = 1 << 20  #: compressed bytes that a reader takes at once
INFLATE_BYTES = 1 << 20  #: inflated bytes that it holds at once
HEADER_BYTES = 1 << 20  #: of a record's header, at most
FILE_BYTES = 256 << 20  #: an archive is closed when it has reached this size
DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit's block is the HTTP header alone, which keeps the payload's length."""
    digest = _base32(hashlib.sha1(payload).digest())
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe="".join(map(chr, range(0x21, 0x7F))))),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", _record_id(refers_to, digest) if revisit else None),
        ("Page-ID", page_id),
        ("Refers-To-Page-ID", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    """A record as read; fault says what did not hold (None: all verified)."""

    fields: dict[str, str]
    payload_bytes: int | None = None
    payload_digest: str | None = None
    payload: bytes | None = None
    fault: str | None = None


class _Member:
    """The inflated bytes of one gzip member, read in order from a file's blocks."""

    def __init__(self, source: _Blocks):
        self.source, self.z, self.held = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate a little more; False at the member's end."""
        if self.z.eof:
            return False
        piece = self.z.unconsumed_tail or self.source.take()
        if not piece:
            raise EOFError("the file ends inside a gzip member")
        self.held += self.z.decompress(piece, INFLATE_BYTES)
        if self.z.eof:
            self.source.give_back(self.z.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        at = -1
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > HEADER_BYTES:
                raise ValueError("a header is too long")
            if not self.more():
                raise ValueError("a header does not end")
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next size bytes, piece by piece."""
        while size:
            if not self.held and not self.more():
                raise ValueError("a block is shorter than its Content-Length")
            out, self.held = self.held[:size], self.held[size:]
            size -= len(out)
            if out:
                yield out

    def rest(self) -> bytes:
        while len(self.held) <= 4 and self.more():
            pass
        return self.held


class _Blocks:
    """A file's bytes in blocks, with what a finished member did not use put back."""

    def __init__(self, stream):
        self.stream, self.back = stream, b""

    def take(self) -> bytes:
        out, self.back = self.back, b""
        return out or self.stream.read(READ_BYTES)

    def give_back(self, data: bytes) -> None:
        self.back = data + self.back

    def ended(self) -> bool:
        if not self.back:
            self.back = self.stream.read(READ_BYTES)
        return not self.back


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space continues the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def _one(member: _Member, keep: bool) -> Record:
    head = member.until(b"\r\n\r\n")
    record = Record(_fields(head))
    if not re.match(rb"WARC/1\.[01]\r\n", head):
        raise ValueError("no WARC version line")
    if not re.fullmatch(r"[0-9]+", size := record.fields.get("content-length", "")):
        raise ValueError("no Content-Length")
    whole, payload, kept, faults = hashlib.sha1(), hashlib.sha1(), [], []
    http, first, seen = record.fields.get("content-type", "").startswith("application/http"), b"", 0
    inside = not http
    for piece in member.pieces(int(size)):
        whole.update(piece)
        if not inside:  # the HTTP header, before the payload
            first += piece
            if (at := first.find(b"\r\n\r\n")) < 0:
                if len(first) > HEADER_BYTES:
                    raise ValueError("an HTTP header is too long")
                continue
            inside, piece, first = True, first[at + 4 :], first[: at + 4]
        payload.update(piece)
        seen += len(piece)
        if keep:
            kept.append(piece)
    if member.rest() != b"\r\n\r\n" or member.more():
        raise ValueError("a record does not end with its gzip member")
    if not inside:
        faults.append("no HTTP header end")
    told, digest = _fields(first).get("content-length"), _base32(payload.digest())
    stated = record.fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if record.fields.get("warc-block-digest", "") not in ("", f"sha1:{_base32(whole.digest())}"):
        faults.append("block digest")
    if record.fields.get("warc-type") == "revisit":  # of the payload only its length and digest are here
        record.payload_bytes, record.payload_digest = int(told) if told and told.isdigit() else None, stated or None
        if seen:
            faults.append("a revisit with a payload")
    else:
        record.payload_bytes, record.payload_digest, record.payload = seen, digest, b"".join(kept) if keep else None
        if stated not in ("", digest):
            faults.append("payload digest")
        if told is not None and told != str(seen):
            faults.append("payload length")
    record.fault = ", ".join(faults) or None
    return record


def records(stream, keep: bool = False) -> Iterator[Record]:
    """The records of one archive in order. What cannot be framed (a broken member, header or length) ends the file with a
    record of that fault; a wrong digest is reported in its record, and reading goes on."""
    source = _Blocks(stream)
    while not source.ended():
        try:
            yield _one(_Member(source), keep)
        except (ValueError, EOFError, zlib.error) as e:
            yield Record({}, fault=f"{type(e).__name__}: {e}")
            return


def _opened(path: str):
    """(file system, path inside it) of a folder or file that Spark names: a plain path or any URI that pyarrow knows."""
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, first: adds the smallest page_id among pages of equal payload (null where none has an id).

    Minima are taken per payload digest (SHA-256) before anything is shuffled; the join is on the digest with fresh
    exchanges, so a payload that very many pages share is split by adaptive execution. Only shared payloads are joined.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    shared = rows.groupBy("key").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("key", "least", F.lit(True).alias("shared"))
    return rows.join(staged(shared, "shared"), "key", "left").select("page_id", "url", "payload", F.when(F.col("shared"), F.col("least")).otherwise(F.col("page_id")).alias("first"))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as gzipped WARC files; returns the manifest (path, records, bytes), stored.

    A null html is an empty payload, a null url or page_id leaves its field out. Of equal payloads of least_bytes or more,
    the pages with the smallest page_id are responses (all of them, if rows repeat that id) and the others revisits of it;
    null ids count as larger than any, and where no page has an id all are responses. Very long pages make a record of
    their own size. An empty table gives no file. Other columns are ignored.
    """
    small_batches(pages.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = _opened(folder)
        out, path, count, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out, count, size
            if out is not None:
                out.close()
                done.append((path, count, size))
            out, count, size = None, 0, 0

        for batch in batches:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder}/{name}", system.open_output_stream(f"{inside}/{name}", compression=None)
                revisit = page_id != first and len(payload) >= least_bytes
                member = gzip_member(record_bytes(page_id, url, payload, revisit, first if revisit else None))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), d, strict=True)) for d in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    system, inside = _opened(folder)
    system.create_dir(inside, recursive=True)
    return staged(with_first(pages).mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_warc(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives in `files` (path, and records where the writer counted them), one task per file or so.

    page_id, payload_bytes, payload_digest, record_type, refers_to, then url, path, fault and, on demand, payload. fault
    is null where lengths and digests hold. Files that hold other records than the manifest counts get a fault row.
    """
    schema = f"{RECORD}, url string, path string, fault string" + (", payload binary" if payloads else "")
    many = "records" in files.columns
    rows = files.select("path", F.col("records").alias("expected") if many else F.lit(None).cast("long").alias("expected"))
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[p.split()[1]]) for n, p in zip(names, schema.split(", "), strict=True)])

    def whole(text: str | None) -> int | None:
        return int(text) if text and re.fullmatch(r"-?[0-9]+", text) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inside = _opened(path)
                held, size, count, clean = [], 0, 0, True
                with system.open_input_stream(inside, compression=None) as stream:
                    for r in records(stream, payloads):
                        count, clean = count + 1, clean and r.fault is None
                        f = r.fields
                        held.append((whole(f.get("page-id")), r.payload_bytes, r.payload_digest, f.get("warc-type"), whole(f.get("refers-to-page-id")), f.get("warc-target-uri"), path, r.fault, r.payload)[: len(names)])
                        size += len(r.payload or b"")
                        if len(held) >= 2000 or size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                            held, size = [], 0
                if expected is not None and clean and count != expected:
                    held.append((None, None, None, None, None, None, path, f"{count} records, not {expected}", None)[: len(names)])
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    return rows.repartition(max(1, min(files.count(), 100_000)), "path").mapInArrow(run, schema)


def verified(rows: DataFrame) -> DataFrame:
    """Rows of read_warc; the query fails at the first record with a fault."""
    told = F.concat_ws(" ", F.lit("WARC fault in"), "path", "fault")
    return rows.withColumn("record_type", F.when(F.col("fault").isNull(), F.col("record_type")).otherwise(F.raise_error(told).cast("string")))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives of the pages, written to the shared folder and read back: one row per page, as write_warc defines them."""
    folder = f"{shared_dir(pages.sparkSession)}/threatframe-warc-{uuid.uuid4().hex}"
    return verified(read_warc(write_warc(pages, folder, least_bytes))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"))


#: Base32 of a SHA-1 digest: 32 groups of five bits, taken from the hexadecimal form ten digits (eight groups) at a time.
OP12_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 d AS (SELECT *, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
 b AS (SELECT *, list_transform(range(32), lambda g:
   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(hex, CAST(1 + 10 * (g // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (g % 8) AS INTEGER) & 31)::INTEGER, 1)) AS chars FROM d)
SELECT page_id, payload_bytes, array_to_string(chars, '') AS payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM b"""
