"""WARC archives as chunked record tables.

Payloads become rows (record, chunk number, bytes); writing and reading stream the chunks and carry digests along, so no
side ever holds a whole record beyond the row that the table itself has. Archives are gzip members, one for each record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small, stage

CHUNK_BYTES = 256 << 10
#: Payloads from this size on are stored once.
LEAST_REVISIT = 100
#: Compressed bytes after which a new archive begins, and a new segment for a reader.
ARCHIVE_BYTES, SEGMENT_BYTES = 256 << 20, 4 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is the page that holds an equal payload, or null.

    Of the pages with equal payloads of LEAST_REVISIT bytes or more that with the smallest page_id holds it; rows that repeat
    its page_id hold it too. A null page_id holds nothing for others unless all of the group are null.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    large = F.col("payload_bytes") >= LEAST_REVISIT
    shared = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("held_by"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = rows.where(large).join(small(stage(shared, "payloads"), F.lit(64)), "payload_digest", "left")
    found = found.unionByName(rows.where(~large).withColumn("held_by", F.lit(None).cast(pages.schema["page_id"].dataType)))
    return found.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("held_by")), F.col("held_by")).alias("refers_to"))


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each chunk of a record, in order; a revisit has one empty chunk. A chunk is cut out for its own row: no row holds all."""
    stored = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    n = F.greatest(F.ceil(F.octet_length(stored) / chunk_bytes), F.lit(1)).cast("int")
    about = ["page_id", "url", "payload_bytes", "payload_digest", "refers_to"]
    numbered = records.select(*about, stored.alias("stored"), n.alias("chunks"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return numbered.select(*about, "chunks", "chunk_no", F.substring("stored", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))


def _header(r: dict) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if r['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if r['page_id'] is None else r['page_id']}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
        f"X-Payload-Length: {r['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if r["url"]:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", r["url"]))
    if r["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <urn:page:{r['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = len(HTTP) + (r["payload_bytes"] if r["refers_to"] is None else 0)
    return "\r\n".join([*lines, f"Content-Length: {body}", "", ""]).encode()


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunk rows -> (archive, start, end): segments of archives. A task that is run again writes archives of its own."""
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        out, path, at, start, segments, member, digest = None, "", 0, 0, [], None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk_no"] == 0:
                    if out is None:
                        path, at, start = f"{base}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(path, compression=None)
                    member, digest = zlib.compressobj(2, zlib.DEFLATED, 31), hashlib.sha256()
                    out.write(member.compress(_header(r) + HTTP))
                digest.update(r["chunk"])
                out.write(member.compress(r["chunk"]))
                if r["chunk_no"] == r["chunks"] - 1:
                    if r["refers_to"] is None and digest.hexdigest() != r["payload_digest"]:
                        raise ValueError(f"page {r['page_id']}: its chunks don't make its payload")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    at = out.tell()
                    if at - start >= SEGMENT_BYTES or at >= ARCHIVE_BYTES:
                        segments.append((path, start, at))
                        start = at
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
            if segments:
                yield _segments(segments)
                segments = []
        if out is not None:
            out.close()
            if at > start:
                yield _segments([(path, start, at)])

    return write


def _segments(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "start", "end"])


def records_in(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
    """(header, chunk number, payload bytes, last) from pieces of an uncompressed WARC stream."""
    buffer = b""
    pieces = iter(pieces)

    def head() -> bytes | None:
        nonlocal buffer
        while b"\r\n\r\n" not in buffer:
            piece = next(pieces, None)
            if piece is None:
                return None
            buffer += piece
        found, _, buffer = buffer.partition(b"\r\n\r\n")
        return found

    while (top := head()) is not None:
        lines = top.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        header = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(header["content-length"])
        http = head()
        left -= len(http) + 4
        n = 0
        while True:
            if left and not buffer:
                buffer = next(pieces)
            chunk, buffer = buffer[:left], buffer[left:]
            left -= len(chunk)
            yield header, n, chunk, not left
            n += 1
            if not left:
                break
        while len(buffer) < 4:
            buffer += next(pieces)
        if buffer[:4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it should")
        buffer = buffer[4:]


def _pieces(files, path: str, start: int, end: int, size: int = 128 << 10) -> Iterator[bytes]:
    with files.open_input_file(path) as f:
        f.seek(start)
        left, member = end - start, zlib.decompressobj(31)
        while left:
            data = f.read(min(size, left))
            left -= len(data)
            if not data:
                raise EOFError(f"{path} ends before {end}")
            while data:
                out = member.decompress(data, size)
                while out or member.unconsumed_tail:
                    yield out
                    out = b"" if member.eof else member.decompress(member.unconsumed_tail, size)
                    if member.eof and not out:
                        break
                data = b""
                if member.eof:
                    data, member = member.unused_data, zlib.decompressobj(31)


def _reader(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments -> chunk rows with the digest of the payload so far."""
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(root)
        names = ["page_id", "record_type", "refers_to", "chunk_no", "last", "bytes_so_far", "digest_so_far", "stated_bytes", "stated_digest"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string())
        of = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
        for batch in batches:
            for s in batch.to_pylist():
                rows, digest, n = [], None, 0
                for h, no, chunk, last in records_in(_pieces(files, s["archive"], s["start"], s["end"])):
                    if no == 0:
                        digest, n = hashlib.sha256(), 0
                    digest.update(chunk)
                    n += len(chunk)
                    rows.append((of(h["warc-record-id"]), h["warc-type"], of(h.get("warc-refers-to")), no, last, n, digest.hexdigest(), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:")))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return read


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Writes a record for each page into archives under root (a folder all executors share); returns their segments."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root)
    files.create_dir(base, recursive=True)
    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return stage(chunk_table(plan_records(columns)).mapInArrow(_writer(root), "archive string, start long, end long"), "segments")


def read_archives(segments: DataFrame, root: str) -> DataFrame:
    """The archives' records as chunk rows: page_id, record_type, refers_to, chunk_no, last, bytes_so_far, digest_so_far, stated_*."""
    n = max(1, min(10_000, segments.count()))
    return segments.repartition(n).mapInArrow(_reader(root), "page_id long, record_type string, refers_to long, chunk_no int, last boolean, bytes_so_far long, digest_so_far string, stated_bytes long, stated_digest string")


def round_trip(pages: DataFrame, root: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the archives of all pages.

    Null html is an empty payload; payloads below 100 bytes are always stored; repeated rows each have a record; a null url
    has no target. What a response holds is measured again from its chunks; a revisit states its payload. Other columns are
    ignored; no pages make no archives and an empty result.
    """
    root = root or f"{shared_dir(pages.sparkSession)}/barloom-warc-{uuid.uuid4().hex}"
    ends = read_archives(write_archives(pages, root), root).where("last")
    held = F.col("record_type") == "response"
    return ends.select(
        "page_id", F.when(held, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(held, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
