"""Operator 1: WARC records in ZIP-packaged archives, read by ranges.

An archive is a ZIP file with stored (uncompressed) members: archive/data.warc.gz, whose records are gzip
members of their own, and indexes/index.cdxj, one line for each record. The reader takes the end of the
file, parses the end record, the ZIP64 locator and end record, and the central directory with its ZIP64
fields, finds the members' first bytes from their local headers, reads the index, and then reads runs of
records by range. Nothing is extracted. An archive without an index is scanned record by record.

Of pages with equal payloads of min_bytes or more, the one with the smallest id is a response and the
others are revisits that refer to it; equal ids with equal payloads are all responses. A null payload is
empty. A null page id keeps its place: it never is the smallest id, and refers to it if there is one.
Archives lie in the shared folder; a file's name is new for each attempt of a task, and only files of
attempts that succeeded are listed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, scratch_dir, table, text_batches, written

#: Bytes of records after which a task begins another archive, and of one range read.
ARCHIVE_BYTES = 64_000_000
RANGE_BYTES = 4_000_000
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def parse(raw: bytes) -> dict:
    """Headers and payload of a record's bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:] if ": " in x)
    return {"headers": headers, "http": sent, "payload": payload}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records, bytes) of the archives that hold pages (page_id, url, payload, refers_to), in page order within partitions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        lines: list[str] = []
        size = 0

        def close() -> pa.RecordBatch:
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                with z.open(RECORDS, "w", force_zip64=True) as member:
                    for x in held:
                        member.write(x)
                with z.open(INDEX, "w", force_zip64=True) as member:
                    member.write("".join(lines).encode())
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "records": [len(held)], "bytes": [size]})

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = (payload or "").encode()
                digest = sha1_base32(data)
                held.append(record(page_id, url, data, digest, refers_to))
                lines.append(f"urn:page:{'' if page_id is None else page_id} {json.dumps({'digest': digest, 'offset': size, 'length': len(held[-1])})}\n")
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, lines, size = [], [], 0
        if held:
            yield close()

    return written(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(work, "path string, records long, bytes long"), "archives")


def _range(f: pa.NativeFile, start: int, length: int) -> bytes:
    f.seek(start)
    return f.read(length)


def members(f: pa.NativeFile) -> dict[str, tuple[int, int, int]]:
    """name -> (first byte, length, method) of a ZIP file's members, from its directories."""
    size = f.size()
    tail_at = max(0, size - 65_557)
    tail = _range(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7" and (count == 0xFFFF or 0xFFFFFFFF in (length, start)):
        (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        end64 = _range(f, at, 56)
        if end64[:4] != b"PK\6\6":
            raise ValueError("ZIP64 end record not found")
        count, length, start = struct.unpack("<QQQ", end64[32:56])
    directory, at, out = _range(f, start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        (method,) = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, plain, name, extra, comment = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        (offset,) = struct.unpack("<I", directory[at + 42 : at + 46])
        label = directory[at + 46 : at + 46 + name].decode()
        x, stop = at + 46 + name, at + 46 + name + extra
        while x + 4 <= stop:
            kind, n = struct.unpack("<HH", directory[x : x + 4])
            if kind == 1:  # ZIP64: only the fields that overflowed, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", directory[x + 4 : x + 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            x += 4 + n
        local = _range(f, offset, 30)
        names, extras = struct.unpack("<HH", local[26:30])
        out[label] = (offset + 30 + names + extras, packed, method)
        at += 46 + name + extra + comment
    return out


def _scan(f: pa.NativeFile, start: int, length: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member of a stored member without an index."""
    at, end, begun, d = start, start + length, start, zlib.decompressobj(31)
    while at < end:
        data = _range(f, at, min(RANGE_BYTES, end - at))
        at += len(data)
        while data:
            d.decompress(data)
            if not d.eof:
                break
            data = d.unused_data
            yield begun - start, at - len(data) - begun
            begun, d = at - len(data), zlib.decompressobj(31)


def locate(archives: DataFrame) -> DataFrame:
    """(path, start, lengths): runs of neighbouring records of about RANGE_BYTES, from the archives' indexes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                out: list[tuple] = []
                with store.open_input_file(place) as f:
                    found = members(f)
                    first, length, method = found[RECORDS]
                    if method:
                        raise ValueError(f"{path}: {RECORDS} is compressed; only stored members can be read by range")
                    if INDEX in found:
                        text = _range(f, *found[INDEX][:2]).decode()
                        spots = sorted((x["offset"], x["length"]) for x in (json.loads(line[line.index("{") :]) for line in text.splitlines() if line))
                    else:
                        spots = list(_scan(f, first, length))
                for offset, n in spots:
                    if out and out[-1][1] + sum(out[-1][2]) == first + offset and out[-1][3] + n <= RANGE_BYTES:
                        out[-1][2].append(n)
                        out[-1][3] += n
                    else:
                        out.append([path, first + offset, [n], n])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["path", "start", "lengths"])

    return archives.select("path").mapInArrow(work, "path string, start long, lengths array<long>")


def read_records(runs: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of runs: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null if not asked for)."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def number(x: str | None) -> int | None:
        digits = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as f:
                    data = _range(f, start, sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    x = parse(zlib.decompress(data[at : at + n], 31))
                    at += n
                    h, kind = x["headers"], x["headers"]["WARC-Type"]
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and sha1_base32(x["payload"]) != digest:
                        raise ValueError(f"{path}: payload of {h['WARC-Record-ID']} does not have its digest")
                    rows.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, number(h.get("WARC-Refers-To")), int(x["http"]["Content-Length"]), digest, x["payload"] if payloads and kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return runs.mapInArrow(work, schema)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, payload, refers_to)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    pages = pages.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    groups = pages.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1").select("sha", "least"), "payloads")
    least = F.when(F.octet_length("payload") >= min_bytes, F.col("least"))
    return pages.join(checked_broadcast(groups), "sha", "left").select("page_id", "url", "payload", F.when(least.isNotNull() & ~F.col("page_id").eqNullSafe(least), least).alias("refers_to"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    archives = write_archives(with_revisits(table(spark, sf_dir, "pages")), f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex}")
    runs = written(locate(archives), "runs").repartition(spark.sparkContext.defaultParallelism * 4)
    return read_records(runs, payloads=False).drop("payload")


QUERIES = {"op1_warc": op1_warc}
ORACLES: dict[str, str] = {}
