"""WARC records in ZIP packages, written by tasks and read back by range, without extraction.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member a record, and
``indexes/index.cdxj``, one line a record with the record's place in the archive.  A reader takes the end of
the file, finds the end record (ZIP64 or not), walks the central directory, and then knows where each member's
bytes are: the index and single records are read by range.  Packages of other writers may be read too, so
long as the members asked for are stored.

Of pages with equal payloads the one with the least page_id is a response, the others are revisits that name
it; the payload's digest groups them with partial aggregates, so a page that a third of all rows repeat is one
small row a task.

Defined results: null html is the empty payload (empty payloads equal each other); null page_id is kept and
counts after all others; equal page_ids are separate records, and all rows of the least page_id are
responses; columns not named are not read; an empty table gives no package and an empty table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Signatures and sizes of the ZIP format (fixed values).
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
#: Bytes that one read of records takes at most, if no record is larger.
READ_BYTES = 4 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


class ZipWriter:
    """Stored members, one after the other; each member's size is known when it has been written.

    ZIP64 fields stand wherever a size or place needs them, or always with ``zip64``."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes] | list[bytes]) -> None:
        """Sizes and checksum follow the data (flag bit 3), in 64 bits, so nothing is held back."""
        raw, start, crc, size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, MAX32, MAX32, len(raw), len(extra)) + raw + extra)
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
            self._put(part)
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))
        self.entries.append((raw, start, crc, size))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.entries:
            big_size, big_at = self.zip64 or size >= MAX32, self.zip64 or at >= MAX32
            extra = (struct.pack("<QQ", size, size) if big_size else b"") + (struct.pack("<Q", at) if big_at else b"")
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            shown = MAX32 if big_size else size
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, MAX32 if big_at else at) + raw + extra)
        size, n = self.at - start, len(self.entries)
        if self.zip64 or start >= MAX32 or n >= MAX16:
            end = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sIQI", LOCATOR64, 0, end, 1))
            n, size, start = MAX16, MAX32, MAX32
        self._put(struct.pack("<4sHHHHIIH", END, 0, 0, n, n, size, start, 0))


class ZipReader:
    """Members of a ZIP file by range reads: the directory at the end, then only what is asked for."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        n, length, start = self._end()
        data, at, self.members = self.range(start, length), 0, {}
        for _ in range(n):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("no central directory entry where one should be")
            flags, method, packed, full, names, extras, comment, place = struct.unpack("<8xHH8xIIHHH8xI", data[at : at + 46])
            name = data[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + names : at + 46 + names + extras]
            while len(extra) >= 4:  # the ZIP64 field has those of the three that did not fit, in this order
                kind, n_bytes = struct.unpack("<HH", extra[:4])
                if kind == 1:
                    wide = list(struct.unpack(f"<{n_bytes // 8}Q", extra[4 : 4 + n_bytes // 8 * 8]))
                    full = wide.pop(0) if full == MAX32 else full
                    packed = wide.pop(0) if packed == MAX32 else packed
                    place = wide.pop(0) if place == MAX32 else place
                extra = extra[4 + n_bytes :]
            self.members[name] = (method, packed, full, place)
            at += 46 + names + extras + comment

    def range(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        data = self.source.read(length)
        if len(data) < length:
            raise ValueError("the file ends before the member does")
        return data

    def _end(self) -> tuple[int, int, int]:
        """Entries, bytes and place of the central directory."""
        tail = self.range(self.size - (n := min(self.size, 22 + MAX16)), n)
        at = tail.rfind(END)
        while at >= 0 and (len(tail) - at < 22 or struct.unpack("<H", tail[at + 20 : at + 22])[0] != len(tail) - at - 22):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("not a ZIP file: no end record")
        n, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if n == MAX16 or length == MAX32 or start == MAX32:
            locator = self.range(self.size - len(tail) + at - 20, 20) if self.size - len(tail) + at >= 20 else b""
            if locator[:4] == LOCATOR64:
                (place,) = struct.unpack("<8xQ4x", locator)
                kind, n, length, start = struct.unpack("<4s28xQQQ", self.range(place, 56))
                if kind != END64:
                    raise ValueError("no ZIP64 end record where one should be")
        return n, length, start

    def stored(self, name: str) -> tuple[int, int]:
        """Place and size of a stored member's bytes in the file."""
        method, packed, full, place = self.members[name]
        if method != 0 or packed != full:
            raise ValueError(f"{name} is compressed: it can't be read by range")
        names, extras = struct.unpack("<26xHH", self.range(place, 30))
        return place + 30 + names + extras, full


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record: an HTTP response with the payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Target-URI: {' '.join((url or '').split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(first)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type and refers_to; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    size = next(int(v) for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")) if k.lower() == "content-length")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    refers = page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    return page_of(fields["warc-record-id"]), size, digest, kind, refers


def write_package(batches: Iterator[pa.RecordBatch], folder: str, zip64: bool) -> Iterator[pa.RecordBatch]:
    """One package with the rows of this task."""
    batch = next((b for b in batches if b.num_rows), None)
    if batch is None:
        return
    number, lines, written = TaskContext.get().partitionId(), [], 0
    files, path = pafs.FileSystem.from_uri(folder)
    own, name = f"{path}/.{uuid.uuid4().hex}", f"{path}/pages-{number:07d}.wacz"

    def records() -> Iterator[bytes]:
        nonlocal batch, written
        at, rows = 0, 0
        while batch is not None:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "least", "first"))
            for page, url, html, least, first in zip(*columns, strict=True):
                payload = (html or "").encode()
                digest = base32_sha1(payload)
                raw = warc_record(page, url, payload, digest, least, not first)
                raw = gzip.compress(raw, 6, mtime=0)
                lines.append(json.dumps({"offset": at, "length": len(raw), "digest": digest}) + "\n")
                at, rows = at + len(raw), rows + 1
                yield raw
            written = rows
            batch = next(batches, None)

    with files.open_output_stream(own) as out:
        package = ZipWriter(out, zip64)
        package.member(ARCHIVE, records())
        package.member(INDEX, (x.encode() for x in lines))
        package.close()
    files.move(own, name)
    yield pa.record_batch([pa.array([name]), pa.array([written], pa.int64())], names=["path", "records"])


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, zip64: bool = False) -> int:
    """Write the packages of a table (page_id, url, html); returns the number of records.

    Payloads below ``least_bytes`` are all responses."""
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    key = F.when(F.octet_length("html") >= least_bytes, F.sha1(F.encode("html", "UTF-8")))
    rows = rows.withColumn("key", key)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    groups = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(order).alias("top"), F.count("*").alias("n"))
    # only payloads that occur more than once need a partner: the others are responses whatever the join finds
    twice = groups.where("n > 1").select(F.col("key").alias("same"), F.col("top.page_id").alias("least"))
    found = rows.join(twice, F.col("key") == F.col("same"), "left")
    is_least = F.col("same").isNull() | F.col("page_id").eqNullSafe(F.col("least"))
    done = found.select("page_id", "url", "html", "least", is_least.alias("first"))
    written = done.mapInArrow(lambda batches: write_package(batches, folder, zip64), "path string, records long")
    return sum(r.records for r in written.collect())  # a row for each package


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the packages in a folder, by their indexes and range reads."""
    files, path = pafs.FileSystem.from_uri(folder)
    names = [x.path for x in files.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".wacz")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with files.open_input_file(name) as source:
                    package = ZipReader(source, source.size())
                    start, _ = package.stored(ARCHIVE)
                    at, size = package.stored(INDEX)
                    lines = [json.loads(x) for x in package.range(at, size).splitlines()]
                    k = 0
                    while k < len(lines):  # neighbours are read together
                        first, end, rows = lines[k]["offset"], lines[k]["offset"], []
                        while k < len(lines) and (not rows or lines[k]["offset"] + lines[k]["length"] - first <= READ_BYTES):
                            rows.append(lines[k])
                            end = rows[-1]["offset"] + rows[-1]["length"]
                            k += 1
                        data = package.range(start + first, end - first)
                        found = [parse_record(gzip.decompress(data[r["offset"] - first : r["offset"] - first + r["length"]])) for r in rows]
                        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                        yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    if not names:
        return spark.createDataFrame([], RECORDS)
    listed = spark.createDataFrame([(n,) for n in sorted(names)], "path string").repartition(len(names))
    return listed.mapInArrow(step, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the packages and read their records back."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "packages")
    write_packages(pages, folder)
    return read_packages(spark, folder)
