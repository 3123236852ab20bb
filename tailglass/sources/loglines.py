"""A Spark data source of log lines: a partition for each stretch of a file, or for each byte range of a large one.

``spark.dataSource.register(LogLines)``, then ``spark.read.format("loglines").option("segments", json).load()``;
segments is a JSON list of the fields of ``Stretch``.  Paths are on a file system that all executors mount; tables in
other stores are read by Spark's own sources.

Lines end in \\n; one \\r before it goes; only complete lines come, but a line over 16,000 bytes comes as far as
that without its end.  Where such a line has no end yet, the stretch stops inside it (``in_line``), and the next one
gives the rest of it under the same number (``frag`` 1).  A line is cut above 2000 bytes and decoded in pieces of that
size.  NULs at a line's start go before anything is measured, however many they are, and a line of NULs only is counted
and left out.  Offsets are in the uncompressed stream.  ``history`` complete lines before ``start`` come as rows with
is_history, cut to 2000 bytes; a line of NULs takes a place among them.

Each partition ends with a row whose ``state`` (JSON) says how the read went: how far it came, what file it was (inode,
size, time, first line) and what stands before the place reached, all of one handle.  ``why`` is ok; none where no line
begins in a range; or gone, renamed
(another inode under the name) or denied at the open, with no lines; damaged (a compressed stream that ends early: what
could be read came); or truncated: the file was cut or rewritten while it was read.  A plain file is asked after every
chunk whether it still is the one that was opened: not shorter than what was read, with the same first line and the same
bytes before the last line's end.  If not, the chunk is dropped, so no line of new content comes from an old place.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import json
import lzma
import os
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

try:
    import zstandard
except ImportError:  # .zst files are then damaged ones
    zstandard = None

LINE, PIECES, CHUNK = 2000, 8, 1 << 16
#: Bytes that a first line may have, and that are remembered before a place.
CAP = 4096
SCHEMA = "file string, path string, seg int, number long, frag int, text string, cut boolean, still_cut boolean, is_history boolean, end_offset long, state string"
STATE = "why string, part long, in_line boolean, ino decimal(20,0), dev decimal(20,0), size long, modified long, fingerprint string, anchor string"
DAMAGED = (EOFError, OSError, zlib.error, lzma.LZMAError, *((zstandard.ZstdError,) if zstandard else ()))


class Zst:
    """A .zst stream that is read forwards; a step back starts anew.  One that ends inside a frame raises EOFError."""

    def __init__(self, raw):
        self.raw = raw
        self._begin()

    def _begin(self) -> None:
        self.raw.seek(0)
        self.inside, self.left, self.at, self.frame = False, b"", 0, None

    def read1(self, n: int) -> bytes:
        if zstandard is None:
            raise EOFError("zstandard is not there")
        while not self.left:
            packed = self.frame.unused_data if self.frame is not None and self.frame.eof else b""
            if not packed and not (packed := self.raw.read(4096)):
                if self.inside:
                    raise EOFError("the stream ends inside a frame")
                return b""
            if self.frame is None or self.frame.eof:
                self.frame = zstandard.ZstdDecompressor().decompressobj()
            self.left = self.frame.decompress(packed)
            self.inside = not self.frame.eof
        out, self.left = self.left[:n], self.left[n:]
        self.at += len(out)
        return out

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n and (chunk := self.read1(n - len(out))):
            out += chunk
        return out

    def seek(self, place: int) -> int:
        if place < self.at:
            self._begin()
        while self.at < place and self.read1(min(CHUNK, place - self.at)):
            pass
        return self.at


OPEN: dict[str, Callable] = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open, ".zst": lambda raw, _: Zst(raw)}


def opener_of(path: str) -> Callable | None:
    """What unpacks a file of this name, or None for a plain one."""
    return next((f for suffix, f in OPEN.items() if path.lower().endswith(suffix)), None)


def micros(facts: os.stat_result) -> int:
    """The time of a file's last change, in microseconds."""
    return facts.st_mtime_ns // 1000


@dataclass
class Stretch(InputPartition):
    """What one task reads: from ``start`` (``number`` complete lines stand before it) to the end, or the lines that
    begin before ``stop``.  ``inside``: the start is anywhere, and the first line that begins from there on is the first.
    ``ino`` and ``dev``, if known, are those the file must have; ``fingerprint`` is the first line it must have."""

    file: str
    path: str
    seg: int = 0
    start: int = 0
    number: int = 0
    history: int = 0
    in_line: bool = False
    stop: int | None = None
    inside: bool = False
    ino: int | None = None
    dev: int | None = None
    fingerprint: str | None = None

    def as_json(self) -> dict:
        return asdict(self)


class RawLine(NamedTuple):
    """A line without its end and the NULs before it, kept to LINE * PIECES bytes and one; the offset behind it."""

    kept: bytes
    end: int
    left_out: bool
    only_nuls: bool
    ended: bool = True


def read_some(stream, n: int = CHUNK) -> bytes:
    """The next bytes, or none where the stream ends or is damaged."""
    try:
        return stream.read1(n)
    except DAMAGED:
        return b""


def hashed(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def first_line(stream, at: int = 0) -> str | None:
    """SHA-256 of the first line with its end, NULs before it left out, or null if it does not end within CAP bytes."""
    data = b""
    while len(data) <= CAP and b"\n" not in data:
        if not (chunk := read_some(stream)):
            break
        data = (data + chunk).lstrip(b"\0")
    line, end, _ = data.partition(b"\n")
    return hashed(line + end) if end and len(line) < CAP else None


class Kept:
    """A stream of which the last bytes read are remembered, as long as a line that may be unfinished and CAP more."""

    ROOM = CAP + LINE * PIECES + CHUNK + 2

    def __init__(self, stream, at: int):
        self.stream, self.at, self.last, self.damaged = stream, at, b"", False

    def read1(self, n: int) -> bytes:
        try:
            chunk = self.stream.read1(n)
        except DAMAGED:
            self.damaged = True
            return b""
        self.at += len(chunk)
        self.last = (self.last + chunk)[-self.ROOM :]
        return chunk

    def before(self, place: int) -> bytes | None:
        """The CAP bytes before a place, or as many as the stream has; None if they are gone."""
        low = max(0, place - CAP)
        begin = self.at - len(self.last)
        return self.last[low - begin : place - begin] if begin <= low and place <= self.at else None


class Changed(Exception):
    """The file under the handle is no longer the one that was opened."""


class Guard:
    """Whether a plain file's handle still reads what was opened; asked after each chunk."""

    def __init__(self, raw, fingerprint: str | None):
        self.raw, self.fingerprint = raw, fingerprint

    def bytes_before(self, place: int) -> bytes:
        here = self.raw.tell()
        low = max(0, place - CAP)
        self.raw.seek(low)
        data = b""
        while len(data) < place - low and (chunk := self.raw.read(place - low - len(data))):
            data += chunk
        self.raw.seek(here)
        return data

    def check(self, place: int, seen: bytes | None) -> None:
        """``seen``: what stood before ``place`` as it was read, or None where that is no longer remembered."""
        if os.fstat(self.raw.fileno()).st_size < place or seen is not None and self.bytes_before(place) != seen:
            raise Changed
        if self.fingerprint is not None:
            here = self.raw.tell()
            self.raw.seek(0)
            now = first_line(self.raw)
            self.raw.seek(here)
            if now != self.fingerprint:
                raise Changed


def raw_lines(stream, start: int, in_line: bool = False, stop: int | None = None, check: Callable[[int], None] | None = None) -> Iterator[RawLine]:
    """Memory stays within a chunk and a line's kept bytes, however long a line or a run of NULs is.

    ``check(end of the last line)`` is called after each chunk, before anything of it is used.  The stream stands at ``start``."""
    kept, size, hole, at, most, last = b"", 0, False, start, LINE * PIECES, start
    while chunk := read_some(stream):
        if check:
            check(last)
        begin = 0
        while begin < len(chunk):
            end = chunk.find(b"\n", begin)
            part = chunk[begin : end if end >= 0 else len(chunk)]
            if not size and not in_line:
                text = part.lstrip(b"\0")
                hole, part = hole or len(text) < len(part), text
            size += len(part)
            kept += part[: max(0, most + 1 - len(kept))]
            if end < 0:
                break
            last = at + end + 1
            yield RawLine(kept, last, size > most + kept[-1:].count(b"\r"), hole and not kept.removesuffix(b"\r"))
            kept, size, hole, begin, in_line = b"", 0, False, end + 1, False
            if stop is not None and last >= stop:
                return
        at += len(chunk)
    if check:
        check(last)
    if size > most:
        yield RawLine(kept[:most], at, True, False, False)


def decoded(line: bytes) -> str:
    whole = line.removesuffix(b"\r")
    if len(whole) <= LINE:
        return whole.decode("utf-8", "replace")
    pieces = [line[i : i + LINE] for i in range(0, min(len(line), LINE * PIECES), LINE)]
    return "".join(p.removesuffix(b"\r").decode("utf-8", "replace") for p in pieces)


def begin_of_last(stream, start: int, n: int) -> int:
    """Where the last ``n`` lines before ``start`` begin; read backwards, a block at a time."""
    at, wanted = start, n + 1  # the line end before ``start`` is the last line's own
    while at > 0:
        low = max(0, at - CHUNK)
        stream.seek(low)
        block = stream.read(at - low)
        place = len(block)
        while (place := block.rfind(b"\n", 0, place)) >= 0:
            wanted -= 1
            if not wanted:
                return low + place + 1
        at = low
    return 0


def history_lines(stream, start: int, n: int, packed: bool) -> list[RawLine]:
    """The last ``n`` complete lines that end at ``start`` or before."""
    last: deque[RawLine] = deque(maxlen=n)
    at = 0 if packed else begin_of_last(stream, start, n)
    try:
        stream.seek(at)
    except DAMAGED:
        return []
    for line in raw_lines(stream, at):
        if line.end > start or not line.ended:
            break
        last.append(line)
    return list(last)


def next_line(stream, start: int) -> int | None:
    """Where the first line begins that begins at ``start`` or behind it; None if no line end is there."""
    at = start - 1
    stream.seek(at)
    while chunk := read_some(stream):
        if (end := chunk.find(b"\n")) >= 0:
            return at + end + 1
        at += len(chunk)
    return None


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.segments = [Stretch(**s) for s in json.loads(options["segments"])]

    def partitions(self) -> list[InputPartition]:
        return self.segments or [Stretch("", "")]  # Spark asks for one partition at least

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.path:
            yield from stretch(partition)


def stretch(p: Stretch) -> Iterator[tuple]:
    """The rows of one partition, its state last."""
    state: dict = {"why": "ok", "part": p.start, "in_line": p.in_line}
    whose, reached, number = (p.file, p.path, p.seg), p.start, p.number
    end_row = lambda: (*whose, number, None, None, None, None, None, reached, json.dumps(state))
    opener = opener_of(p.path)
    try:
        raw = open(p.path, "rb")
    except OSError as e:
        state["why"] = "gone" if isinstance(e, FileNotFoundError) else "denied"
        yield end_row()
        return
    with raw:
        facts = os.fstat(raw.fileno())
        state |= {"ino": facts.st_ino, "dev": facts.st_dev, "size": facts.st_size, "modified": micros(facts)}
        if p.ino is not None and (facts.st_ino, facts.st_dev) != (p.ino, p.dev):
            state["why"] = "renamed"
            yield end_row()
            return
        try:
            stream = opener(raw, "rb") if opener else raw
            state["fingerprint"] = first_line(stream)
        except DAMAGED:
            state["why"] = "damaged"
            yield end_row()
            return
        guard = None if opener else Guard(raw, p.fingerprint or state["fingerprint"])
        if guard and (facts.st_size < p.start or p.fingerprint not in (None, state["fingerprint"])):
            state["why"] = "truncated"
            yield end_row()
            return
        if p.history and p.start and not p.inside:
            before = history_lines(stream, p.start, p.history, opener is not None)
            for i, line in enumerate(before):
                if not line.only_nuls:
                    whole = line.kept.removesuffix(b"\r")
                    yield *whose, number - len(before) + 1 + i, 0, whole[:LINE].decode("utf-8", "replace"), len(whole) > LINE, len(whole) > LINE, True, line.end, None
        if p.inside:
            begin = next_line(stream, p.start)
            if begin is None or p.stop is not None and begin >= p.stop:
                state["why"] = "none"  # no line begins here
                yield end_row()
                return
            number += begin > p.start
            reached = begin
        try:
            at = stream.seek(reached)
        except DAMAGED:
            at = -1
        if opener and at < reached:
            state["why"] = "damaged"
            yield end_row()
            return
        kept = Kept(stream, reached)
        if reached:  # what stands before the start is remembered too
            stream.seek(max(0, reached - CAP))
            kept.last = stream.read(reached - max(0, reached - CAP))
        in_line = p.in_line

        def check(last: int) -> None:
            guard.check(last, kept.before(last))

        try:
            for line in raw_lines(kept, reached, in_line, p.stop, check if guard else None):
                if not line.only_nuls:
                    size = len(line.kept.removesuffix(b"\r"))
                    yield *whose, number + 1, int(in_line), decoded(line.kept), size > LINE, line.left_out, False, line.end, None
                number, reached, in_line = number + line.ended, line.end, not line.ended
            state["why"] = "damaged" if kept.damaged else "ok"
        except Changed:
            state["why"] = "truncated"
        tail = kept.before(reached)
        if tail is None and guard and state["why"] == "ok":  # inside a very long line
            tail = guard.bytes_before(reached)
        state |= {"in_line": in_line, "anchor": None if tail is None else hashed(tail)}
    yield end_row()


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loglines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)


def read_stretches(spark, segments: list[dict]) -> DataFrame:
    """The lines of the given stretches, and a row of state for each."""
    spark.dataSource.register(LogLines)
    return spark.read.format("loglines").option("segments", json.dumps(segments)).load()


def read_lines(spark, segments: list[dict]) -> DataFrame:
    """The lines of the given stretches."""
    return read_stretches(spark, segments).where("state IS NULL").drop("state")
