"""What identifies a log file and a place in it, read from the files themselves in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loglines import CAP, CHUNK, DAMAGED, LINE, begin_of_last, first_line, hashed, opener_of, read_some

FACTS = "path string, offset long, size long, fingerprint string, anchor string, complete long, in_line boolean, lines long"
#: Bytes of a plain file that one task counts or reads.
RANGE = 64 << 20


def before(stream, offset: int) -> str | None:
    """SHA-256 of the last CAP bytes before the offset, or null if the stream does not reach it."""
    start = max(0, offset - CAP)
    stream.seek(start)
    data = b""
    while len(data) < offset - start and (chunk := stream.read(offset - start - len(data))):
        data += chunk
    return hashed(data) if len(data) == offset - start else None


def end_of_lines(size: int, complete: int) -> tuple[int, bool]:
    """Where a first sight begins: behind the last complete line, or at the end where what follows it is too long to wait
    for its end; and whether that is inside a line."""
    return (size, True) if size - complete > LINE else (complete, False)


def plain_facts(stream, place: int | None, whole: bool) -> tuple:
    """Size, first line, anchor, and for a first sight where to begin; no line count, which ``newlines`` gives by ranges."""
    mark, size = first_line(stream), stream.seek(0, 2)
    complete, inside = end_of_lines(size, begin_of_last(stream, size, 0)) if whole else (None, None)
    return size, mark, before(stream, place) if place is not None and place <= size else None, complete, inside, None


def packed_facts(stream, place: int | None, whole: bool) -> tuple:
    """The same in one pass, which ends at ``place`` unless the whole is wanted: a larger size is then not known."""
    size = complete = lines = 0
    first, last, anchor = b"", b"", None
    while place is None or whole or size < place:
        want = CHUNK if place is None or size >= place else min(CHUNK, place - size)
        if not (chunk := read_some(stream, want)):
            break
        if b"\n" not in first and len(first) <= CAP:
            first = (first + chunk).lstrip(b"\0")[: 2 * CAP + CHUNK]
        complete = size + end + 1 if (end := chunk.rfind(b"\n")) >= 0 else complete
        lines += chunk.count(b"\n")
        size += len(chunk)
        last = (last + chunk)[-CAP:]
        if size == place:
            anchor = hashed(last)
    if place == 0:
        anchor = hashed(b"")
    while b"\n" not in first and len(first) <= CAP and (chunk := read_some(stream)):  # a place before the first line's end
        first = (first + chunk).lstrip(b"\0")
    line, end, _ = first.partition(b"\n")
    mark = hashed(line + end) if end and len(line) < CAP else None
    begin, inside = end_of_lines(size, complete) if whole else (None, None)
    return size, mark, anchor, begin, inside, lines if whole else None


def examined(rows: DataFrame) -> DataFrame:
    """For (path, offset) the file's facts; a null offset has no anchor.  A file that can't be read has none at all.

    ``whole`` (a column of ``rows``, or true) asks for the place where a first sight begins.  A compressed file is read
    as far as the offset, and to its end only for that."""

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, offset, whole in zip(part["path"], part["offset"], part["whole"], strict=True):
                opener, place = opener_of(path), None if pd.isna(offset) else int(offset)
                try:
                    with open(path, "rb") as raw:
                        facts = packed_facts(opener(raw, "rb"), place, whole) if opener else plain_facts(raw, place, whole)
                except DAMAGED:
                    facts = (None,) * 6
                out.append((path, place, *facts))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FACTS.split(", ")]).astype({x: "Int64" for x in ("offset", "size", "complete", "lines")} | {"in_line": "boolean"})

    rows = rows if "whole" in rows.columns else rows.withColumn("whole", F.lit(True))
    return rows.select("path", "offset", "whole").repartition("path").mapInPandas(step, FACTS)


def newlines(rows: DataFrame, size: int = RANGE) -> DataFrame:
    """path, low, high, newlines: line ends in each range of plain files, by ranges (path, low, high) of any length.

    Ranges longer than ``size`` are counted in parts by many tasks and summed."""

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, a, b in zip(part["path"], part["a"], part["b"], strict=True):
                count = 0
                try:
                    with open(path, "rb") as raw:
                        raw.seek(a)
                        left = b - a
                        while left > 0 and (chunk := raw.read(min(left, 1 << 20))):
                            count, left = count + chunk.count(b"\n"), left - len(chunk)
                except DAMAGED:
                    pass
                out.append(count)
            yield part[["path", "low", "high"]].assign(newlines=out)

    cuts = F.explode(F.sequence(F.col("low"), F.greatest(F.col("high") - 1, F.col("low")), F.lit(size)))
    each = rows.select("path", "low", "high").distinct().withColumn("a", cuts).withColumn("b", F.least(F.col("a") + size, F.col("high")))
    counted = each.repartition("path", "a").mapInPandas(step, "path string, low long, high long, newlines long")
    return counted.groupBy("path", "low", "high").agg(F.sum("newlines").alias("newlines"))


def reads_to_its_end(rows: DataFrame) -> DataFrame:
    """path, whole: whether a compressed copy can be read to its end (a plain one always can)."""

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path in part["path"]:
                whole, opener = True, opener_of(path)
                try:
                    if opener:
                        with open(path, "rb") as raw:
                            stream = opener(raw, "rb")
                            while stream.read1(CHUNK):
                                pass
                except DAMAGED:
                    whole = False
                out.append(whole)
            yield pd.DataFrame({"path": part["path"], "whole": out})

    return rows.select("path").distinct().repartition("path").mapInPandas(step, "path string, whole boolean")
