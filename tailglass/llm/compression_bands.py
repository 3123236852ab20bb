"""Quality rules: base counts of a text, and zstandard ratios against limits by length.

A ratio is compressed bytes over bytes.  Repetitive text compresses far below prose of its length, and
encoded or random text hardly compresses; short texts compress badly whatever they say, so the limits
depend on the length and texts below the first band get no verdict from the method.

Defined results: a null or empty text has no words, zero counts and fails the base rule; a doc_id may be
null or repeat (one row out for each row in); columns other than the two named are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, split_words, spread, windows, word_codes, mix

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, ratio double, chunk_low double, chunk_high double"
)
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """Texts of at least ``least`` bytes: the whole text's ratio must be in [low, high]."""

    least: int
    low: float
    high: float


#: Prose of any of the usual languages stays well inside; text that repeats itself a few times over falls
#: below, base64 and random bytes rise above.
BANDS = (Band(256, 0.25, 1.00), Band(512, 0.20, 0.88), Band(1024, 0.16, 0.80), Band(4096, 0.13, 0.74), Band(16384, 0.10, 0.70))


@dataclass(frozen=True)
class Limits:
    """Base rule and bands.  A chunk is ``chunk_bytes`` of the text in UTF-8; the last one reaches back to be as long, so
    that every byte is in a chunk.  A text fails if over ``chunk_share`` of its chunks are below ``chunk_low`` or over
    that share above ``chunk_high``.  A text below half a chunk is one chunk, whose limits are its band's."""

    min_words: int = 20
    repeat_percent: int = 30
    repeat_width: int = 8
    level: int = 3
    bands: tuple[Band, ...] = BANDS
    chunk_bytes: int = 2048
    chunk_low: float = 0.12
    chunk_high: float = 0.76
    chunk_share: float = 0.5


def repeat_words(offsets: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """Words of each text that are in a window of ``width`` words found twice or more in that text."""
    n, out = len(codes), np.zeros(len(offsets) - 1, np.int64)
    if n < width:
        return out
    text = spread(offsets)
    at = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    with np.errstate(over="ignore"):
        keys = windows(mix(codes.astype(np.uint64) + np.uint64(1)), width)[at] + mix(text[at].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    near, keys = at[order], keys[order]
    pair = np.flatnonzero((keys[1:] == keys[:-1]) & (text[near[1:]] == text[near[:-1]]))
    for k in range(width):  # equal hashes are not yet equal words
        pair = pair[codes[near[pair] + k] == codes[near[pair + 1] + k]]
    ends = np.zeros(n + 1, np.int64)
    twice = np.unique(np.concatenate([near[pair], near[pair + 1]]))
    np.add.at(ends, twice, 1)
    np.add.at(ends, twice + width, -1)
    return np.bincount(text[np.cumsum(ends)[:n] > 0], minlength=len(out)).astype(np.int64)


def dup_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(WHITE):
            seen.add(line)
    return again


def in_bands(data: bytes, limits: Limits, compressor: zstandard.ZstdCompressor) -> tuple[bool, float | None, float | None, float | None]:
    """The verdict, the whole text's ratio, and the shares of chunks below and above."""
    if not data:
        return True, None, None, None
    ratio = len(compressor.compress(data)) / len(data)
    band = next((b for b in limits.bands[::-1] if len(data) >= b.least), Band(0, 0, np.inf))  # below all bands: no verdict
    good = band.low <= ratio <= band.high
    size = limits.chunk_bytes
    if len(data) <= size:
        least, most = (band.low, band.high) if 2 * len(data) < size else (limits.chunk_low, limits.chunk_high)
        ratios = [ratio]
    else:
        least, most = limits.chunk_low, limits.chunk_high
        starts = [*range(0, len(data) - size + 1, size), *([len(data) - size] if len(data) % size else [])]
        ratios = [len(compressor.compress(data[i : i + size])) / size for i in starts]
    low = sum(r < least for r in ratios) / len(ratios)
    high = sum(r > most for r in ratios) / len(ratios)
    return good and low <= limits.chunk_share and high <= limits.chunk_share, ratio, low, high


def measure(batch: pa.RecordBatch, limits: Limits) -> pa.RecordBatch:
    texts = batch.column("text")
    offsets, words = split_words(texts)
    codes = word_codes(words)[0] if len(words) else np.zeros(0, np.int64)
    n_words = np.diff(offsets)
    repeated = repeat_words(offsets, codes, limits.repeat_width)
    compressor = zstandard.ZstdCompressor(level=limits.level)
    chars, symbols, lines, verdicts = [], [], [], []
    for text in texts.to_pylist():
        text = text or ""
        chars.append(len(text) - sum(map(text.count, WHITE)))
        symbols.append(sum(map(text.count, SYMBOLS)))
        lines.append(dup_lines(text))
        verdicts.append(in_bands(text.encode(), limits, compressor))
    failed = (n_words < limits.min_words) | (100 * repeated > limits.repeat_percent * n_words)
    good, ratio, low, high = zip(*verdicts, strict=True)
    long = lambda x: pa.array(x, pa.int64())
    real = lambda x: pa.array(x, pa.float64())
    columns = [batch.column("doc_id"), long(n_words), long(chars), long(symbols), long(lines), long(repeated), pa.array(failed), pa.array(~failed & np.array(good)), real(ratio), real(low), real(high)]
    return pa.record_batch(columns, names=[f.split()[0] for f in SCHEMA.split(",")])


def compression_bands(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row of counts, ratios and verdicts for each document; narrow, no shuffle."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sliced(lambda batch: measure(batch, limits)), SCHEMA)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, in one narrow pass."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.nulls(batch.num_rows, pa.int64())
        return batch.filter(measure(pa.record_batch([ids, batch.column("text")], names=["doc_id", "text"]), limits).column("kept"))

    return docs.mapInArrow(sliced(step), docs.schema)
