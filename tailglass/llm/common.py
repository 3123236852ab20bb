"""Helpers that the corpus operators share: words, hashes, batches, shared folders."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one slice of an Arrow batch may hold (a longer single text is a slice of its own).
SLICE_BYTES = 1 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode (tests) one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tailglass-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: lineage ends there, and any executor may go."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give back memory that this worker has freed: workers live on, and the next task may be of another kind."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def tidy(step: Callable) -> Callable:
    """A function for mapInArrow that releases memory at the end of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            release()

    return run


def lean(step: Callable) -> Callable:
    """A function for applyInArrow that releases memory after each group."""

    def run(*args):
        try:
            return step(*args)
        finally:
            release()

    # Spark tells by the number of parameters whether the key is wanted
    run.__signature__ = inspect.signature(step)
    return run


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch so that each part holds at most ``limit`` bytes of ``column``, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def sliced(step: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Callable:
    """A function for mapInArrow that applies ``step`` to each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                out = step(part)
                if out.num_rows:
                    yield out

    return tidy(run)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none): offsets by text, and all words in order."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])
    return ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()], words.filter(pa.array(full))


def word_codes(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, and the distinct words by number."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; the same word has the same hash in any task."""
    codes, distinct = word_codes(words)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct), U64, len(distinct))
    return h[codes] if len(codes) else np.zeros(0, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (public domain): spreads the bits of a 64-bit number."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def windows(hashes: np.ndarray, width: int, salt: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of ``width`` values, by its first; the last ``width - 1`` places are left out.

    A polynomial in an odd multiplier over word hashes, by doubling: no prefix sums, so nothing is
    divided and equal runs have equal hashes wherever they stand.
    """
    if len(hashes) < width:
        return np.zeros(0, U64)
    out, done, have, at = None, 0, hashes, 1
    m = U64(salt | 1)
    power = m
    need = width
    with np.errstate(over="ignore"):
        while need:
            if need & 1:
                out, done = (have, at) if out is None else (out[: len(out) - at] * power + have[done:][: len(out) - at], done + at)
            need >>= 1
            if need:
                have = have[: len(have) - at] * power + have[at:]
                power, at = power * power, at * 2
    return mix(out)


def spread(offsets: np.ndarray) -> np.ndarray:
    """For each item, the number of the text whose it is."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
