"""Packing by column generation: token sequences of one length, with next to no padding.

A document of T ids is cut where only T decides: whole sequences first, then of the rest the largest
multiple of ``unit``, then a tail below one unit.  So one pass that encodes gives every piece with its
checksum, and planning sees a histogram of at most ``capacity / unit + unit`` lengths, however many documents.

The plan is the cutting-stock linear program: as few sequences as possible that hold every piece.  A revised
simplex keeps a basis of patterns; an unbounded knapsack over the dual prices finds the next pattern, until
none pays.  Counts of patterns are rounded down and what is left is packed first-fit, longest first.  Pieces
are ranked within their length in blocks (so no length, however common, is one task), and a piece's rank says
which copy of which pattern it goes to.

Defined results: null or empty text is the end id alone; equal or null doc_id are documents of their own
(each row is packed once); an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, stored, tidy
from .tokens import ENCODE_BYTES, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Rows of one length that one block of the ranking has, about; and the most blocks (their counts go to the driver).
BLOCK_ROWS, MOST_BLOCKS = 20_000, 4096


@dataclass(frozen=True)
class Packing:
    capacity: int = 4096
    unit: int = 64
    end: int = 2
    vocabulary: str | None = None

    def cuts(self, n: int) -> Iterator[tuple[int, int]]:
        """Starts and lengths of the pieces of a document of ``n`` ids."""
        at = 0
        while n - at >= self.capacity:
            yield at, self.capacity
            at += self.capacity
        if main := (n - at) // self.unit * self.unit:
            yield at, main
            at += main
        if at < n:
            yield at, n - at


def pieces_of(batches: Iterator[pa.RecordBatch], how: Packing) -> Iterator[pa.RecordBatch]:
    coder = encoder(how.vocabulary)
    for batch in batches:
        for part in slices(batch, "text", ENCODE_BYTES):
            offsets, ids = coder.encode(part.column("text"), how.end)
            rows = [
                (doc, at, n, zlib.crc32(ids[first + at : first + at + n].tobytes()), last - first)
                for doc, first, last in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                for at, n in how.cuts(last - first)
            ]
            if rows:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def best_pattern(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The unbounded knapsack: how many of each length give the dearest pattern, by dynamic programming.  Lengths descend."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(prices > 1e-12)[::-1]  # the shortest first
    sizes, worth = lengths[useful], prices[useful]
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if k := fit[c]:
            with_each = value[c - sizes[:k]] + worth[:k]
            j = int(with_each.argmax())
            if with_each[j] > value[c] + 1e-12:
                value[c], last[c] = with_each[j], useful[j]
    out, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= lengths[last[c]]
    return out


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, most: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns (numbers of each length) and how often each is used; together they hold exactly the demand.

    After ``most`` steps the basis as it is serves: it is feasible at every step, only longer."""
    if not len(lengths):
        return []
    order = np.argsort(-lengths)
    lengths, demand = lengths[order], demand[order]
    basis = np.diag(capacity // lengths).astype(float)  # one column a pattern, at first a single length each
    amount = demand / np.diag(basis)
    for _ in range(most):
        inverse = np.linalg.inv(basis)
        amount = inverse @ demand
        prices = inverse.sum(axis=0)
        pattern = best_pattern(prices, lengths, capacity)
        if prices @ pattern <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    used = [(basis[:, k].round().astype(np.int64), int(np.floor(amount[k] + 1e-6))) for k in range(len(lengths)) if amount[k] > 1 - 1e-6]
    left = demand - sum((p * n for p, n in used), np.zeros(len(lengths), np.int64))
    for k in range(len(used)):  # a rounding error must not promise more pieces than there are
        while (left < 0).any() and used[k][1] and ((used[k][0] > 0) & (left < 0)).any():
            used[k] = (used[k][0], used[k][1] - 1)
            left = left + used[k][0]
    while left.any():  # what rounding left over, first fit, longest first
        pattern, room = np.zeros(len(lengths), np.int64), capacity
        for k, size in enumerate(lengths):
            pattern[k] = min(left[k], room // size)
            room -= pattern[k] * size
        times = int(min(left[k] // pattern[k] for k in np.flatnonzero(pattern)))
        used.append((pattern, times))
        left = left - pattern * times
    back = np.argsort(order)
    return [(p[back], n) for p, n in used if n]


def layout(counts: dict[int, int], how: Packing) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, its runs: (first rank, first sequence, pieces in a copy, offset of the first in its copy)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    ranks, sequence = dict.fromkeys(counts, 0), 0
    for group in ([n for n in counts if n % how.unit == 0], [n for n in counts if n % how.unit]):
        # multiples of the unit in units: the same program, with a small knapsack
        scale = how.unit if group and group[0] % how.unit == 0 else 1
        lengths = np.array(sorted(group, reverse=True), np.int64)
        for pattern, times in solve(lengths // scale, np.array([counts[n] for n in lengths.tolist()], np.int64), how.capacity // scale):
            at = 0
            for n, k in zip(lengths.tolist(), pattern.tolist(), strict=True):
                if k:
                    runs[n].append((ranks[n], sequence, k, at))
                    ranks[n] += k * times
                    at += k * n
            sequence += times
    return runs


def in_blocks(pieces: DataFrame, blocks: int) -> DataFrame:
    """Stored pieces with their block.  Their places in the stored files are hashed too, so rows that are all alike are
    spread over blocks; every pass reads the same files and deals each row alike, whatever executors are lost."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    return pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", part, "_metadata.row_index"), F.lit(blocks)).cast("int"))


def pack(docs: DataFrame, how: Packing = Packing()) -> DataFrame:
    """A row for each piece of each document, with its sequence and its offset there."""
    spark = docs.sparkSession
    pieces = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(lambda batches: pieces_of(batches, how)), PIECES), "pieces")
    n = pieces.count()
    blocks = max(1, min(MOST_BLOCKS, n // BLOCK_ROWS))
    dealt = in_blocks(pieces, blocks)
    before, runs, counts = [], [], {}
    for row in dealt.groupBy("length", "block").count().orderBy("length", "block").collect():  # capacity / unit + unit lengths, MOST_BLOCKS at most
        before.append((row["length"], row["block"], counts.get(row["length"], 0)))
        counts[row["length"]] = counts.get(row["length"], 0) + row["count"]
    for length, found in layout(counts, how).items():
        runs.append((length, found))
    firsts = spark.createDataFrame(before, "length long, block int, before long")
    plan = spark.createDataFrame(runs, "length long, runs array<struct<first: long, sequence: long, copies: int, at: long>>")
    within = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(firsts), ["length", "block"]).join(F.broadcast(plan), "length")
    rank = F.col("before") + F.col("rank")
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("place")), -1)
    placed = ranked.withColumn("place", rank).withColumn("run", run).withColumn("beyond", F.col("place") - F.col("run.first"))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("run.sequence") + F.floor(F.col("beyond") / F.col("run.copies"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + F.col("beyond") % F.col("run.copies") * F.col("length")).cast("long").alias("offset"),
    )
