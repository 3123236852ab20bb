"""Ranked lexical search: items times documents as a blocked sparse matrix product.

The left matrix has a row for each item: how often it holds each term.  The right one has a row for each of these
terms: the documents that hold it with their impacts, in 64-bit integers.  A task makes the right matrix for a block
of its documents at a time, merges the rows that an item names (Gustavson's method) and keeps each item's best ``k``;
the tasks' bests are reduced in two steps.  Items come in blocks of bounded size, each against all documents.

Nulls: a null text or item has no terms; a null doc_id comes last among equal scores, a null item_id is kept.  Rows
that repeat are documents and items each for itself.  Empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best import FOUND, LAST, Best, best_of_all
from .common import slices, split_words, spread, stored, tidy
from .tokens import gather

RANKED = "item_id long, rank int, doc_id long, score long"
#: Characters of the items of one block, and bytes of text of one block of documents.
BLOCK_CHARS, BLOCK_BYTES = 1 << 22, 4 << 20
#: Cells of the block of scores that is held at once, and products made at once.
CELLS, PRODUCTS = 1 << 20, 1 << 21
#: Numbers that stand for the documents with a term and for all terms, in the table of counts.
DOCUMENTS, TERMS = -1, -2

#: A term is a run of ASCII letters, digits and all that is not ASCII; only A-Z are lower-cased.
_KEPT = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_BYTES = np.where(_KEPT, np.arange(256), 0x20).astype(np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Terms of each text (null: none): offsets by text, and all terms in order."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    plain = _BYTES[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    return split_words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(plain)))


class Items:
    """The left matrix: rows of term numbers with multiplicities, and the terms by number."""

    def __init__(self, rows: list[tuple[int | None, str | None]], once: bool):
        self.ids = [k for k, _ in rows]
        offsets, words = terms_of(pa.array([t for _, t in rows], pa.large_string()))
        coded = words.dictionary_encode()
        self.terms = coded.dictionary
        n = max(1, len(self.terms))
        cells, times = np.unique(spread(offsets) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        self.row, self.term = cells // n, cells % n
        self.times = np.ones(len(cells), np.int64) if once else times.astype(np.int64)
        self.ends = np.searchsorted(self.row, np.arange(len(rows) + 1))

    def counted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text in all; and of the items' terms: text, term and occurrences, by term and text."""
        offsets, words = terms_of(texts)
        coded = words.dictionary_encode()
        number = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        known = term >= 0
        n = max(1, len(texts))
        cells, times = np.unique(term[known] * n + spread(offsets)[known], return_counts=True)
        return np.diff(offsets), cells % n, cells // n, times.astype(np.int64)


def counts(docs: DataFrame, sent) -> dict[int, int]:
    """How many documents hold each of the items' terms, documents with a term, and terms: sums over all documents."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        held, documents, terms = np.zeros(len(items.terms), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                sizes, _, term, _ = items.counted(part.column("text"))
                held += np.bincount(term, minlength=len(held))
                documents += int((sizes > 0).sum())
                terms += int(sizes.sum())
        there = np.flatnonzero(held)
        number = np.concatenate([there, [DOCUMENTS, TERMS]])
        yield pa.record_batch([pa.array(number, pa.int64()), pa.array(np.concatenate([held[there], [documents, terms]]), pa.int64())], names=["term", "n"])

    found = docs.select("text").mapInArrow(tidy(step), "term long, n long")
    return {r.term: r.n for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the block of items


def multiply(items: Items, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Item rows times the block's rows (sorted by term): scores of a few items at a time are held, then offered."""
    n = len(ids)
    own, first = np.unique(term, return_index=True)
    ends = np.append(first, len(term))
    local = np.minimum(np.searchsorted(own, items.term), max(len(own) - 1, 0))
    there = own[local] == items.term if len(own) else np.zeros(len(local), bool)
    row, local, times = items.row[there], local[there], items.times[there]
    work = np.concatenate([[0], np.cumsum(np.diff(ends)[local])])
    cuts = np.searchsorted(row, np.arange(len(items.ids) + 1))
    low = 0
    while low < len(items.ids):
        high = min(len(items.ids), low + max(1, CELLS // n))
        high = max(low + 1, min(high, int(np.searchsorted(work[cuts], work[cuts[low]] + PRODUCTS, side="right")) - 1))
        chosen = slice(cuts[low], cuts[high])
        sizes, docs = gather(ends, doc, local[chosen])
        _, values = gather(ends, impact, local[chosen])
        each = np.diff(sizes)
        scores = np.zeros((high - low) * n, np.int64)
        np.add.at(scores, np.repeat(row[chosen] - low, each) * n + docs, values * np.repeat(times[chosen], each))
        scores = scores.reshape(high - low, n)
        item, at = np.nonzero(scores >= np.maximum(best.floor[low:high], 1)[:, None])
        best.offer(item + low, scores[item, at], ids[at])
        low = high


def searched(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """The best ``k`` documents of each item of one block."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    counted = counts(docs, sent)
    n_docs, n_terms = counted.get(DOCUMENTS, 0), counted.get(TERMS, 0)
    #: floor(1000 ln((2 N + 2) / (2 df + 1))) of each term
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counted.get(t, 0) + 1))) for t in range(len(items.terms))], np.int64)
    weights = docs.sparkSession.sparkContext.broadcast(weight)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value, weights.value
        best = Best(len(items.ids), k)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                sizes, doc, term, times = items.counted(part.column("text"))
                if not len(doc):
                    continue
                m = 100 - 50 + (50 * sizes.astype(np.int64) * n_docs) // n_terms
                impact = weight[term] * ((1_000_000_000 * times) // (1000 * times + 20 * m[doc]))
                ids = pc.fill_null(part.column("doc_id"), LAST).to_numpy(zero_copy_only=False)
                multiply(items, doc, term, impact, ids, best)
        yield best.found(TaskContext.get().partitionId())

    found = best_of_all(docs.mapInArrow(tidy(step), FOUND), k)
    # the ids of one block of items: as many as it has rows
    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), "slot long, item_id long")
    return found.join(F.broadcast(names), "slot").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("number").alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, once: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    ``once``: a term that an item repeats counts once.  Scores above 0 alone are ranked."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = items.select(F.col("item_id").cast("long"), "text")
    n = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    out = docs.sparkSession.createDataFrame([], RANKED)
    for b in range(n):  # about block_chars of items at a time
        found = searched(docs, Items([(r.item_id, r.text) for r in dealt.where(F.col("block") == b).collect()], once), k)
        out = out.unionByName(stored(found, "ranked") if b < n - 1 else found)
    return out
