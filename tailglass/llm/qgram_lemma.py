"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A document holds an item if some window of ``window`` characters of the item (the whole item, if that is
shorter) is within ``edits`` insertions, deletions and substitutions of a passage of the document.  Both are
compared in lower case with runs of white space as one space.

If a window of L characters is within k edits of a passage, the two share L - q + 1 - kq q-grams, on at most
k + 1 neighbouring diagonals (place in the document less place in the item).  So: every q-gram of the
document is looked up among the items'; hits are counted in bands of 2k + 1 diagonals that overlap by k; an
item's bands where some window has the count stay; and those are verified by alignment inside the band.

Texts and items that repeat themselves (rules of dashes, tables) would meet in the product of their places.  A
passage is shorter than a segment, so what lies in a segment that the same text had before shows nothing that
the first one doesn't: only the first of equal segments is looked up and indexed.  What is left is counted a
range of items at a time, so that memory stays bounded.

An item below ``least`` characters allows no edits: it is held where it stands as a whole, between characters that
are neither letters nor digits, and is found by one hash.

The items are the query set: they go to the tasks in blocks of a stated size, each block against all
documents, whole.  Documents are read once a block, in one narrow pass without shuffle; of several blocks one at a
time is on the driver, and what it finds is written before the next.

Defined results: null or empty texts hold nothing, and null or blank items are not looked for; equal or null ids are
rows of their own (a pair of a null id has a null); other columns are not read, and ``drop_leaks`` carries them
through; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, sliced, stored, windows

PAIRS = "doc_id long, item_id long, item_start long, edits long"
#: Zeros between documents: more than a band reaches over a document's end.
GAP = 64
BITS = 22
#: Common q-grams to count at once, if no item has more of them.
MOST_HITS = 1 << 19


@dataclass(frozen=True)
class Lemma:
    q: int = 10
    window: int = 80
    #: Edits for each 1000 characters of a window.
    per_mille: int = 75
    #: Characters from which on an item may be found with edits.
    least: int = 24
    #: Characters of items in one block.
    block_chars: int = 4 << 20

    def edits(self, size: int) -> int:
        """At most so many that the lemma asks for one common q-gram at least."""
        return max(0, min(size * self.per_mille // 1000, (size - self.q) // self.q))


def plain(text: str | None) -> np.ndarray:
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    return windows((codes.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93), q)


def fresh(codes: np.ndarray, reach: int) -> np.ndarray | None:
    """Which places lie in no segment that the text had before; None for all.  A segment is two blocks of ``reach``
    characters, and one starts at each block, so every passage of at most ``reach`` lies in one, or in the rest."""
    n = len(codes) // reach
    if n < 3:
        return None
    rows = codes[: n * reach].reshape(n, reach)
    odd = mix(np.arange(1, reach + 1, dtype=U64)) | U64(1)
    with np.errstate(over="ignore"):
        keys = mix((rows * odd).sum(axis=1, dtype=U64))
        keys = keys[:-1] * U64(0x9E3779B97F4A7C15) + keys[1:]
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[of] != np.arange(n - 1))
    again = again[[bool((rows[j] == rows[f]).all() and (rows[j + 1] == rows[f + 1]).all()) for j, f in zip(again, first[of[again]], strict=True)]]
    if not len(again):
        return None
    keep = np.ones(n, bool)
    keep[again] = False
    keep[1:] |= keep[:-1].copy()  # a kept segment keeps both its blocks; the last block and the rest always stay
    return np.concatenate([np.repeat(keep, reach), np.ones(len(codes) - n * reach, bool)])


class Items:
    """A block of items and the places of their q-grams."""

    def __init__(self, rows: list[tuple[int | None, str | None]], how: Lemma):
        self.how = how
        every = [(k, codes) for k, text in rows if len(codes := plain(text))]
        kept = [x for x in every if len(x[1]) >= max(how.least, how.q)]
        short = [x for x in every if len(x[1]) < max(how.least, how.q)]
        self.ids, self.codes = [k for k, _ in kept + short], [c for _, c in kept]
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        #: By length: hashes of the short items in order, and their numbers.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(c) for _, c in short}:
            own = [(grams(c, size)[0], len(kept) + i) for i, (_, c) in enumerate(short) if len(c) == size]
            own.sort()
            self.short[size] = np.array([h for h, _ in own], U64), np.array([i for _, i in own], np.int64)
        #: Longer than any passage that a window fits, and the q-gram at its end.
        self.reach = how.window + 2 * how.edits(how.window) + how.q
        keys, places = [], []
        for c in self.codes:
            own, new = grams(c, how.q), fresh(c, self.reach)
            places.append(np.arange(len(own)) if new is None else np.flatnonzero(new[: len(own)]))
            keys.append(own[places[-1]])
        flat = np.concatenate([np.zeros(0, U64), *keys])
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.item, self.place = item[order], np.concatenate([np.zeros(0, np.int64), *places])[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.keys >> U64(64 - BITS)] = True

    def hits(self, codes: np.ndarray, new: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place in the text, item and place in the item of every common q-gram at a new place, by ranges of items."""
        found = grams(codes, self.how.q)
        at = np.flatnonzero(self.seen[found >> U64(64 - BITS)] & new[: len(found)])
        if not len(at) or not len(self.keys):
            return
        near = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
        good = self.keys[near] == found[at]
        at, near = at[good], near[good]
        many = np.diff(self.first)
        cuts = [0, len(self.codes)]
        if many[near].sum() > MOST_HITS:
            each = np.cumsum(np.bincount(self.item, np.repeat(np.bincount(near, minlength=len(many)), many), len(self.codes)))
            cuts = [0]
            while cuts[-1] < len(each):
                done = each[cuts[-1] - 1] if cuts[-1] else 0
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(each, done + MOST_HITS, side="right"))))
        place = np.repeat(np.arange(len(many)), many) * len(self.codes) + self.item  # ascending: postings by key, then item
        for low, high in zip(cuts, cuts[1:]):  # noqa: B905
            begin, end = (np.searchsorted(place, near * len(self.codes) + x) for x in (low, high))
            n = end - begin
            ends = np.concatenate([[0], np.cumsum(n)])
            if ends[-1]:
                postings = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)
                yield np.repeat(at, n), self.item[postings], self.place[postings]

    def whole(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the text and item, wherever a short item stands by itself."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for size, (keys, numbers) in self.short.items():
            found = grams(codes, size)
            low, high = np.searchsorted(keys, found), np.searchsorted(keys, found, side="right")
            at = np.flatnonzero(high > low)
            edges = [codes[np.maximum(at - 1, 0)], codes[np.minimum(at + size, len(codes) - 1)]]
            apart = np.ones(len(at), bool)
            for edge in edges:
                kinds, of = np.unique(edge, return_inverse=True)
                apart &= ~np.array([chr(x).isalnum() for x in kinds.tolist()], bool)[of]
            at = at[apart]
            n = (high - low)[at]
            ends = np.concatenate([[0], np.cumsum(n)])
            out.append((np.repeat(at, n), numbers[np.arange(ends[-1]) + np.repeat(low[at] - ends[:-1], n)]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def align(text: np.ndarray, at: np.ndarray, patterns: list[np.ndarray], low: np.ndarray, width: int) -> np.ndarray:
    """The least edits of each pattern against a passage of the text, on diagonals low .. low + width - 1 from ``at``.

    All patterns step together; a cell is a pattern's prefix on a diagonal, and a passage may start and end anywhere."""
    longest = max(map(len, patterns))
    grid = np.zeros((len(patterns), longest), np.uint32)
    for row, p in zip(grid, patterns, strict=True):
        row[: len(p)] = p
    lengths = np.array([len(p) for p in patterns])
    diagonal = np.arange(width)
    start = (at + low)[:, None] + diagonal
    cost = np.zeros((len(patterns), width), np.int32)
    for i in range(longest):
        where = start + i
        inside = (where >= 0) & (where < len(text))
        same = inside & (text[np.clip(where, 0, len(text) - 1)] == grid[:, i : i + 1])
        new = cost + ~same
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        new = np.minimum.accumulate(new - diagonal, axis=1) + diagonal
        cost = np.where((i < lengths)[:, None], new, cost)
    return cost.min(axis=1)


def search(texts: pa.Array, items: Items) -> list[tuple[int, int, int, int]]:
    """(text number, item number, start in the item, edits) for each item that a text holds."""
    how = items.how
    codes = [plain(t) for t in texts.to_pylist()]
    gap = np.zeros(GAP, np.uint32)
    text = np.concatenate([gap, *(x for c in codes for x in (c, gap))])
    starts = np.cumsum([GAP, *(len(c) + GAP for c in codes)])[:-1]
    new = np.ones(len(text), bool)
    for first, c in zip(starts.tolist(), codes, strict=True):
        if (own := fresh(c, items.reach)) is not None:
            new[first : first + len(c)] = own
    at, item = items.whole(text)
    found = {(d, i): (0, 0) for d, i in zip((np.searchsorted(starts, at, side="right") - 1).tolist(), item.tolist(), strict=True)}
    for hits in items.hits(text, new):
        passages(text, starts, items, *hits, found)
    return [(d, i, s, cost) for (d, i), (s, cost) in sorted(found.items())]


def passages(text: np.ndarray, starts: np.ndarray, items: Items, at: np.ndarray, item: np.ndarray, place: np.ndarray, found: dict[tuple[int, int], tuple[int, int]]) -> None:
    """Count common q-grams by band, and put the items that are verified into ``found``: start in the item, edits."""
    how = items.how
    doc = np.searchsorted(starts, at, side="right") - 1
    size = np.minimum(items.sizes, how.window)
    k = np.array([how.edits(n) for n in size.tolist()], np.int64)
    need = size - how.q + 1 - k * how.q
    step = k[item] + 1
    diagonal = at - place
    band = diagonal // step
    again = diagonal % step < k[item]  # the band before reaches over by k
    doc, item, place, band = (np.concatenate([x, x[again]]) for x in (doc, item, place, band))
    band[len(again) :] -= 1
    order = np.lexsort((place, band, item, doc))
    doc, item, place, band = doc[order], item[order], place[order], band[order]
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
    once = np.concatenate([[True], other[1:] | (place[1:] != place[:-1])])  # a place of the item counts once
    doc, item, place, band, group = doc[once], item[once], place[once], band[once], np.cumsum(other)[once] - 1
    firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    counts = np.diff(np.append(firsts, len(group)))
    waiting = []
    for f, n in zip(firsts[keep := counts >= need[item[firsts]]].tolist(), counts[keep].tolist(), strict=True):
        i = int(item[f])
        there = np.zeros(items.sizes[i] - how.q + 2, np.int64)
        there[place[f : f + n] + 1] = 1
        total = np.cumsum(there)
        span = size[i] - how.q + 1
        common = total[span:] - total[:-span]  # q-grams of each window of the item
        if len(good := np.flatnonzero(common >= need[i])):
            waiting.append((int(doc[f]), i, int(band[f]), good[np.argsort(-common[good], kind="stable")]))

    def verify(tries: list[tuple[int, int, int, int]]) -> None:
        for n in range(0, len(tries), 2048):
            part = [x for x in tries[n : n + 2048] if x[:2] not in found]
            if not part:
                continue
            each = np.array([k[i] for _, i, _, _ in part])
            # the band's diagonals, and k more to each side for passages that start or end off it
            low = np.array([b * (k[i] + 1) for _, i, b, _ in part]) - each
            patterns = [items.codes[i][s : s + size[i]] for _, i, _, s in part]
            edits = align(text, np.array([s for *_, s in part]), patterns, low, int(4 * each.max() + 2))
            for (d, i, _, s), cost, most in zip(part, edits.tolist(), each.tolist(), strict=True):
                if cost <= most:
                    found.setdefault((d, i), (s, cost))

    verify([(d, i, b, int(s[0])) for d, i, b, s in waiting])  # the fullest window of each band first
    rest = [x for x in waiting if x[:2] not in found]
    for n in range(0, len(rest), 256):  # windows are written out for some bands at a time
        verify([(d, i, b, int(x)) for d, i, b, s in rest[n : n + 256] for x in s[1:]])


def blocks(benchmark: DataFrame, how: Lemma) -> Iterator[tuple[Items, bool]]:
    """The items in blocks of bounded size, each with its index, and whether there is another; one is held at a time."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text")
    n = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // how.block_chars))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for b in range(n):
        yield Items([(r.item_id, r.text) for r in dealt.where(F.col("block") == b).collect()], how), b < n - 1  # block_chars or about


def leaks(docs: DataFrame, benchmark: DataFrame, how: Lemma = Lemma()) -> DataFrame:
    """A row for each document and each item that it holds."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    out = spark.createDataFrame([], PAIRS)
    for block, more in blocks(benchmark, how):
        sent = spark.sparkContext.broadcast(block)

        def step(part: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            items, ids = sent.value, part.column("doc_id").to_pylist()
            rows = [(ids[d], items.ids[i], s, cost) for d, i, s, cost in search(part.column("text"), items)]
            return pa.record_batch([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=[x.split()[0] for x in PAIRS.split(", ")])

        found = docs.mapInArrow(sliced(step, "text"), PAIRS)
        if more:
            found = stored(found, "leaks")
            sent.destroy()
        out = out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, how: Lemma = Lemma()) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for block, more in blocks(benchmark, how):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def step(part: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            keep = np.ones(part.num_rows, bool)
            keep[[d for d, *_ in search(part.column("text"), sent.value)]] = False
            return part.filter(pa.array(keep))

        docs = docs.mapInArrow(sliced(step, "text"), docs.schema)
        if more:
            docs = stored(docs, "clean")
            sent.destroy()
    return docs
