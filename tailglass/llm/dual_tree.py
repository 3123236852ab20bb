"""Hard negatives by a dual-tree search: trees over anchors and candidates, pruned by intervals of node pairs.

A node holds the centre and the radius of its rows, all of one label.  The inner products of a pair of nodes lie in
<a, c> -/+ (radius_a |c| + radius_c |a| + radius_a radius_c), so one comparison drops a whole group of anchors against
a whole group of candidates: where the interval's top is below what every anchor of the group has, or where it misses
all bands of the group.  Leaf pairs that stay are scored exactly, in integers.

Anchors come in blocks of bounded bytes, whose tree is broadcast; each task builds trees over blocks of its own
candidates and keeps the best of each anchor; the tasks' bests are reduced in two steps.  Two passes a block of anchors:
positives first, then the negatives within each positive's band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best import FOUND, LAST, NONE, Best, best_of_all
from .common import stored, tidy

MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Bytes of one block of anchors as it is sent to tasks, and of one block of candidates that a task holds.
ANCHOR_BYTES, BLOCK_BYTES = 16 << 20, 16 << 20
#: Rows of a leaf.
ANCHOR_LEAF, LEAF = 64, 256
#: A node's rows are parted half way between two far rows, or in two halves where one part would be a smaller share.
LEAST_SHARE = 16
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53


class Tree:
    """Rows in the order of the leaves; for each node its places, children, label, centre, radius and the centre's norm."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, leaf: int):
        self.order, self.leaf = np.argsort(labels, kind="stable"), leaf
        rows = rows.astype(np.float64)
        own, first = np.unique(labels[self.order], return_index=True)
        #: (first place, end, label) and the two children, or None for a leaf.
        self.nodes: list[tuple[int, int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.roots = [self._node(rows, a, b, x) for x, a, b in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(labels)], strict=True)]
        self.rows = rows[self.order]
        self.centre, self.radius = np.zeros((len(self.nodes), rows.shape[1])), np.zeros(len(self.nodes))
        for i, (low, high, _) in enumerate(self.nodes):
            self.centre[i] = self.rows[low:high].mean(axis=0)
            self.radius[i] = np.sqrt(((self.rows[low:high] - self.centre[i]) ** 2).sum(axis=1).max())
        self.norm = np.sqrt((self.centre**2).sum(axis=1))

    def _node(self, rows: np.ndarray, low: int, high: int, label: int) -> int:
        at = len(self.nodes)
        self.nodes.append((low, high, label))
        self.children.append(None)
        if high - low > self.leaf:
            own = self.order[low:high]
            vectors = rows[own]
            far = [vectors[((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmax()]]
            far.append(vectors[((vectors - far[0]) ** 2).sum(axis=1).argmax()])
            along = vectors @ (far[1] - far[0])  # from one far row to another
            half = int((along < (along.min() + along.max()) / 2).sum())
            if min(half, high - low - half) < (high - low) // LEAST_SHARE:
                half = (high - low) // 2
            self.order[low:high] = own[np.argpartition(along, half)]
            self.children[at] = self._node(rows, low, low + half, label), self._node(rows, low + half, high, label)
        return at


def interval(a: Tree, i: int, c: Tree, j: int) -> tuple[float, float]:
    """What the inner products of the rows of two nodes lie between, with room for rounding."""
    middle = float(a.centre[i] @ c.centre[j])
    reach = a.radius[i] * c.norm[j] + c.radius[j] * a.norm[i] + a.radius[i] * c.radius[j]
    reach += 1 + 1e-9 * (a.norm[i] + a.radius[i]) * (c.norm[j] + c.radius[j])
    return middle - reach, middle + reach


class Rows:
    """Numbers, labels and integer vectors; a vector that is shorter than another counts as having zeros behind."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        self.number = pc.fill_null(table["vec_id"], LAST).to_numpy()
        self.label = table["label"].to_numpy().astype(np.int64)
        vectors = table["q"].combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(vectors.offsets.to_numpy())
        self.q = np.zeros((len(sizes), int(sizes.max(initial=1))), np.int64)
        self.q[np.arange(self.q.shape[1]) < sizes[:, None]] = flat
        self.most = int(np.abs(flat).max(initial=0))

    def wide(self, size: int) -> np.ndarray:
        return np.pad(self.q, ((0, 0), (0, max(0, size - self.q.shape[1]))))


class Pair:
    """A tree over anchors and one over candidates, and the exact scores of two leaves."""

    def __init__(self, anchors: Rows, rows: Rows):
        size = max(anchors.q.shape[1], rows.q.shape[1])
        self.a, self.c = Tree(anchors.wide(size), anchors.label, ANCHOR_LEAF), Tree(rows.wide(size), rows.label, LEAF)
        self.number = rows.number[self.c.order]
        self.whole = None
        if size * max(1, anchors.most) * max(1, rows.most) >= EXACT:  # sums of products in 64-bit integers
            self.whole = anchors.wide(size)[self.a.order], rows.wide(size)[self.c.order]

    def scores(self, i: int, j: int) -> np.ndarray:
        (a, b, _), (c, d, _) = self.a.nodes[i], self.c.nodes[j]
        if self.whole is not None:
            return self.whole[0][a:b] @ self.whole[1][c:d].T
        return (self.a.rows[a:b] @ self.c.rows[c:d].T).astype(np.int64)

    def leaves(self, same: bool, useful) -> Iterator[tuple[int, int]]:
        """Pairs of leaves of the same label (or of different ones) that ``useful(anchor node, low, high)`` lets through.

        Of two children the one with the higher top comes first: what it gives narrows the rest."""
        stack = [(i, j) for i in self.a.roots for j in self.c.roots if (self.a.nodes[i][2] == self.c.nodes[j][2]) == same]
        while stack:
            i, j = stack.pop()
            if not useful(i, *interval(self.a, i, self.c, j)):
                continue
            below_a, below_c = self.a.children[i], self.c.children[j]
            if below_a is None and below_c is None:
                yield i, j
            elif below_c is None or below_a is not None and self.a.radius[i] > self.c.radius[j]:
                stack += [(x, j) for x in below_a]
            else:
                stack += [(i, x) for x in sorted(below_c, key=lambda x: float(self.a.centre[i] @ self.c.centre[x]))]


def search_positives(anchors: Rows, rows: Rows, best: Best) -> None:
    """Rows of an anchor's label by score, into its slot."""
    pair = Pair(anchors, rows)
    floor = best.floor[pair.a.order]

    def useful(i: int, low: float, high: float) -> bool:
        a, b, _ = pair.a.nodes[i]
        return high >= floor[a:b].min()

    for i, j in pair.leaves(True, useful):
        (a, b, _), (c, d, _) = pair.a.nodes[i], pair.c.nodes[j]
        scores = pair.scores(i, j)
        at, other = np.nonzero(scores >= floor[a:b, None])
        best.offer(pair.a.order[a + at], scores[at, other], pair.number[c + other])
        floor[a:b] = best.floor[pair.a.order[a:b]]


def search_negatives(anchors: Rows, low: np.ndarray, high: np.ndarray, rows: Rows, best: Best) -> None:
    """Rows of other labels within each band (anchor, positive) by score; a slot is a place in the bands."""
    pair, each = Pair(anchors, rows), low.shape[1]
    slots = pair.a.order[:, None] * each + np.arange(each)
    top = high[pair.a.order]
    floor = np.maximum(low[pair.a.order], best.floor[slots])
    closed = top < floor  # never an entry: no such band, or none that reaches the least entry

    def useful(i: int, least: float, most: float) -> bool:
        a, b, _ = pair.a.nodes[i]
        return bool((~closed[a:b] & (top[a:b] >= least) & (floor[a:b] <= most)).any())

    for i, j in pair.leaves(False, useful):
        (a, b, _), (c, d, _) = pair.a.nodes[i], pair.c.nodes[j]
        scores = pair.scores(i, j)
        for p in range(each):
            at, other = np.nonzero((scores >= floor[a:b, p, None]) & (scores <= top[a:b, p, None]))
            best.offer(slots[a + at, p], scores[at, other], pair.number[c + other])
        floor[a:b] = np.maximum(floor[a:b], best.floor[slots[a:b]])


def scanned(rows: DataFrame, slots: int, k: int, search) -> DataFrame:
    """The best ``k`` of each slot; ``search(rows, best)`` looks through a block of a task's candidates."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = Best(slots, k), [], 0
        for batch in batches:
            n = max(1, BLOCK_BYTES // max(1, batch.nbytes // max(1, batch.num_rows)))
            for i in range(0, batch.num_rows, n):
                part = batch.slice(i, n)
                if held and size + part.nbytes > BLOCK_BYTES:
                    search(Rows(held), best)
                    held, size = [], 0
                held.append(part)
                size += part.nbytes
        if size:
            search(Rows(held), best)
        yield best.found(TaskContext.get().partitionId())

    return best_of_all(rows.mapInArrow(tidy(step), FOUND), k)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, q = floor(256 x) of the rows that take part: no null or non-finite part, no null label."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    q = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))


def mined(rows: DataFrame, anchors: list[pa.RecordBatch], positives: int, negatives: int, per_cent: tuple[int, int]) -> DataFrame:
    """``hard_negatives`` for one block of anchors."""
    context = rows.sparkSession.sparkContext
    block = Rows(anchors)
    sent = context.broadcast(block)
    n = len(block.number)
    # the anchor itself is among the candidates: one more is kept, and one row with its number and score is dropped
    found = scanned(rows, n, positives + 1, lambda part, best: search_positives(sent.value, part, best)).toArrow()  # at most so many a slot
    slot, score = (found[c].to_numpy() for c in ("slot", "score"))
    number = pc.fill_null(found["number"], LAST).to_numpy()
    order = np.lexsort((number, ~score, slot))
    slot, score, number = slot[order], score[order], number[order]
    self_score = (block.q * block.q).sum(axis=1)
    own = np.flatnonzero((number == block.number[slot]) & (score == self_score[slot]))
    keep = np.ones(len(slot), bool)
    keep[own[np.unique(slot[own], return_index=True)[1]]] = False
    slot, score, number = slot[keep], score[keep], number[keep]
    place = np.arange(len(slot)) - np.searchsorted(slot, slot)
    slot, score, number, place = (x[place < positives] for x in (slot, score, number, place))
    low, high = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)  # empty bands
    whole = [int(x) for x in score]
    low[slot, place] = [-(-per_cent[0] * x // 100) for x in whole]
    high[slot, place] = [per_cent[1] * x // 100 for x in whole]
    bands = context.broadcast((low, high))
    found = scanned(rows, n * positives, negatives, lambda part, best: search_negatives(sent.value, *bands.value, part, best))
    ids = lambda x: [None if v == LAST else v for v in x.tolist()]
    names = list(zip((slot * positives + place).tolist(), ids(block.number[slot]), ids(number), whole, strict=True))
    names = rows.sparkSession.createDataFrame(names, "slot long, anchor_id long, positive_id long, positive_score long")
    return found.join(F.broadcast(names), "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("number").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(rows: DataFrame, is_anchor: str = "true", positives: int = 5, negatives: int = 3, per_cent: tuple[int, int] = (50, 95)) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label: the ``negatives`` best of other labels in the band.

    rows: vec_id, label, embedding; ``is_anchor`` is an SQL condition on them.  The band is ``per_cent[0] * p <=
    100 * score <= per_cent[1] * p`` for a positive's score p (p below 0 has none).  Components are floor(256 x), scores
    integer inner products, ties go to the smaller vec_id.  Rows with a null label, vector or component or one that is
    not finite take no part; a null vec_id comes last; rows that repeat stand each for itself; of vectors of different
    lengths the shorter ends in zeros.  An empty table gives no rows, and other columns are never read."""
    spark = rows.sparkSession
    marked = usable(rows.select("vec_id", "label", "embedding"))
    chosen = marked.where(is_anchor)
    many, wide = chosen.agg(F.count("*"), F.max(F.size("q"))).first()
    n = max(1, -(-many * 8 * (wide or 0) // ANCHOR_BYTES))
    dealt = chosen.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(n)))
    out = spark.createDataFrame([], MINED)
    for b in range(n):  # about ANCHOR_BYTES of anchors at a time
        anchors = dealt.where(F.col("block") == b).drop("block").toArrow().to_batches()
        if sum(x.num_rows for x in anchors):
            found = mined(marked, anchors, positives, negatives, per_cent)
            out = out.unionByName(stored(found, "mined") if b < n - 1 else found)
    return out
