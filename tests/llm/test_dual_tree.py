import math
import random
from collections import Counter

from tailglass.llm import dual_tree
from tailglass.llm.dual_tree import hard_negatives

SCHEMA = "vec_id int, label int, embedding array<float>, score string, rank int, slot int, q string"


def brute(rows, anchor, positives=5, negatives=3, per_cent=(50, 95)):
    import numpy as np

    own = []
    for n, (i, label, v) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a[3], b[3], strict=False))
    last = lambda i: (i is None, i or 0)
    out = Counter()
    for a in own:
        if not anchor(a[1]):
            continue
        same = sorted((-score(a, r), last(r[1])) for r in own if r[0] != a[0] and r[2] == a[2])[:positives]
        for s, (none, i) in same:
            p = -s
            found = sorted((-score(a, r), last(r[1])) for r in own if r[2] != a[2] and per_cent[0] * p <= 100 * score(a, r) <= per_cent[1] * p)
            for rank, (t, (no, j)) in enumerate(found[:negatives]):
                out[a[1], None if none else i, rank + 1, None if no else j, p, -t] += 1
    return out


def mined(spark, rows, condition, **how):
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3)
    found = hard_negatives(frame, condition, **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(map(tuple, found.collect()))


def some(rng, n, size=6, near=0.0):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    return [(i, rng.randrange(4), [near * c + rng.gauss(0, 0.4) for c in centres[rng.randrange(4)]]) for i in range(n)]


def test_same_as_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    rows = some(rng, 400, near=1.0) + [(401, None, [1.0] * 6), (402, 1, None), (403, 1, [1.0, None] * 3), (404, 1, [float("nan")] * 6), (405, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (None, 2, [0.9] * 6)]
    rows += [(20, 1, [0.5] * 6)] * 3 + [(500 + i, i % 2, [0.5] * 6) for i in range(60)] + [(700, 3, []), (710, 3, [0.7, 0.7]), (720, 3, [0.0] * 6)]
    rows += [(730, 8, [1.0] * 6), (740, -3, [3e4] * 6), (741, -3, [2e4] * 6), (742, 9, [1.5e4] * 6)]
    assert mined(spark, rows, "vec_id % 10 = 0") == brute(rows, lambda i: i is not None and i % 10 == 0)
    want = brute(rows, lambda i: i is not None and i % 10 == 0, 2, 4, (10, 120))
    monkeypatch.setattr(dual_tree, "ANCHOR_BYTES", 1000)  # many blocks of anchors
    assert mined(spark, rows, "vec_id % 10 = 0", positives=2, negatives=4, per_cent=(10, 120)) == want


def test_node_pairs_are_pruned(spark):
    """Rows in tight groups: most pairs of nodes are dropped, and nothing that matters with them."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (20, 8))

    def some(n, step):
        own = [np.floor(centres[i % 20] + rng.normal(0, 3, 8)).astype(np.int64).tolist() for i in range(0, n, step)]
        return dual_tree.Rows([pa.record_batch([pa.array(range(0, n, step)), pa.array([i % 4 for i in range(0, n, step)], pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["vec_id", "label", "q"])])

    anchors, rows = some(16_000, 7), some(16_000, 1)
    pair, best = dual_tree.Pair(anchors, rows), dual_tree.Best(len(anchors.number), 3)
    seen, before = [], dual_tree.Pair.scores

    def counted(self, i, j):
        seen.append(1)
        return before(self, i, j)

    dual_tree.Pair.scores = counted
    try:
        dual_tree.search_positives(anchors, rows, best)
    finally:
        dual_tree.Pair.scores = before
    leaves = [sum(c is None for c in t.children) for t in (pair.a, pair.c)]
    assert len(seen) < leaves[0] * leaves[1] / 4 / 2  # half of the pairs of one label at most
    scores = anchors.q @ rows.q.T
    scores[anchors.label[:, None] != rows.label] = np.iinfo(np.int64).min
    assert (np.sort(scores, axis=1)[:, :-4:-1] == best.score).all()


def test_empty(spark):
    assert mined(spark, [(1, 1, [1.0])], "vec_id % 2 = 0") == Counter()
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
