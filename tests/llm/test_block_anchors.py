import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tailglass.llm.block_anchors import G, bucket_of, cut_repeats, deal, pack, repeat_digest, unpack

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        cut = {i + j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in cut)
        out.append((k, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, width=35):
    made = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, keys string")
    assert sorted(map(tuple, repeat_digest(made, width).collect()), key=str) == brute(rows, width)


def test_against_brute_force(spark, docs01):
    rows = [(r.doc_id, r.text) for r in docs01.collect()]
    passage = " ".join(f"p{i}" for i in range(35))
    longer = " ".join(f"q{i}" for i in range(90))
    rows += [(None, None), (None, ""), (-1, " \n "), (-2, "a b " * 40), (-3, f"u {passage} v"), (-4, f"{passage}"), (-4, f"{passage}"), (-5, f"x y {longer}\t{longer} z"), (-6, " ".join(f"p{i}" for i in range(34)))]
    rows += [(-100 - i, " ".join(f"{i}-{j}" for j in range(i)) + f" {longer} end") for i in range(60)]
    check(spark, rows)


def test_small_windows(spark):
    rng = np.random.default_rng(3)
    check(spark, [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 60)))) for i in range(80)], 8)


def test_text_keeps_its_layout(spark):
    passage = " ".join(f"p{i}" for i in range(35))
    made = spark.createDataFrame([(1, f"  a\n{passage}\nb\n\nc", "en", "s", 0), (2, passage, "en", "s", 0), (3, "x\ty", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cut_repeats(made).collect()}
    assert got == {1: ("  a\nb\n\nc", 8), 2: ("", 0), 3: ("x\ty", 3)}


def test_empty_table(spark):
    assert repeat_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, unique=True))
def test_packed_lists(values):
    keys = np.sort(np.array(values, np.uint64))
    assert (unpack(pack(keys)) == keys).all()
    buckets = bucket_of(keys, 24, 64)
    assert (np.diff(buckets) >= 0).all() and buckets.min() >= 0 and buckets.max() < 24


def test_repeated_row_is_spread(spark):
    rows = [(7, " ".join(f"w{i}" for i in range(40)))] * 600 + [(i, f"own {i}") for i in range(300)] + [(None, None)] * 200
    made = spark.createDataFrame(rows, "doc_id long, text string")
    groups = deal(made).groupBy(F.pmod(G, F.lit(24))).count()
    assert max(r["count"] for r in groups.collect()) < 3 * len(rows) / 24
    check(spark, rows)


def test_input_of_another_order_in_each_reading(spark):
    """Rows are dealt once: an input that is shuffled anew by each pass loses no repeat."""
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own{i} {same} end{i}") for i in range(300)] + [(7, same)] * 100
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("r", F.uuid()).repartition(7, "r").drop("r")
    got = repeat_digest(made).collect()
    assert len(got) == 400 and all(r.n_removed == 60 for r in got)
