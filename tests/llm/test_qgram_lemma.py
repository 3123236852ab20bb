import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from tailglass.llm.qgram_lemma import Items, Lemma, drop_leaks, leaks, plain, search


def distance(pattern, text):
    """Least edits of the pattern against any passage of the text, cell by cell."""
    last = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j - 1] + (a != b), last[j] + 1, row[-1] + 1))
        last = row
    return min(last)


def brute(docs, items, how):
    out = set()
    for d, text in enumerate(docs):
        t = " ".join((text or "").lower().split())
        for i, item in enumerate(items):
            p = " ".join((item or "").lower().split())
            if len(p) < how.least:
                if p and re.search(rf"(?<![^\W_]){re.escape(p)}(?![^\W_])", t):
                    out.add((d, i))
            else:
                n = min(len(p), how.window)
                if any(distance(p[s : s + n], t) <= how.edits(n) for s in range(len(p) - n + 1)):
                    out.add((d, i))
    return out


def spoiled(rng, text, n):
    x = list(text)
    for _ in range(n):
        k = rng.randrange(len(x))
        x[k : k + rng.randrange(2)] = rng.choice(["", "z", "é"])
    return "".join(x)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_match_brute_force(seed):
    rng = random.Random(seed)
    how = Lemma(q=5, window=30, per_mille=100, least=12)
    words = ["the", "of", "and", "tion", "ering", "onha", "x"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", rng.choice(words)]) for _ in range(n))
    items = [prose(9), prose(4), "the of the", prose(3), None, "x", "OF", " ", "onha x", "x"]
    docs = [None, "", prose(30)]
    for _ in range(25):
        a, b = rng.choice(items[:4]), rng.choice(["", prose(6)])
        cut = rng.randrange(0, max(1, len(a) - 12))
        docs.append(f"{b} {spoiled(rng, a[cut:], rng.randrange(6))} {prose(rng.randrange(5))}".upper())
    index = Items(list(enumerate(items)), how)
    got = {(d, index.ids[i]) for d, i, _, _ in search(pa.array(docs), index)}
    assert got == brute(docs, items, how)
    assert len(got) > 3


def test_over_tables(spark, docs01, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    texts = {r.doc_id: r.text for r in docs01.collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if " ".join(x.lower().split()) in " ".join(t.lower().split())}
    got = {(r.doc_id, r.item_id) for r in leaks(docs01, bench).collect()}
    assert whole <= got
    for small in (Lemma(block_chars=2000),):
        assert {(r.doc_id, r.item_id) for r in leaks(docs01, bench, small).collect()} == got
    assert {r.doc_id for r in drop_leaks(docs01, bench).collect()} == texts.keys() - {d for d, _ in got}
    assert drop_leaks(docs01, bench).columns == docs01.columns


def test_nulls_and_empty_tables(spark):
    item = "A question that has a good many characters, so that it means something to find it."
    docs = spark.createDataFrame([(None, f"so:\n\n {item.upper()} yes"), (1, None), (2, ""), (2, item[:-4]), (2, item[5:])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (None, None), (8, "short")], "item_id long, text string")
    assert sorted(map(str, ((r.doc_id, r.item_id) for r in leaks(docs, bench).collect()))) == ["(2, 7)", "(2, 7)", "(None, 7)"]
    brief = spark.createDataFrame([(1, "so: SHORT, yes"), (2, "shorter"), (3, "cut\nshort")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks(brief, bench).collect()) == [(1, 8), (3, 8)]
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
    assert drop_leaks(docs, bench.limit(0)).count() == 5


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_texts_match_brute_force(seed):
    """Rules, tables and repeated passages on both sides, with items that hold some of them."""
    rng = random.Random(seed)
    how = Lemma(q=5, window=30, per_mille=100, least=12)
    prose = lambda n: " ".join(rng.choice(["the", "of", "tion", "onha", "x1"]) for _ in range(n))
    row, items = "| a | bc ", [f"{prose(4)} {'-' * 20} {prose(3)}", "=-" * 30, "-" * 25, "| a | bc " * 9 + "end of it all", prose(12)]
    docs = ["-" * 700, "=-" * 300, row * 60 + "end of it oll", f"{prose(5)} {'-' * 300} {prose(5)}", (prose(10) + " ") * 9 + items[4], row * 40 + items[0] + row * 40, items[4] * 3 + "-" * 200]
    index = Items(list(enumerate(items)), how)
    got = {(d, index.ids[i]) for d, i, _, _ in search(pa.array(docs), index)}
    assert got == brute(docs, items, how) and len(got) > 6


RULES = """
import resource, sys
import pyarrow as pa
from tailglass.llm.qgram_lemma import Items, Lemma, search
items = ["-" * 120, "see below " + "-" * 50 + " and what stands after the rule is prose that goes on for a while", *("n%d " % i + "-" * 70 + " text" for i in range(300))]
index = Items(list(enumerate(items)), Lemma())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = {i for _, i, *_ in search(pa.array(["-" * 1_000_000, "=+" * 200_000]), index)}
print(0 in found, 1 in found, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_megabyte_of_dashes():
    out = subprocess.run([sys.executable, "-c", RULES], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert out[:2] == ["True", "False"] and int(out[2]) < 200, out


def test_plain():
    assert "".join(map(chr, plain(" A b\n"))) == "a b" and len(plain(None)) == 0 and np.uint32 == plain("x").dtype
