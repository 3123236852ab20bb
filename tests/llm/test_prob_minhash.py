import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from tailglass.llm.prob_minhash import Near, labels, least_inverse, marks_of, near_classes, shingles, signatures, similarity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jp(x, y):
    """The definition, 1 / sum_j max(x_j / x_i, y_j / y_i) over common i; that sum is x_i's share of one for each ratio x_i / y_i."""
    common = x.keys() & y.keys()
    sums = {r: sum(max(x[j], y[j] * r) for j in x.keys() | y.keys()) for r in {x[i] / y[i] for i in common}}
    return sum(x[i] / sums[x[i] / y[i]] for i in common)


def classes(rows):
    """Brute force: all pairs of distinct texts."""
    bags = {t: bag(t) for _, t in rows if bag(t)}
    texts, parent = list(bags), {t: t for t in bags}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    index = {}
    for k, t in enumerate(texts):
        for s in bags[t]:
            index.setdefault(s, []).append(k)
    seen = {(a, b) for ks in index.values() for a in ks for b in ks if a < b}
    for a, b in seen:
        x, y = bags[texts[a]], bags[texts[b]]
        if 0.79 < sum((x & y).values()) / sum((x | y).values()) * 1.3 and jp(x, y) >= 0.8:
            parent[find(texts[a])] = find(texts[b])
    group = {}
    for k, t in rows:
        if t in bags and k is not None:
            group[find(t)] = min(k, group.get(find(t), k))
    return Counter((k, group.get(find(t)) if t in bags else k) for k, t in rows)


def edited(rng, text, share):
    return " ".join(rng.choice(["new", "word", str(rng.random())]) if rng.random() < share else w for w in text.split(" "))


def test_classes_match_brute_force(spark, docs01):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in docs01.collect()]
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(300))
    rows += [(2000 + i, edited(rng, base, 0.01)) for i in range(60)]
    rows += [(3000 + i, base) for i in range(40)] + [(None, base), (None, None), (4000, ""), (4001, ""), (4002, " \n"), (4003, "a b"), (4004, "a b"), (4004, "a  b"), (4005, "a c")]
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, node int")
    got = near_classes(frame).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == classes(rows)
    assert {r.class_size for r in got if r.class_id == 2000} == {101}


def test_registers_estimate_jp():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words + words[:90] * 2), " ".join(edited(rng, w, 0.03) for w in [" ".join(words)] * 2)
    text, keys, counts = shingles(pa.array([a, b, "", "one two"]), 5)
    sigs, has = signatures(text, keys, counts, 4, 4096)
    assert has.tolist() == [True, True, False, True]
    pick = lambda i: (keys[text == i], counts[text == i])
    exact = jp(bag(a), bag(b))
    assert abs(similarity(pick(0), pick(1)) - exact) < 1e-9 and 0.1 < exact < 0.9
    assert abs((sigs[0] == sigs[1]).mean() - exact) < 0.04
    # a shingle wins registers in proportion to its weight
    x = pick(0)
    share = np.isin(sigs[0], x[0][x[1] == 3]).mean()
    assert abs(share - 3 * (x[1] == 3).sum() / x[1].sum()) < 0.04


def test_the_bound_is_above_jp(spark):
    """Of any two texts, whatever is known to be theirs alone and whatever is marked."""
    rng, rows = random.Random(5), []
    number = lambda k: int(xxhash.xxh3_64_intdigest(k))
    for n in range(400):
        size = 30 if n % 2 else 300
        common = {f"c{i}": None for i in range(rng.randrange(1, size))}
        x, y = ({k: rng.choice([1, 1, 1, 2, 5]) for k in [*common, *(f"{name}{i}" for i in range(rng.randrange(size // 2)))]} for name in "xy")
        facts = []
        for z in (x, y):
            lone = {k for k in z if k not in common and rng.random() < 0.5}
            others = np.array([number(k) for k in z if k not in lone], np.uint64)
            facts += [len(z), sum(z.values()), len(lone), sum(z[k] for k in lone), marks_of(others)]
        rows.append((jp(Counter(x), Counter(y)), *facts))
    names = [f"{p}{n} {kind}" for p in ("", "pivot_") for n, kind in (("own", "long"), ("weight", "long"), ("lone", "long"), ("lone_weight", "long"), ("marks", "array<long>"))]
    got = spark.createDataFrame(rows, ", ".join(["exact double", *names])).select("exact", (1 / least_inverse("", "pivot_")).alias("most")).collect()
    assert all(r.exact <= (r.most or 0) + 1e-9 for r in got) and sum((r.most or 0) < 0.8 for r in got) > 150


def test_a_group_of_many_rounds(spark):
    """Copies of one text with one to seven new words each: many of them are no links, and share buckets with all."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for k in rng.sample(range(150), 1 + i % 7):
            words[k] = f"n{i}-{k}"
        rows.append((i, " ".join(words)))
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string"), Near(pivots=2)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == classes(rows)


def test_short_and_repetitive_pairs_match_brute_force(spark):
    """J_P from 0.8 to 0.85 where one shingle, or few, fill most registers: no pair may fail the filter by their bits."""
    rows = []
    for i in range(300):
        n, x, few = 8 + i % 4, f"x{i}", [f"y{i}-{j}" for j in range(5)]
        run = [x] * (n + 4)
        twins = (
            (run, [*run, f"a{i}", f"b{i}"]),
            ([*run, f"a{i}"], [*run, f"b{i}"]),
            ([*few * 3, few[0]], [*few * 3, few[0], f"a{i}", *[f"b{i}"] * (i % 2)]),
        )[i % 3]
        rows += [(2 * i + k, " ".join(t)) for k, t in enumerate(twins)]
    exact = [jp(bag(rows[k][1]), bag(rows[k + 1][1])) for k in range(0, len(rows), 2)]
    assert all(0.8 - 1e-9 <= x <= 0.93 for x in exact) and sum(x <= 0.85 for x in exact) >= 200
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == classes(rows)


def test_labels(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 99), (99, 98), (200, 200), (301, 300), (300, 301)]
    got = {r.id: r.to for r in labels(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 98: 98, 99: 98, 100: 98, 300: 300, 301: 300}


def test_empty_table(spark):
    assert near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
