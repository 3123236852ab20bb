import math
import random
import re
from collections import Counter

from tailglass.llm.sparse_product import rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items, k, once):
    own = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    held = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            score = 0
            for term, times in Counter(TERM.findall((text or "").translate(LOWER))).items():
                if tf := c.get(term):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[term] + 1)))
                    m = 50 + 50 * sum(c.values()) * n_docs // n_terms
                    score += (1 if once else times) * w * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def texts(rng, n):
    words = ["Über", "über", "a1", "A1", "x", "don't", "e-mail", "naïve", " ", "日本", "b", "c", "\x00z", "q_r", "ſ", "K"]
    return [" ".join(rng.choices(words, k=rng.choice((0, 1, 3, 9, 40)))) for _ in range(n)]


def test_same_as_brute_force(spark):
    rng = random.Random(11)
    docs = list(enumerate(texts(rng, 300))) + [(None, "x b"), (7, None), (8, ""), (9, "x b"), (9, "x b"), (10, "\x1c ,.")]
    docs += [(1000, "long " * 400_000 + "x")]
    items = list(enumerate(texts(rng, 12))) + [(None, "x b x"), (3, None), (3, "日本 日本 x"), (3, "日本 日本 x"), (4, "")]
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id int, text string, score string, slot int, rank int").repartition(5)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, number int")
    for k, once, chars in ((50, True, 1 << 22), (3, False, 40)):
        got = Counter(map(tuple, rank_documents(frame, asked, k, once, chars).select("item_id", "rank", "doc_id", "score").collect()))
        assert got == brute(docs, items, k, once)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rank_documents(docs, items).count() == 0
    assert rank_documents(spark.createDataFrame([(1, "a"), (2, None)], docs.schema), items.limit(0)).count() == 0
    assert rank_documents(spark.createDataFrame([(1, None)], docs.schema), items).count() == 0
