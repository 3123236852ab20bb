import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tailglass.llm.common import stored
from tailglass.llm.cutting_stock import Packing, best_pattern, in_blocks, pack, solve
from tailglass.llm.tokens import VOCABULARY, Encoder

ODD = ["", None, " ", "It's <|endoftext|> we'LL", "İSTANBUL ΣΑΣ ǅ", "á ́x é", "日本語 テキスト", "1234 5.6", "x y z", "a\x1cb\x85c", "\x00 null", "don't'd", "ﬁ ½ Å", "😀😀 !!??", "﻿bom", "𝔘nicode"]


def test_ids_of_words_are_ids_of_texts(docs01):
    texts = ODD + [r.text for r in docs01.collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    offsets, ids = Encoder().encode(pa.array(texts), 2)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], text
    same = Encoder(by_word=False).encode(pa.array(texts), 2)
    assert (same[0] == offsets).all() and (same[1] == ids).all()


def test_knapsack():
    rng = random.Random(1)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(1, 12), 4), reverse=True))
        prices = np.array([rng.random() for _ in lengths])
        best = max(a * prices[0] + b * prices[1] + c * prices[2] + d * prices[3] for a in range(21) for b in range(21) for c in range(21) for d in range(21) if a * lengths[0] + b * lengths[1] + c * lengths[2] + d * lengths[3] <= 20)
        got = best_pattern(prices, lengths, 20)
        assert got @ lengths <= 20 and abs(got @ prices - best) < 1e-9


def test_plan_holds_the_demand_in_few_sequences():
    rng = np.random.default_rng(2)
    for scale in (1, 50, 5000):
        lengths = np.arange(1, 64)
        demand = rng.integers(0, scale + 1, 63)
        lengths, demand = lengths[demand > 0], demand[demand > 0]
        plan = solve(lengths, demand, 64)
        assert (sum(p * n for p, n in plan) == demand).all()
        assert all(p @ lengths <= 64 for p, _ in plan)
        assert sum(n for _, n in plan) <= np.ceil(lengths @ demand / 64) * 1.02 + 8


def test_every_id_is_in_one_place(spark, docs01):
    made = [(r.doc_id, r.text) for r in docs01.collect()] + [(None, None), (-1, ""), (-1, ""), (-2, "word " * 9000)] + [(-10 - i, "many copies of one text") for i in range(300)]
    frame = spark.createDataFrame([(k, t, 1) for k, t in made], "doc_id long, text string, rank int")
    rows = pack(frame).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    want = defaultdict(int)
    for k, t in made:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        for at, n in Packing().cuts(len(ids)):
            want[k, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)] += 1
    got, spans = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        spans[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for found in spans.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(spans) <= total / 4096 * 1.05 + 12


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 4095, 4096, 4097, 8192, 20000])
def test_cuts(n):
    cuts = list(Packing().cuts(n))
    assert sum(k for _, k in cuts) == n and [a for a, _ in cuts] == np.cumsum([0, *(k for _, k in cuts)])[:-1].tolist()


def test_repeated_row_is_spread(spark):
    """A third of all rows is one row: no block gets more than its share, and each pass deals alike."""
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "0L AS start", "9L AS length", "5L AS ids_crc32", "9L AS doc_tokens")
    dealt = in_blocks(stored(rows, "pieces"), 16)
    sizes = {r.block: r["count"] for r in dealt.groupBy("block").count().collect()}
    assert len(sizes) == 16 and max(sizes.values()) < 2 * 6000 / 16
    assert sizes == {r.block: r["count"] for r in dealt.repartition(3, "doc_id").groupBy("block").count().collect()}
