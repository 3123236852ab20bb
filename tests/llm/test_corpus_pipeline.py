import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zlib
from test_block_anchors import WORD
from test_compression_bands import brute as base_counts
from test_prob_minhash import classes
from test_qgram_lemma import distance
from tokenizers import Tokenizer

import corpus_pipeline
from tailglass.llm.cutting_stock import Packing
from tailglass.llm.prob_minhash import one_of_each
from tailglass.llm.qgram_lemma import Lemma

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Prose, near copies, a shared passage, benchmark items, junk, nulls."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "re", "ti", "on", "the", "ing", "sh", "st", "lo", "ma"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, items = prose(60), [prose(25) for _ in range(3)]
    rows = [(i, prose(rng.randint(60, 400))) for i in range(30)]
    copied = rows[3][1]
    rows += [(100 + i, copied + f" {word()}") for i in range(4)] + [(200, copied), (200, copied), (None, copied), (2, rows[2][1])]
    rows += [(300 + i, f"{prose(80)}\n{shared}\n{prose(40)}") for i in range(5)]
    rows += [(400 + i, f"{prose(50)} {item.upper()} {prose(30)}") for i, item in enumerate(items)]
    rows += [(500, "spam spam " * 300), (501, ""), (502, None), (None, None), (503, "too short")]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(k, t, "en", None, None if t is None else len(t), 1) for k, t in rows], DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def brute_cut(rows, width=35):
    words = [WORD.findall(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        cut = {i + j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(width)}
        out.append((k, " ".join(x for i, x in enumerate(w) if i not in cut)))
    return out


def test_stages_match_brute_force(spark, folder):
    d, rows, items = folder
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert docs.columns == [x.split()[0] for x in DOCS.split(", ")]
        kept[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    # rules: what fails the base rule goes, and prose stays
    good = kept["quality_rules"]
    assert good == sorted(((k, t) for k, t in rows if not base_counts(t)[-1]), key=str)
    # near copies: the smallest doc_id of each class, once
    least = {k for k, c in classes(good) if k == c and k is not None}
    assert Counter(k for k, _ in kept["near_dedup"]) == Counter(least)
    squeezed = lambda pairs: sorted(((k, " ".join(WORD.findall(t))) for k, t in pairs), key=str)
    assert squeezed(kept["substring_dedup"]) == squeezed(brute_cut(kept["near_dedup"]))
    how, clean = Lemma(), []
    for k, t in kept["substring_dedup"]:
        plain = " ".join(t.lower().split())
        found = any(
            distance(item[s : s + how.window], plain) <= how.edits(min(len(item), how.window))
            for item in items
            for s in range(0, len(item) - how.window + 1, 8)
        )
        clean += [] if found else [(k, t)]
    assert kept["decontamination"] == clean and len(clean) >= 30


def test_run(spark, folder):
    d, rows, _ = folder
    pieces = corpus_pipeline.run(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], np.uint32)
        want.update((r.doc_id, at, zlib.crc32(ids[at : at + n].tobytes())) for at, n in Packing().cuts(len(ids)))
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in pieces) == want
    assert all(0 <= r.offset and r.offset + r.length <= 4096 for r in pieces)


def test_one_of_each_keeps_every_class(spark):
    rows = [(5, "a b c d e f"), (None, "a b c d e f"), (5, "another text of its own"), (5, "another text of its own"), (7, None), (8, ""), (None, "only a null id here"), (4, "a b  c d e f")]
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, comp int")
    got = sorted(((r.doc_id, r.text) for r in one_of_each(docs).collect()), key=str)
    assert got == sorted([(4, "a b  c d e f"), (5, "another text of its own"), (7, None), (8, ""), (None, "only a null id here")], key=str)


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[0])
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
