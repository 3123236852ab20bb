import itertools
import random
import zlib

import numpy as np
import pytest

from tailglass.llm.script_viterbi import Languages, Words, language_spans, languages, train, viterbi


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(30):
        score = rng.normal(size=(6, 3)) * 3
        worth = lambda p: sum(score[i, j] for i, j in enumerate(p)) - 2.5 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(3), repeat=6), key=worth)
        assert abs(worth(viterbi(score, 2.5)) - worth(best)) < 1e-9


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    true = {r.doc_id: (r.lang, zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs.select("doc_id", "lang").collect()}
    got = languages(docs).collect()
    assert {r.doc_id: r.held_out for r in got} == {k: h for k, (_, h) in true.items()}
    test = [(r.lang_pred, true[r.doc_id][0]) for r in got if r.held_out]
    assert np.mean([a == b for a, b in test]) > 0.98 and len(test) > 200
    assert all(0 <= r.score <= 1 for r in got)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    words = {"aa": ["der", "schein", "keit", "über"], "bb": ["que", "tion", "les", "été"], "cc": ["при", "вет", "мир"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)] + [(500, "x y", None), (501, None, "aa"), (None, "der", "bb")]
    return train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_of_mixed_text(spark, model):
    text = "der schein keit " * 8 + "- 12 " + "que les tion été " * 9 + "при вет мир " * 7
    made = spark.createDataFrame([(1, text, "aa", 3), (2, "", "aa", 3), (3, None, "aa", 3)], "doc_id long, text string, lang string, start int")
    spans = [(r.doc_id, text[r.start : r.end], r.lang) for r in language_spans(made, model).collect()]
    assert spans == [(1, ("der schein keit " * 8).strip(), "aa"), (1, ("que les tion été " * 9).strip(), "bb"), (1, ("при вет мир " * 7).strip(), "cc")]
    # the shortcut for texts without a switch finds what the search finds
    rng = random.Random(3)
    texts = [" ".join(rng.choices("der schein que les tion мир".split(), k=rng.randrange(1, 40))) for _ in range(200)]
    words = Words(texts, model.how.bits)
    label, score = model.label(words)[0], model.scores(words).astype(float)
    ends = np.searchsorted(words.text, np.arange(201))
    for a, b in itertools.pairwise(ends):
        worth = lambda p: score[np.arange(a, b), p].sum() - model.how.penalty * (p[1:] != p[:-1]).sum()  # noqa: E731, B023
        assert abs(worth(label[a:b]) - worth(viterbi(score[a:b], model.how.penalty))) < 1e-6


def test_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "12 %$ \n"), (None, "que les"), (5, "日本"), (6, "DER Über"), (6, "мир")]
    made = spark.createDataFrame([(k, t, None) for k, t in rows], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in languages(made, model=model).collect()]
    assert got[:4] == [(1, "und"), (2, "und"), (3, "und"), (None, "bb")] and got[5:] == [(6, "aa"), (6, "cc")]
    assert got[4][1] in ("aa", "bb", "cc")
    assert {r.lang_pred for r in languages(made).collect()} == {"und"}
    assert languages(made.limit(0), Languages()).count() == 0


def test_repeated_rows_and_many_labels(spark):
    """A row that repeats is learned from once; every label is learned, with fewer buckets where there are many."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = [("der schein keit", "aa"), ("que les tion", "bb"), ("при вет мир", "cc"), ("x", "dd")]
    rows = [(i, *texts[0]) for i in ids[:1] * 300] + [(i, *texts[1]) for i in ids[1:3]] + [(ids[3], *texts[2]), (ids[4], *texts[3])]
    make = lambda r: train(spark.createDataFrame(r, "doc_id long, text string, lang string"), Languages(model_bytes=4 * 4 * 4 << 12))
    got, want = make(rows), make(rows[299:])
    assert got.languages == ["aa", "bb", "cc", "dd"] == sorted(want.languages) and got.how.bits == 12
    assert np.array_equal(got.table, want.table)
    made = spark.createDataFrame([(1, "schein der"), (2, "les tion"), (3, "мир")], "doc_id long, text string")
    assert [r.lang_pred for r in languages(made, model=got).collect()] == ["aa", "bb", "cc"]
    many = [(ids[i % len(ids)] + 4096 * i, f"{chr(0x430 + i % 31)}{chr(97 + i % 26)} {'abcdefghij'[i // 100]}{i:05d}z" + f" wort{'qrstuvwxyz'[i // 100]}{chr(97 + i // 26 % 26)}" * 3, f"l{i}") for i in range(150)]
    assert len(train(spark.createDataFrame(many, "doc_id long, text string, lang string"), Languages(model_bytes=1 << 22)).languages) == len({r[2] for r in many if zlib.crc32(str(r[0]).encode()) % 4 != 2}) > 100
