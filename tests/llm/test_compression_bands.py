import re
from collections import Counter

import pytest
import zstandard

from tailglass.llm.compression_bands import Limits, compression_bands, keep_good

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed


TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "a b c",
    "x y z w " * 12,
    "one two three four five six seven eight nine ten\n" * 5,
    "# * $ | < > & % \n\n\n \n #\n#\n",
    " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(20)),
    " ".join(f"é{i}ü" for i in range(30000)),
]


def test_counts_match_brute_force(spark, docs01):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)]
    made = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    for frame in (made, docs01):
        got = {r.doc_id: r for r in compression_bands(frame).collect()}
        want = {r.doc_id: brute(r.text) for r in frame.collect()}
        assert len(got) == len(want)
        for k, w in want.items():
            r = got[k]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == w, k
            assert not (r.kept and r.base_failed)


def test_bands(spark):
    import base64
    import random

    rng = random.Random(5)
    noise = base64.b64encode(rng.randbytes(6000)).decode()
    noisy = " ".join(noise[i : i + 40] for i in range(0, len(noise), 40))
    prose = " ".join("".join(rng.choice(["an", "re", "ti", "on", "the", "ing", "sh", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(800))
    loop = " ".join(f"{w} spam" for w in prose.split()[:3]) * 300
    made = spark.createDataFrame([(1, noisy), (2, prose), (3, loop), (None, prose), (2, prose)], "doc_id long, text string")
    got = [(r.doc_id, r.kept) for r in compression_bands(made).collect()]
    assert sorted(got, key=str) == sorted([(1, False), (2, True), (3, False), (None, True), (2, True)], key=str)
    assert sorted(str(r.doc_id) for r in keep_good(made).collect()) == ["2", "2", "None"]


def verdict(text, limits):
    """The rule by its definition; the compressor is the library's."""
    data = (text or "").encode()
    ratio = lambda x: len(zstandard.ZstdCompressor(level=limits.level).compress(x)) / len(x)
    bands = [b for b in limits.bands if b.least <= len(data)]
    if not bands:
        return True
    if not bands[-1].low <= ratio(data) <= bands[-1].high:
        return False
    size, n = limits.chunk_bytes, len(data)
    if 2 * n < size:
        return True
    covered, chunks = 0, []
    while covered < n:
        start = min(covered, max(0, n - size))
        chunks.append(ratio(data[start : start + size]))
        covered = start + size
    return sum(r < limits.chunk_low for r in chunks) <= limits.chunk_share * len(chunks) and sum(r > limits.chunk_high for r in chunks) <= limits.chunk_share * len(chunks)


def test_verdicts_match_brute_force(spark, docs01):
    """Whole tables, and texts of every length around the bands and chunks with a noisy or a repetitive end."""
    import base64
    import random

    rng, rows = random.Random(8), [(r.doc_id, r.text) for r in docs01.collect()]
    prose = " ".join("".join(rng.choice(["an", "re", "ti", "on", "the", "ing", "sh", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(4000))
    for n in (100, 255, 256, 511, 512, 1023, 1024, 1500, 2047, 2048, 2049, 3071, 4095, 4096, 4097, 9000, 16384, 20000):
        noise = base64.b64encode(rng.randbytes(n)).decode()
        rows += [(10_000 + len(rows) + k, t) for k, t in enumerate((prose[:n], prose[: n // 3] + " " + noise, "ab " * (n // 3), prose[: n // 2] + "=-" * (n // 4)))]
    for limits in (Limits(), Limits(chunk_share=0.0)):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r.doc_id, r.kept) for r in compression_bands(frame, limits).collect())
        want = sorted((k, not brute(t)[-1] and verdict(t, limits)) for k, t in rows)
        assert got == want
        assert sum(1 for _, k in want if not k) > 20


@pytest.mark.parametrize("columns", ["doc_id long, text string"])
def test_empty_table(spark, columns):
    assert compression_bands(spark.createDataFrame([], columns)).count() == 0
