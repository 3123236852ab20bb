import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer


from tailglass.llm.tokens import VOCABULARY
from tailglass.llm.wavelet import WaveletMatrix, build, token_files, write_tokens


@pytest.mark.parametrize("n,high", [(0, 1), (1, 1), (1, 5), (500, 2), (3000, 49408), (140_000, 300), (1000, 1 << 20)])
def test_matrix(n, high):
    rng = np.random.default_rng(n)
    tokens = rng.integers(0, high, n).astype(np.uint32)
    m = WaveletMatrix(build(tokens, np.array([4]), np.array([False]), np.array([n])))
    assert (m.tokens() == tokens).all() and len(m.tokens()) == n
    for i in rng.integers(0, n, 20) if n else []:
        assert m.access(int(i)) == tokens[i]
    for t in {*tokens[:10].tolist(), 0, high, high - 1, -1, 1 << 30}:
        where = np.flatnonzero(tokens == t)
        assert m.count(t) == len(where)
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(t, a, b) == ((where >= a) & (where < b)).sum()
        for k in {0, len(where) // 2, len(where) - 1} if len(where) else []:
            assert m.occurrence(t, k) == where[k]
        with pytest.raises(IndexError):
            m.occurrence(t, len(where))
    with pytest.raises(IndexError):
        m.access(n)


def test_documents_round_trip(spark, docs01):
    made = [(r.doc_id, r.text) for r in docs01.collect()] + [(None, None), (None, "b"), (-1, ""), (-1, "again"), (99999, "word " * 30000)]
    made = made[::-1]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    want, at = [], 0
    for k, t in sorted(made, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    frame = spark.createDataFrame([(k, t, 0, 0) for k, t in made], "doc_id long, text string, start int, shard int")
    assert sorted(map(tuple, token_files(frame).collect()), key=lambda r: r[1]) == want


def test_empty_table(spark):
    assert token_files(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_row_is_spread(spark, tmp_path):
    """One row that is half of the table fills shards of the usual size, and its copies follow each other."""
    made = [(7, "the same row again")] * 4000 + [(i, f"row {i} of its own") for i in range(4000)]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    shards = write_tokens(frame, f"file://{tmp_path}/files", shard_bytes=sum(len(t) for _, t in made) // 8)
    assert max(n for _, n in shards) < sum(n for _, n in shards) / 4
    got = sorted(map(tuple, token_files(frame).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(k for k, _ in made)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))  # noqa: B905
