"""Token-id output as one wavelet matrix per shard.

Documents are ranged by doc_id into shards and sorted; each shard's ids become one file: bit-planes from the
highest bit down, each split into blocks that are compressed by themselves, with the ones before every block
as rank directory (select is a search in it).  A reader finds any token, counts a token up to any place and
finds its occurrences from that file, decompressing only the blocks it touches.

File: 8 bytes magic, 4 bytes length of the JSON header, header (sizes, planes, zeros of each plane, sections
and their places), then the sections: documents (ids, nulls, tokens), block places and ranks, blocks.

A task writes under a name of its own and then renames, so a repeated task leaves one whole file.

Defined results: null or empty text is the end id alone; null doc_ids stand first; equal doc_ids stand together, in
order of the first TIE_CHARS characters of their text, then of its hash; a row that repeats, however often, is spread
over as many shards as its bytes need; an empty table gives no file and an empty table.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, tidy
from .tokens import encoder

MAGIC = b"TGWVLT01"
BLOCK_BITS = 1 << 16
SHARD_BYTES = 8 << 20
#: Bytes of text to encode at once, and of words that a worker keeps: a shard's words are looked up together.
ENCODE_BYTES, CACHE_BYTES = 8 << 20, 64 << 20
#: What orders documents of one doc_id; ranges are sampled on the driver, so whole texts are no key.
TIE_CHARS = 32
SHARDS = "shard int, documents long, tokens long, path string"
DOCS = "doc_id long, local long, n_tokens long, ids_crc32 long, shard int"


class WaveletMatrix:
    """Read access to one file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(data[8:12], "little")
        self.head = json.loads(data[12 : 12 + size])
        self.body = memoryview(data)[12 + size :]
        self.n, self.planes, self.zeros = self.head["tokens"], self.head["planes"], self.head["zeros"]
        self.places = self._section("places", np.int64).reshape(self.planes, -1) if self.planes else np.zeros((0, 1), np.int64)
        self.ranks = self._section("ranks", np.int64).reshape(self.planes, -1) if self.planes else np.zeros((0, 1), np.int64)
        self.unpacked: dict[tuple[int, int], np.ndarray] = {}

    def _section(self, name: str, kind) -> np.ndarray:
        at, size = self.head["sections"][name]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.body[at : at + size]), kind)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, whether each is null, and numbers of tokens, in order."""
        return self._section("ids", np.int64), self._section("nulls", np.uint8).astype(bool), self._section("sizes", np.int64)

    def _block(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self.unpacked:
            at, end = self.places[plane, block : block + 2]
            raw = zstandard.ZstdDecompressor().decompress(self.body[at:end])
            self.unpacked[plane, block] = np.unpackbits(np.frombuffer(raw, np.uint8), count=min(BLOCK_BITS, self.n - block * BLOCK_BITS))
        return self.unpacked[plane, block]

    def _ones(self, plane: int, i: int) -> int:
        """Ones of the plane before place i."""
        block, rest = divmod(i, BLOCK_BITS)
        return int(self.ranks[plane, block]) + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, k: int, bit: int) -> int:
        """The place of the k-th (from 0) such bit of the plane."""
        before = self.ranks[plane] if bit else np.minimum(np.arange(self.ranks.shape[1]) * BLOCK_BITS, self.n) - self.ranks[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._block(plane, block) == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.planes):
            block, rest = divmod(i, BLOCK_BITS)
            bit = int(self._block(p, block)[rest])
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for p in range(self.planes):
            a, b = self._ones(p, start), self._ones(p, end)
            if token >> (self.planes - 1 - p) & 1:
                start, end = self.zeros[p] + a, self.zeros[p] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the token stands in places start to end."""
        end = self.n if end is None else end
        if token < 0 or token >> self.planes or start >= end:
            return 0
        a, b = self._range(token, start, end)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, i - self.zeros[p] if bit else i, bit)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes are undone from the lowest."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for p in range(self.planes - 1, -1, -1):
            raw = [zstandard.ZstdDecompressor().decompress(self.body[a:b]) for a, b in zip(self.places[p, :-1], self.places[p, 1:], strict=True)]
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8), count=self.n).view(bool)
            out[self.zeros[p] :] |= kind(1 << (self.planes - 1 - p))
            back, z = np.empty(self.n, kind), self.zeros[p]
            back[np.flatnonzero(~bits)] = out[:z]
            back[np.flatnonzero(bits)] = out[z:]
            out = back
        return out


def build(tokens: np.ndarray, ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bytes of a file."""
    pack = zstandard.ZstdCompressor(level=1).compress
    planes = int(tokens.max()).bit_length() if len(tokens) else 0
    now = tokens.astype(np.uint16 if planes <= 16 else np.uint32)
    body, places, ranks, zeros, at = [], [], [], [], 0
    for p in range(planes):
        bits = (now & now.dtype.type(1 << (planes - 1 - p))).astype(bool)
        packed = np.packbits(bits)
        own = [at]
        for k in range(0, len(packed), BLOCK_BITS // 8):
            body.append(pack(packed[k : k + BLOCK_BITS // 8].tobytes()))
            at += len(body[-1])
            own.append(at)
        places.append(own)
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK_BITS // 8), dtype=np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        zeros.append(int(len(bits) - ranks[-1][-1]))
        now = np.concatenate([np.compress(~bits, now), np.compress(bits, now)])
    sections = {}
    for name, value in (("ids", np.asarray(ids, np.int64)), ("nulls", np.asarray(nulls, np.uint8)), ("sizes", np.asarray(sizes, np.int64)), ("places", np.array(places, np.int64)), ("ranks", np.array(ranks, np.int64))):
        body.append(pack(value.tobytes()))
        sections[name] = (at, len(body[-1]))
        at += len(body[-1])
    head = json.dumps({"tokens": len(tokens), "planes": planes, "zeros": zeros, "sections": sections}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *body])


def write_shard(batches: Iterator[pa.RecordBatch], folder: str, end: int, vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    coder, tokens, sizes, ids = encoder(vocabulary, cache_bytes=CACHE_BYTES), [], [], []
    for batch in batches:
        for part in slices(batch, "text", ENCODE_BYTES):
            offsets, found = coder.encode(part.column("text"), end)
            tokens.append(found.astype(np.uint16) if not len(found) or found.max() < 1 << 16 else found)
            sizes.append(np.diff(offsets))
            ids += part.column("doc_id").to_pylist()
    if not ids:
        return
    shard = TaskContext.get().partitionId()
    every, sizes = np.concatenate(tokens), np.concatenate(sizes)
    data = build(every, np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids]), sizes)
    files, path = pafs.FileSystem.from_uri(folder)
    own, name = f"{path}/.{uuid.uuid4().hex}", f"{path}/shard-{shard:07d}.wvlt"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, name)
    yield pa.record_batch([[shard], [len(ids)], [len(every)], [name]], schema=pa.schema([("shard", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64()), ("path", pa.string())]))


def write_tokens(docs: DataFrame, folder: str, end: int = 1, vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int]]:
    """Write the shard files of a table (doc_id, text); returns each shard's number and tokens, in order."""
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(-(-n_bytes // shard_bytes), 1 << 20), docs.sparkSession.sparkContext.defaultParallelism)
    keys = {"_tg_tie": F.substring("text", 1, TIE_CHARS), "_tg_hash": F.xxhash64("text"), "_tg_row": F.monotonically_increasing_id()}
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumns(keys)
    shards = rows.repartitionByRange(n, "doc_id", *keys).sortWithinPartitions("doc_id", *keys)
    written = shards.select("doc_id", "text").mapInArrow(tidy(lambda batches: write_shard(batches, folder, end, vocabulary)), SHARDS)
    return sorted((r.shard, r.tokens) for r in written.select("shard", "tokens").collect())  # a row for each file


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: each document, its first place in its shard, its tokens and their checksum."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                matrix = WaveletMatrix(data.as_buffer().to_pybytes())
                ids, nulls, sizes = matrix.documents()
                tokens = matrix.tokens().astype(np.uint32)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                sums = [zlib.crc32(tokens[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                shard = int(path.rpartition("shard-")[2].partition(".")[0])
                yield pa.record_batch([pa.array(ids, pa.int64(), mask=nulls), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(np.full(len(ids), shard, np.int32))], names=[x.split()[0] for x in DOCS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvlt").load(folder).select("path", "content")
    return files.mapInArrow(tidy(step), DOCS)


def token_files(docs: DataFrame, folder: str | None = None, end: int = 1, vocabulary: str | None = None) -> DataFrame:
    """Write the files and read them back: doc_id, start among all ids, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "wavelet")
    before, firsts = 0, []
    for shard, tokens in write_tokens(docs, folder, end, vocabulary):
        firsts.append((shard, before))
        before += tokens
    starts = spark.createDataFrame(firsts, "shard int, before long")
    found = read_documents(spark, folder).join(F.broadcast(starts), "shard")  # a row for each file
    return found.select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
