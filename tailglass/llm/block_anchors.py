"""Substring dedup by fixed-block anchors: cut every word that a repeated window of words covers.

Let L be the window (35 words) and B = (L + 1) // 2 (18).  Any window of L words holds at least one whole
block of the grid 0..B, B..2B, ... of its document.  So if a window occurs twice, a grid block inside one
occurrence equals some rolling B-word window at the other, and likewise the other way round:

1. every document's grid blocks are the index and every rolling B-word window is a probe; both go to
   buckets of their hash, where a hash with a block and at least two places is an anchor;
2. only windows of L words around an anchor are candidates: they are extended from it to both sides and
   compared by 96-bit hashes, again in buckets.  The union of the windows found twice is the maximal repeat;
3. the words so covered are cut, judged on the input.

Documents are dealt to groups of a few MB, copies of one row among them.  A group sends each bucket one compressed, sorted list of its
distinct hashes and gets back those that matter, so a passage in a third of all documents costs one entry a
group and no key is hot.  No pairs of places are made.

Defined results: null or empty text has no words (hash of the empty string); rows with equal or null doc_id
are documents of their own; other columns are carried through by ``cut_repeats`` and not read by
``repeat_digest``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, lean, split_words, spread, stored, windows, word_hashes

WINDOW = 35
#: Bytes of text in a group, and groups whose words a bucket gets.
GROUP_BYTES, BUCKET_GROUPS, LEAST_GROUPS = 4 << 20, 2, 24
G, B = "_tg_group", "_tg_bucket"
SENT = f"{B} int, {G} int, keys binary, twice binary, blocks binary, checks binary"
BACK = f"{G} int, keys binary, checks binary"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def pack(keys: np.ndarray) -> bytes:
    """Sorted numbers: byte planes of their differences, compressed."""
    steps = np.diff(keys, prepend=U64(0))
    size = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :size].T)
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : data[0]] = planes.T
    return np.cumsum(steps.view(U64).ravel(), dtype=U64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


class Words:
    """The words of a group of documents as hashes."""

    def __init__(self, rows: pa.Table, seed: int = 0):
        texts = rows.column("text").combine_chunks()
        self.offsets, self.words = split_words(texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks))
        self.text = spread(self.offsets)
        self.hashes = word_hashes(self.words, seed)

    def starts(self, width: int) -> np.ndarray:
        """Whether a window of ``width`` words of one document starts at each place."""
        n = len(self.text)
        out = np.zeros(n, bool)
        if n >= width:
            out[: n - width + 1] = self.text[: n - width + 1] == self.text[width - 1 :]
        return out

    def on_grid(self, width: int) -> np.ndarray:
        return (np.arange(len(self.text)) - self.offsets[:-1][self.text]) % width == 0


def send(group: int, keys: np.ndarray, n_buckets: int, key_bits: int, grid: np.ndarray | None = None, checks: np.ndarray | None = None) -> pa.Table:
    """A row for each bucket: the distinct keys, which of them the group has twice, which have a block."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    blocks = np.add.reduceat(grid[order].astype(np.int64), first) > 0 if grid is not None and len(first) else np.zeros(len(first), bool)
    checks = checks[order][first] if checks is not None else None
    keys, twice = keys[first], counts > 1
    bucket = bucket_of(keys, n_buckets, key_bits)
    ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
    out: dict[str, list] = {x.split()[0]: [] for x in SENT.split(", ")}
    for b in np.flatnonzero(np.diff(ends)):
        part = slice(ends[b], ends[b + 1])
        for name, value in ((B, int(b)), (G, group), ("keys", pack(keys[part])), ("twice", bits(twice[part])), ("blocks", bits(blocks[part])), ("checks", b"" if checks is None else checks[part].tobytes())):
            out[name].append(value)
    return pa.table(out, schema=pa.schema([(B, pa.int32()), (G, pa.int32()), ("keys", pa.binary()), ("twice", pa.binary()), ("blocks", pa.binary()), ("checks", pa.binary())]))


def bucket_of(keys: np.ndarray, n_buckets: int, key_bits: int) -> np.ndarray:
    """Buckets in the order of the keys."""
    return ((keys >> U64(max(0, key_bits - 31))) * U64(n_buckets) >> U64(min(31, key_bits))).astype(np.int64)


def meet(sent: pa.Table, need_block: bool) -> pa.Table:
    """In one bucket: the keys with two places or more (and a block among them), returned to each group that has them."""
    groups = sent.column(G).to_numpy()
    lists = [unpack(x) for x in sent.column("keys").to_pylist()]
    sizes = np.array([len(x) for x in lists])
    flags = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(sent.column(name).to_pylist(), sizes, strict=True)])
    keys, twice, blocks = np.concatenate(lists), flags("twice"), flags("blocks")
    n_lists = len(lists)
    del lists
    checks = np.frombuffer(b"".join(sent.column("checks").to_pylist()), np.uint32)
    owner = np.repeat(np.arange(n_lists, dtype=np.int32), sizes)
    order = np.lexsort((checks, keys)) if len(checks) else np.argsort(keys, kind="stable")
    k = keys[order]
    new = k[1:] != k[:-1]
    if len(checks):
        new |= checks[order][1:] != checks[order][:-1]
    first = np.flatnonzero(np.concatenate([[True], new]))
    places = np.add.reduceat(1 + twice[order].astype(np.int64), first)
    hit = places > 1
    if need_block:
        hit &= np.add.reduceat(blocks[order].astype(np.int64), first) > 0
    chosen = np.sort(order[np.repeat(hit, np.diff(np.append(first, len(k))))])
    ends = np.searchsorted(owner[chosen], np.arange(n_lists + 1))
    has = np.flatnonzero(np.diff(ends))
    parts = [chosen[ends[i] : ends[i + 1]] for i in has]
    return pa.table(
        [pa.array(groups[has], pa.int32()), pa.array([pack(keys[p]) for p in parts], pa.binary()), pa.array([checks[p].tobytes() if len(checks) else b"" for p in parts], pa.binary())],
        schema=pa.schema([(G, pa.int32()), ("keys", pa.binary()), ("checks", pa.binary())]),
    )


def returned(back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A group's keys from all buckets, in order, and their checks."""
    if not back.num_rows:
        return np.zeros(0, U64), np.zeros(0, np.uint32)
    keys = np.concatenate([unpack(x) for x in back.column("keys").to_pylist()])
    checks = np.frombuffer(b"".join(back.column("checks").to_pylist()), np.uint32)
    order = np.argsort(keys, kind="stable")
    return keys[order], checks[order] if len(checks) else checks


def places_of(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each key is in the sorted ``among``, or -1."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)


class Plan:
    """Sizes that follow from the table: groups, buckets, and bits of an anchor's hash."""

    def __init__(self, n_bytes: int, window: int = WINDOW):
        self.window, self.block = window, (window + 1) // 2
        self.groups = max(LEAST_GROUPS, -(-n_bytes // GROUP_BYTES))
        self.buckets = max(LEAST_GROUPS, self.groups // BUCKET_GROUPS)
        #: One rolling window in 2,000 meets a strange block by chance; that costs work, never a wrong cut.
        self.key_bits = min(60, max(31, (n_bytes // (4 * self.block) + 1).bit_length() + 11))

    def anchor_keys(self, words: Words) -> np.ndarray:
        out = np.zeros(len(words.hashes), U64)
        found = windows(words.hashes, self.block)
        out[: len(found)] = found >> U64(64 - self.key_bits)
        return out

    def probe(self, key: tuple, rows: pa.Table) -> pa.Table:
        words = Words(rows)
        at = np.flatnonzero(words.starts(self.block))
        return send(key[0].as_py(), self.anchor_keys(words)[at], self.buckets, self.key_bits, words.on_grid(self.block)[at])

    def candidates(self, words: Words, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor."""
        hits = np.flatnonzero(words.starts(self.block))
        hits = hits[places_of(self.anchor_keys(words)[hits], anchors) >= 0]
        n = len(words.hashes)
        ends = np.zeros(n + 1, np.int64)
        np.add.at(ends, np.maximum(hits - (self.window - self.block), 0), 1)
        np.add.at(ends, hits + 1, -1)
        return np.flatnonzero((np.cumsum(ends)[:n] > 0) & words.starts(self.window))

    def window_keys(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return np.zeros(0, U64), np.zeros(0, np.uint32)
        with np.errstate(over="ignore"):
            check = windows(words.hashes * U64(0xD1342543DE82EF95), self.window, 0xAEF17502108EF2D9)[at]
        return windows(words.hashes, self.window)[at], (check >> U64(32)).astype(np.uint32)

    def extend(self, key: tuple, rows: pa.Table, back: pa.Table) -> pa.Table:
        words = Words(rows)
        keys, checks = self.window_keys(words, self.candidates(words, returned(back)[0]))
        return send(key[0].as_py(), keys, self.buckets, 64, None, checks)

    def covered(self, words: Words, back: pa.Table) -> np.ndarray:
        """Whether each word is to be cut."""
        keys, checks = returned(back)
        n = len(words.hashes)
        if not len(keys):
            return np.zeros(n, bool)
        at = np.flatnonzero(words.starts(self.window))
        own, check = self.window_keys(words, at)
        place = places_of(own, keys)
        at = at[(place >= 0) & (checks[place] == check)]
        ends = np.zeros(n + 1, np.int64)
        np.add.at(ends, at, 1)
        np.add.at(ends, at + self.window, -1)
        return np.cumsum(ends)[:n] > 0


def digest(words: Words, cut: np.ndarray, rows: pa.Table) -> pa.Table:
    kept = np.concatenate([[0], np.cumsum(~cut)])[words.offsets]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.words.filter(pa.array(~cut)).cast(pa.string())), " ")
    n = np.diff(words.offsets)
    hashes = [hashlib.sha256(x).hexdigest() for x in joined.cast(pa.binary()).to_pylist()]
    return pa.table([rows.column("doc_id"), pa.array(n), pa.array(n - np.diff(kept)), pa.array(hashes)], names=[x.split()[0] for x in DIGEST.split(", ")])


def without(words: Words, cut: np.ndarray, rows: pa.Table) -> pa.Table:
    """The rows with the cut words, and the white space after each, taken out of the text."""
    lost = np.add.reduceat(np.append(cut, False).astype(np.int64), words.offsets[:-1]) * (np.diff(words.offsets) > 0) if len(words.offsets) > 1 else []
    texts = rows.column("text").to_pylist()
    for i in np.flatnonzero(lost):
        own = cut[words.offsets[i] : words.offsets[i + 1]]
        lead = texts[i][: len(texts[i]) - len(texts[i].lstrip(" \t\n\x0b\x0c\r"))]
        texts[i] = lead + "".join(m[0] for m, gone in zip(WORD.finditer(texts[i]), own, strict=True) if not gone)
    return rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, rows.schema.field("text").type))


def deal(docs: DataFrame) -> DataFrame:
    """Rows with a number from doc_id, text and their place, so copies of one row go to many groups.

    The table is written with its numbers once: a place in an input that is read again, in other splits or from a
    shuffle, may be another, and all passes must deal a row alike."""
    return stored(docs.withColumn(G, F.xxhash64("doc_id", "text", F.monotonically_increasing_id())), "dealt")


def find_repeats(docs: DataFrame, finish: Callable[[Words, np.ndarray, pa.Table], pa.Table], schema, window: int = WINDOW) -> DataFrame:
    """Run the three passes; ``finish`` makes the result of each group from its words, the cuts and its rows."""
    dealt = deal(docs)
    n_bytes = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(n_bytes, window)
    dealt = dealt.withColumn(G, F.pmod(G, F.lit(plan.groups)).cast("int"))
    sent = dealt.groupBy(G).applyInArrow(lean(lambda key, rows: plan.probe(key, rows)), SENT)
    back = sent.groupBy(B).applyInArrow(lean(lambda rows: meet(rows, True)), BACK)
    sent = dealt.groupBy(G).cogroup(back.groupBy(G)).applyInArrow(lean(lambda key, rows, hits: plan.extend(key, rows, hits)), SENT)
    back = sent.groupBy(B).applyInArrow(lean(lambda rows: meet(rows, False)), BACK)

    def last(rows: pa.Table, hits: pa.Table) -> pa.Table:
        words = Words(rows)
        return finish(words, plan.covered(words, hits), rows.drop_columns([G]))

    return dealt.groupBy(G).cogroup(back.groupBy(G)).applyInArrow(lean(last), schema)


def repeat_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each document: its words, how many are cut, and the SHA-256 of those kept, joined by one space."""
    return find_repeats(docs.select(F.col("doc_id").cast("long"), "text"), digest, DIGEST, window)


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with all its columns, without the words that repeated windows cover; ``n_chars`` follows if it is there."""
    out = find_repeats(docs, without, docs.schema, window)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
