"""Near-duplicates by ProbMinHash: weighted shingles, banding, exact verification, classes.

A text's shingles are its runs of five words (a shorter text is one shingle), weighted by how often they
occur.  Every shingle is a Poisson process whose rate is its weight and whose arrivals fall on random
registers; a register keeps the shingle that arrives first.  Two texts agree in a register with the
probability Jaccard similarity J_P of their weights.  Arrivals after a time by which all registers are surely
full cannot matter, so the processes end there; where a register is still empty the time is doubled.

Bands of seven registers deal the distinct texts into buckets.  What no other text of any bucket has is counted
for each text, and all else it has is marked in a bitmap, a bit for each shingle's hash.  A bit that only one of
two texts has stands for a shingle that only it has, so these facts bound the shares P and Q of two texts'
weights that they can have in common, and J_P <= PQ / (P + Q - PQ): pairs for which that is below the threshold
are no links, texts with too much of their own go, and those with least of their own are the first pivots.

Links are looked for bucket by bucket in rounds: a growing share of a bucket's texts are its pivots, texts of
other components are compared with them, first by that bound and by one bit a register (a filter that a pair at
the threshold fails once in 14,000), then exactly by J_P.  Links join components, and a bucket with one component
is done: what it could still show changes nothing.  The rounds go on until every bucket is done or all its texts
have been pivots, so no link of a bucket between components is lost.  Groups that links join never make all their
pairs; of copies with too many edits to be links the bound leaves few pairs, though each is weighed in its bucket.

Defined results: texts without words (null too) are in a class of their own; exact copies are one node from the
start; equal or null doc_ids are separate rows; class_id is the smallest doc_id of the class (null if it has
none); other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .block_anchors import BACK, SENT, B, G, meet, places_of, returned, send
from .common import U64, lean, mix, scratch, slices, split_words, spread, stored, tidy, windows, word_hashes

LONELY = "node binary, own long, weight long, lone long, lone_weight long, marks array<long>"
#: Bytes of shingles in a group, and levels that texts are ranked in by what is theirs alone.
GROUP_BYTES, LEVELS = 4 << 20, 16
#: Words of 64 bits in a text's bitmap: plenty for a few hundred shingles; the bits of long texts fill up and tell less.
MARKS = 16
#: Bytes of text for each file of shingles, about.
FILE_BYTES = 32 << 20
BASE = "doc_id long, tag long, node binary, bytes long, bands array<long>, sketch array<long>"


@dataclass(frozen=True)
class Near:
    width: int = 5
    threshold: float = 0.8
    bands: int = 36
    rows: int = 7
    #: A multiple of 64, bands * rows at least; one bit of each is the filter.
    registers: int = 256
    #: Bits that may differ: 4 standard deviations above the mean at the threshold.
    distance: int = 45
    #: Pivots of a bucket in the first round, and their growth from round to round.
    pivots: int = 1
    growth: int = 8


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: text number, hash, count; by text and hash."""
    offsets, words = split_words(texts)
    hashes, text = word_hashes(words), spread(offsets)
    found = windows(hashes, width)
    at = np.flatnonzero(text[: len(found)] == text[width - 1 :]) if len(found) else np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    whole = np.array([windows(hashes[offsets[i] : offsets[i + 1]], int(sizes[i]))[0] for i in short], U64)
    text, keys = np.concatenate([text[at], short]), np.concatenate([found[at], whole])
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.zeros(0, np.int64)
    return text[first], keys[first], np.diff(np.append(first, len(keys)))


def signatures(text: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash of ``n`` texts: an (n, m) array of shingle hashes, and which texts have any."""
    out = np.zeros((n, m), U64)
    total = np.bincount(text, weights, n)
    todo = total > 0
    limit = np.where(todo, m / np.where(todo, total, 1) * (np.log(m) + 4), 0)
    pending = np.flatnonzero(todo)
    while len(pending):
        row = np.full(n, -1)
        row[pending] = np.arange(len(pending))
        use = np.flatnonzero(row[text] >= 0)
        of, key, rate, until = row[text[use]], keys[use], weights[use].astype(float), limit[text[use]]
        earliest = np.full(len(pending) * m, np.inf)
        winner = np.zeros(len(pending) * m, U64)
        time, k = np.zeros(len(use)), 0
        while len(key):
            with np.errstate(over="ignore"):
                bits = mix(key + U64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)))
            # 44 bits for the waiting time, the others for the register
            time = time - np.log(((bits >> U64(20)).astype(float) + 0.5) / 2.0**44) / rate
            alive = time <= until
            of, key, rate, until, time, bits = of[alive], key[alive], rate[alive], until[alive], time[alive], bits[alive]
            place = of * m + ((bits & U64(0xFFFFF)) * U64(m) >> U64(20)).astype(np.int64)
            np.minimum.at(earliest, place, time)
            won = time == earliest[place]
            winner[place[won]] = key[won]
            k += 1
        full = np.isfinite(earliest.reshape(-1, m)).all(axis=1)
        out[pending[full]] = winner.reshape(-1, m)[full]
        pending = pending[~full]
        limit[pending] *= 2
    return out, todo


def nodes_of(texts: pa.Array) -> list[bytes]:
    """The exact texts' names: 128 bits of hash, so that no two texts of any corpus share one."""
    return [xxhash.xxh3_128_digest((t or "").encode(), 77) for t in texts.to_pylist()]


def base_rows(part: pa.RecordBatch, how: Near) -> pa.RecordBatch:
    texts, n = part.column("text"), part.num_rows
    signature, has = signatures(*shingles(texts, how.width), n, how.registers)
    with np.errstate(over="ignore"):
        odd = mix(np.arange(1, how.rows + 1, dtype=U64)) | U64(1)
        rows = mix(signature[:, : how.bands * how.rows]).reshape(n, how.bands, how.rows)
        bands = mix((rows * odd).sum(axis=2, dtype=U64) + mix(np.arange(7, how.bands + 7, dtype=U64)))
    # a bit of the shingle and the register: one shingle that fills many registers has independent bits there
    bits = np.packbits((mix(signature ^ mix(np.arange(how.registers, dtype=U64))) & U64(1)).astype(np.uint8), axis=1).view(np.int64)

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * values.shape[1]), pa.array(values.astype(np.int64).ravel()))

    nodes = pa.array([x if y else None for x, y in zip(nodes_of(texts), has.tolist(), strict=True)], pa.binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
    return pa.record_batch([part.column("doc_id"), part.column("tag"), nodes, sizes, lists(bands.view(np.int64)), lists(bits)], names=["doc_id", "tag", "node", "bytes", "bands", "sketch"])


def packed_rows(part: pa.RecordBatch, how: Near) -> pa.RecordBatch:
    """Each text's node with its shingles and counts, compressed."""
    texts = part.column("text")
    text, keys, counts = shingles(texts, how.width)
    ends = np.searchsorted(text, np.arange(part.num_rows + 1))
    pack = zstandard.ZstdCompressor(level=1).compress
    sets = [keys[a:b].tobytes() + pack(counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    sizes = np.diff(ends)
    return pa.record_batch([pa.array(nodes_of(texts), pa.binary()), pa.array(sizes), pa.array(sets, pa.binary())], names=["node", "size", "shingles"])


def opened(size: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and counts out of what ``packed_rows`` made."""
    return np.frombuffer(data, U64, size), np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 * size :]), np.uint32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets: the sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    common_a, common_b = order[same], order[same + 1] - len(a[0])
    x, y = a[1][common_a].astype(float), b[1][common_b].astype(float)
    only = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratios, of = np.unique(x / y, return_inverse=True)
    totals = np.array([only[0] + r * only[1] + np.maximum(x, r * y).sum() for r in ratios])
    return float((x / totals[of]).sum()) if len(same) else 0.0


def compare(pairs: pa.Table, pivots: pa.Table, threshold: float) -> pa.Table:
    """The pairs (node, pivot) that are similar enough; node's set is in ``pairs``, pivot's in ``pivots``."""
    sets = {k: opened(n, data) for k, n, data in zip(*(pivots.column(x).to_pylist() for x in ("the_pivot", "pivot_size", "pivot_shingles")), strict=True)}
    good = [
        (u, v)
        for u, v, n, data in zip(*(pairs.column(x).to_pylist() for x in ("node", "pivot", "size", "shingles")), strict=True)
        if v in sets and similarity(opened(n, data), sets[v]) >= threshold - 1e-12
    ]
    return pa.table([pa.array([u for u, _ in good], pa.binary()), pa.array([v for _, v in good], pa.binary())], names=["node", "pivot"])


def marks_of(keys: np.ndarray) -> list[int]:
    """A bit for each key, by its hash."""
    bits = np.zeros(64 * MARKS, np.uint8)
    bits[(mix(keys) % U64(64 * MARKS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


class Sets:
    """The shingles of the texts that share a bucket, in a table bucketed by node: joins on node don't move it."""

    def __init__(self, docs: DataFrame, wanted: DataFrame, how: Near):
        spark, self.how = docs.sparkSession, how
        n_bytes = wanted.agg(F.sum("bytes")).first()[0] or 0
        self.name, self.parts = f"tg_sets_{uuid.uuid4().hex}", max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // FILE_BYTES))
        one = docs.join(wanted.withColumnRenamed("doc_id", "wanted_id").select("wanted_id").distinct(), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    yield packed_rows(part, how)

        rows = one.select("text").mapInArrow(tidy(step), "node binary, size long, shingles binary").repartition(self.parts, "node")
        rows = rows.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
        rows.write.option("path", scratch(spark, "sets")).bucketBy(self.parts, "node").sortBy("node").saveAsTable(self.name)
        self.spark = spark

    def facts(self) -> DataFrame:
        """For each node its distinct shingles, their weight, number and weight of those that no other has, and a bitmap of the others."""
        rows = self.spark.table(self.name)
        groups = max(self.parts, -(-(rows.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0) // GROUP_BYTES))
        dealt = rows.withColumn(G, F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int"))

        def sets_of(part: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
            return [opened(n, data) for n, data in zip(part.column("size").to_pylist(), part.column("shingles").to_pylist(), strict=True)]

        def count(part: pa.Table, back: pa.Table) -> pa.Table:
            common, found = returned(back)[0], []
            for keys, counts in sets_of(part):
                own = places_of(keys, common) < 0
                found.append((len(keys), int(counts.sum()), int(own.sum()), int(counts[own].sum()), marks_of(keys[~own])))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            return pa.table([part.column("node"), *(pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds))], names=[x.split()[0] for x in LONELY.split(", ")])

        sent = dealt.groupBy(G).applyInArrow(lean(lambda key, part: send(key[0].as_py(), np.concatenate([k for k, _ in sets_of(part)]), groups, 64)), SENT)
        back = sent.groupBy(B).applyInArrow(lean(lambda part: meet(part, False)), BACK)
        return dealt.groupBy(G).cogroup(back.groupBy(G)).applyInArrow(lean(count), LONELY)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (node, pivot) with a similarity at or above the threshold."""
        how, chunk = self.how, 256
        sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / chunk).cast("int").alias("salts"))
        salted = pairs.join(sizes, "pivot").withColumn("salt", F.pmod(F.hash("node"), F.col("salts")))
        n_chunks = max(self.parts, pairs.count() // 4096)
        group = F.pmod(F.hash("pivot", "salt"), F.lit(n_chunks)).alias("chunk")
        left = salted.select("node", "pivot", group).join(self.spark.table(self.name), "node")
        right = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("pivot", group).distinct()
        right = right.join(self.spark.table(self.name).select(F.col("node").alias("pivot"), F.col("size").alias("pivot_size"), F.col("shingles").alias("pivot_shingles")), "pivot")
        right = right.withColumnRenamed("chunk", "pivot_chunk").withColumnRenamed("pivot", "the_pivot")
        return left.groupBy("chunk").cogroup(right.groupBy("pivot_chunk")).applyInArrow(lean(lambda a, b: compare(a, b, how.threshold)), "node binary, pivot binary")


def labels(links: DataFrame) -> DataFrame:
    """Connected components of (a, b): each a or b with the least of its component as ``to``.

    Each step hooks a label to the least label it meets and then lets labels jump, so paths halve."""
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now = stored(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("to", F.col("id")), "labels")
    left = links
    while not left.isEmpty():
        hook = left.groupBy("a").agg(F.min("b").alias("up"))
        hook = stored(hook, "hooks")
        while True:  # jump to the end of each path of hooks
            above = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jumped = hook.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("more"))
            jumped = stored(jumped, "hooks")
            hook = jumped.drop("more")
            if jumped.where("more").isEmpty():
                break
        moved = hook.select(F.col("a").alias("to"), F.col("up").alias("new"))
        now = stored(now.join(moved, "to", "left").select("id", F.coalesce("new", "to").alias("to")), "labels")
        x, y = hook.select("a", F.col("up").alias("ua")), hook.select(F.col("a").alias("b"), F.col("up").alias("ub"))
        left = left.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b"))
        left = stored(left.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    return now


def far_apart(a: str, b: str, words: int) -> Column:
    """Bits in which two sketches differ."""
    return F.expr(" + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(words)))


def least_inverse(a: str, b: str) -> Column:
    """1 / J_P of two texts is at least this, by their facts; a and b: prefixes of the columns of LONELY.

    As 1 / J_P >= 1 / P + 1 / Q - 1; null if one of the shares is none."""
    both = f"least({a}own - {a}lone, {b}own - {b}lone)"

    def inverse(p: str, q: str) -> str:
        # the marks that q lacks are of shingles that it lacks; what is neither lone nor lacking may be common
        only = " + ".join(f"bit_count({p}marks[{i}] & ~{q}marks[{i}])" for i in range(MARKS))
        # a shingle counts once, and what repeats within a text may all be of common ones
        return f"try_divide({p}weight, least({p}weight - {p}lone_weight - ({only}), {both} + {p}weight - {p}own))"

    return F.expr(f"{inverse(a, b)} + {inverse(b, a)} - 1")


def by_turn(members: DataFrame, facts: DataFrame, how: Near) -> DataFrame:
    """Members of buckets that may have links, with their facts and turns: those with least of their own come first."""
    rows = members.join(facts, "node").where(F.col("lone_weight") <= (1 - how.threshold + 1e-9) * F.col("weight"))
    rows = rows.withColumn("level", F.floor(F.col("lone_weight") / F.col("weight") / (1 - how.threshold + 1e-9) * LEVELS))
    levels = rows.groupBy("bucket", "level").agg(F.count("*").alias("here"))
    up_to = Window.partitionBy("bucket").orderBy("level")  # LEVELS + 1 rows a bucket at most
    levels = levels.withColumns({"ahead": F.sum("here").over(up_to) - F.col("here"), "n": F.sum("here").over(Window.partitionBy("bucket"))}).where("n > 1")
    return rows.join(levels, ["bucket", "level"]).withColumn("turn", F.col("ahead") + share("node") * F.col("here")).drop("level", "here", "ahead")


def share(node: str) -> Column:
    """A place in [0, 1) that a text has in all its buckets, so that those of one group have the same pivots."""
    return F.pmod(F.xxhash64(node), F.lit(1 << 40)) / F.lit(float(1 << 40))


def grouped(docs: DataFrame, how: Near) -> tuple[DataFrame, DataFrame]:
    """For each row of ``docs`` its doc_id, the JVM's hash of its text (tag) and its node; and each node's component."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tag"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield base_rows(part, how)

    base = stored(docs.mapInArrow(tidy(step), BASE), "signatures")
    nodes = base.where("node IS NOT NULL").dropDuplicates(["node"])
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stored(rows.join(shared, "bucket").select("bucket", "node"), "members")
    inside = members.select("node").distinct()
    comps = stored(nodes.join(inside, "node", "left_semi").select("node", F.col("node").alias("comp"), "sketch"), "comps")
    wanted = stored(base.join(inside, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bytes").alias("bytes")), "wanted")
    sets = Sets(docs, wanted, how)
    try:
        comps = joined(members, comps, sets, how)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {sets.name}")
    return base.select("doc_id", "tag", "node"), comps.select("node", "comp")


def joined(members: DataFrame, comps: DataFrame, sets: Sets, how: Near) -> DataFrame:
    """``comps`` after all links between the members of each bucket."""
    members = stored(by_turn(members, stored(sets.facts(), "facts"), how), "members")
    before, now = 0, how.pivots
    while True:
        current = members.join(comps, "node")
        open_ = current.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        # a bucket all of whose texts have been pivots has nothing left to show
        members = stored(current.where(F.col("n") > before).join(open_, "bucket", "left_semi").drop("comp", "sketch"), "members")
        if members.isEmpty():
            return comps
        current = members.join(comps, "node")
        mark = {"node": "pivot", "comp": "other", "sketch": "mark"} | {x: f"pivot_{x}" for x in ("own", "weight", "lone", "lone_weight", "marks")}
        pivots = current.where((F.col("turn") >= before) & (F.col("turn") < now)).select("bucket", *(F.col(x).alias(y) for x, y in mark.items()))
        close = (F.col("comp") != F.col("other")) & (far_apart("sketch", "mark", how.registers // 64) <= how.distance) & (least_inverse("", "pivot_") <= 1 / how.threshold + 1e-9)
        pairs = current.join(pivots, "bucket").where(close)
        # either may be the pivot of the pair; the one with the smaller name is, so that a pair is verified once
        pairs = stored(pairs.select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("pivot")).distinct(), "pairs")
        links = sets.verified(pairs)
        own, other = comps.select("node", F.col("comp").alias("a")), comps.select(F.col("node").alias("pivot"), F.col("comp").alias("b"))
        moved = labels(links.join(own, "node").join(other, "pivot").select("a", "b"))
        comps = stored(comps.join(moved.withColumnsRenamed({"id": "comp", "to": "new"}), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"), "sketch"), "comps")
        before, now = now, now * how.growth


def near_classes(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """doc_id, class_id, class_size for each row of ``docs``."""
    base, comps = grouped(docs, how)
    node_class = base.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    node_class = node_class.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = node_class.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    by_node = node_class.select("node", "comp").join(sizes, "comp").select("node", "class_id", "class_size")
    return base.select("doc_id", "node").join(by_node, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )


def one_of_each(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """One document of each class, with all its columns: that of the smallest doc_id (a null comes last).

    Rows that repeat both doc_id and text are one document; texts without words all stay."""
    base, comps = grouped(docs, how)
    own = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_tg_own")
    first = F.min(F.struct(F.col("doc_id").isNull(), own, F.col("tag").alias("_tg_tag"))).alias("first")
    chosen = base.where("node IS NOT NULL").join(comps, "node", "left").groupBy(F.coalesce("comp", "node")).agg(first).select("first._tg_own", "first._tg_tag")
    chosen = chosen.union(base.where("node IS NULL").select(own, "tag").distinct())
    keyed = docs.withColumns({"_tg_own": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_tg_tag": F.xxhash64("text")})
    return keyed.join(chosen, ["_tg_own", "_tg_tag"], "left_semi").dropDuplicates(["_tg_own", "_tg_tag"]).select(*docs.columns)
