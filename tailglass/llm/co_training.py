"""Quality classifier by co-training: a view of the words and a view of the page's metadata teach each other.

The text view is logistic regression on hashed words, on what is left of words without letters and digits, and on
measures of content (symbols, digits, capitals, repetition, compression).  The metadata view is logistic regression
on source, language and measures of size and layout, and sees no content.  Measures are cut at quantiles of all
documents.  In each round either view scores every document without a label and labels those that it is surest of,
and the other learns them too.  At the end each view is calibrated on labelled rows that no round has seen, the two
logits are combined there, and every document is scored.

Two targets are learned in the same way: quality and toxicity.  A document is kept if it is rather good than
not and rather not toxic.

Bounds (parameters): at most ``labelled`` doc_ids with labels, chosen by a hash of doc_id, are learned from, and a
view teaches ``taught`` documents of each target in a round.  The features of these come to the driver, where the
models are fitted; those of one document are at most ``2 ** bits`` numbers.  The pool is all other documents.  Texts
are read whole, once; their features are written to the shared folder, and rounds and scores read those.

Defined results: null or empty text has no words, and the metadata decide; null doc_ids are scored and not
learned from; of several rows for one labelled doc_id, all scored, the one with the least hash of text, source and
language is learned from and counts for the quantiles; rows of equal text, source and language are one document of the
pool, taught once; of several label rows for one doc_id the largest values count, null labels are no labels; with no
label, or labels of one kind only, every score is the share of ones (0.5 without any); other columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, split_words, spread, stored, tidy

#: What is kept of each text; the hash is of text, source and language.
FACTS = "doc_id long, hash long, features binary, measures array<double>"
SUREST = "target int, view int, yes boolean, hash long, doc_id long, logit double"
RESULT = "doc_id long, score double, quality double, toxic double, quality_text double, quality_metadata double, kept boolean"
PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»¿¡“”„’‘…–—"
#: Measures of the metadata view, then those of the text view.
LAYOUT = ("bytes", "words", "lines", "word_length", "line_words")
CONTENT = ("symbols", "digits", "upper", "bars", "distinct", "top", "ratio")
MEASURES = LAYOUT + CONTENT
N_SOURCES, N_LANGS = 64, 32


@dataclass(frozen=True)
class CoTraining:
    bits: int = 18
    labelled: int = 8000
    #: Every fourth labelled row calibrates and is not learned from.
    held: int = 4
    rounds: int = 3
    #: Documents of the pool that a view may teach in a round, and how sure it must be; accuracy of the quantiles.
    taught: int = 400
    sure: float = 0.95
    accuracy: int = 10000
    least_documents: int = 4
    bins: int = 10
    steps: int = 60
    doubt: float = 1.5
    prior_text: float = 1.0
    prior_metadata: float = 1.0


def text_view(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features by text (text number, feature); words, distinct words and the commonest word's count by text."""
    offsets, words = split_words(texts)
    n = len(offsets) - 1
    coded = words.dictionary_encode()
    distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    low = pc.utf8_lower(distinct)
    core, rest = pc.utf8_trim(low, characters=PUNCTUATION), pc.utf8_slice_codeunits(pc.replace_substring_regex(low, r"[\p{L}\p{N}]", ""), 0, 3)

    def hashed(values: pa.Array, seed: int) -> np.ndarray:
        own = values.dictionary_encode()
        h = np.array([xxhash.xxh32_intdigest(x, seed) >> (32 - bits) if x else -1 for x in own.dictionary.to_pylist()], np.int64)
        return h[own.indices.to_numpy(zero_copy_only=False)] if len(own) else h

    text = spread(offsets)
    pair = text * max(1, len(distinct)) + codes
    pair, counts = np.unique(pair, return_counts=True)
    of, code = pair // max(1, len(distinct)), pair % max(1, len(distinct))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, counts)
    both = np.concatenate([hashed(core, 1)[code], hashed(rest, 2)[code]]) if len(distinct) else np.zeros(0, np.int64)
    of2 = np.concatenate([of, of])
    found = np.unique((of2 << bits | both)[both >= 0])
    return found >> bits, found & ((1 << bits) - 1), np.diff(offsets), np.bincount(of, minlength=n), top


def measured(part: pa.RecordBatch, words: np.ndarray, distinct: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Measures of each document, and the hashed source and language in the last two columns."""
    compressor, rows = zstandard.ZstdCompressor(level=1), []
    for text, source, lang, w, d, t in zip(part.column("text").to_pylist(), part.column("source").to_pylist(), part.column("lang").to_pylist(), words.tolist(), distinct.tolist(), top.tolist(), strict=True):
        text = text or ""
        data = text.encode()
        n, lines = len(data), text.count("\n") + 1
        kinds = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=5) if n else np.zeros(5)
        rows.append((
            np.log1p(n), np.log1p(w), np.log1p(lines), n / (w + 1), w / lines, kinds[1] / (n + 1), kinds[2] / (n + 1), kinds[3] / (n + 1), kinds[4] / (n + 1),
            d / (w + 1), t / (w + 1), len(compressor.compress(data)) / (n + 1) if n else 1.0,
            -1 if source is None else xxhash.xxh32_intdigest(source) % (N_SOURCES - 1), -1 if lang is None else xxhash.xxh32_intdigest(lang) % (N_LANGS - 1),
        ))
    return np.array(rows, float).reshape(len(rows), len(MEASURES) + 2)


#: Kind of each byte: 1 symbol, 2 digit, 3 upper case, 4 bar, 0 other.
KIND = np.array([4 if c == "|" else 1 if c in "#*$%&<>@^~{}[]\\=+_" else 2 if c.isdigit() else 3 if c.isupper() else 0 for c in map(chr, range(128))] + [0] * 128)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Sparse:
    """Logistic regression on sets of features, fitted by gradient steps of adapted size.

    A feature counts for as much as its log-odds between the labels exceed ``doubt`` standard errors: what tells
    nothing, or was seen too seldom to tell, stays out."""

    def __init__(self, size: int, prior: float, steps: int, doubt: float, least: int = 1):
        self.weights, self.bias, self.prior, self.steps, self.doubt, self.least = np.zeros(size), 0.0, prior, steps, doubt, least

    def logit(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(row, self.weights[feature], n)

    def fit(self, row: np.ndarray, feature: np.ndarray, y: np.ndarray) -> None:
        n, used = len(y), np.unique(feature)
        at = np.searchsorted(used, feature)
        ones, every = np.bincount(at, y[row], len(used)), np.bincount(at, minlength=len(used))
        odds = np.log((ones + 0.5) / (y.sum() + 1)) - np.log((every - ones + 0.5) / (n - y.sum() + 1))
        told = np.maximum(0, np.abs(odds) - self.doubt * np.sqrt(1 / (ones + 0.5) + 1 / (every - ones + 0.5)))
        some = (told > 0) & (every >= self.least)
        used, told, place = used[some], told[some], np.cumsum(some) - 1
        row, at = row[some[at]], place[at[some[at]]]
        w = np.zeros(len(used) + 1)
        w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
        mean, square = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, self.steps + 1):
            miss = y - sigmoid(w[-1] + np.bincount(row, (w[:-1] * told)[at], n))
            up = np.append(told * np.bincount(at, miss[row], len(used)) - self.prior * w[:-1], miss.sum())
            mean, square = 0.9 * mean + 0.1 * up, 0.99 * square + 0.01 * up**2
            w = w + 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        self.weights = np.zeros_like(self.weights)
        self.weights[used], self.bias = w[:-1] * told, w[-1]


def scale(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of y on the columns of x and a constant, by Newton's method with a slight prior."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
    return w


class Views:
    """Features by view of the documents that are learned from."""

    def __init__(self, cuts: np.ndarray, bits: int):
        self.cuts, self.bits, self.place = cuts, bits, {}
        self.lists: list[np.ndarray] = []
        self.measures: list[np.ndarray] = []

    def add(self, rows: list) -> None:
        """Documents, named by their hashes."""
        for r in rows:
            self.place.setdefault(r.hash, len(self.lists))
            self.lists.append(np.frombuffer(bytes(r.features), np.uint32))
            self.measures.append(np.array(r.measures))

    def _measures(self, chosen: np.ndarray) -> np.ndarray:
        return np.array([self.measures[i] for i in chosen]).reshape(len(chosen), len(MEASURES) + 2)

    def text(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.lists[i] for i in chosen]
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return with_content(row, np.concatenate([np.zeros(0, np.uint32), *lists]).astype(np.int64), self._measures(chosen), self.cuts, self.bits)

    def metadata(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return metadata_view(self._measures(chosen), self.cuts)


def quantiles(measures: np.ndarray, cuts: np.ndarray, columns: range, base: int) -> list[np.ndarray]:
    """By document one feature for each of the columns, by the quantile it falls in, numbered from ``base``."""
    bins = len(cuts) + 1
    return [np.searchsorted(cuts[:, j], measures[:, j], side="right") + base + i * bins for i, j in enumerate(columns)]


def with_content(row: np.ndarray, feature: np.ndarray, measures: np.ndarray, cuts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The text view: hashed features of words, and those of the measures of content after them."""
    numbers = quantiles(measures, cuts, range(len(LAYOUT), len(MEASURES)), 1 << bits)
    return np.concatenate([row, np.tile(np.arange(len(measures)), len(numbers))]), np.concatenate([feature, *numbers])


def metadata_view(measures: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of size and layout, source and language."""
    numbers = quantiles(measures, cuts, range(len(LAYOUT)), 0)
    base = len(LAYOUT) * (len(cuts) + 1)
    numbers += [measures[:, -2].astype(np.int64) + 1 + base, measures[:, -1].astype(np.int64) + 1 + base + N_SOURCES]
    return np.tile(np.arange(len(measures)), len(numbers)), np.concatenate(numbers)


class Target:
    """Both views' models of one label, their calibration and their combination."""

    def __init__(self, y: np.ndarray, use: np.ndarray, doc_ids: np.ndarray, hashes: np.ndarray, how: CoTraining):
        """y: label or NaN by document; use: those with a label, whose doc_ids and copies no view may label."""
        self.share = float(y[use].mean()) if len(use) else 0.5
        self.flat = not len(use) or not 0 < self.share < 1
        sizes = (1 << how.bits) + len(CONTENT) * how.bins, len(LAYOUT) * how.bins + N_SOURCES + N_LANGS
        self.models = [Sparse(n, prior, how.steps, how.doubt, how.least_documents) for n, prior in zip(sizes, (how.prior_text, how.prior_metadata), strict=True)]
        self.scales, self.mix = [np.array([1.0, 0.0])] * 2, np.array([0.5, 0.5, 0.0])
        self.rounds: list[tuple[int, int]] = []
        self.doc_ids, self.taken = np.unique(doc_ids[use]), np.unique(hashes[use])
        self.y, self.held = y, use[:: how.held]
        learn = np.setdiff1d(use, self.held)
        self.known = [dict(zip(learn.tolist(), y[learn].tolist(), strict=True)) for _ in self.models]

    def fit(self, views: Views) -> None:
        for model, labels, view in zip(self.models, self.known, (views.text, views.metadata), strict=True):
            ids = np.fromiter(labels, np.int64, len(labels))
            model.fit(*view(ids), np.fromiter(labels.values(), float, len(labels)))

    def quota(self, yes: bool, how: CoTraining) -> int:
        """Documents that a view may teach of one kind: in the labels' proportion."""
        return max(1, round(how.taught * (self.share if yes else 1 - self.share)))

    def teach(self, taught: list, views: Views) -> None:
        """What each view is sure of goes to the other."""
        for r in taught:
            self.known[1 - r.view][views.place[r.hash]] = float(r.yes)
        self.taken = np.union1d(self.taken, np.array([r.hash for r in taught], np.int64))
        self.rounds.append((len(self.known[0]), len(self.known[1])))

    def calibrate(self, views: Views) -> None:
        y = self.y[self.held]
        if len(y) >= 10 and 0 < y.mean() < 1:
            logits = [model.logit(*view(self.held), len(y)) for model, view in zip(self.models, (views.text, views.metadata), strict=True)]
            self.scales = [scale(x[:, None], y) for x in logits]
            self.mix = scale(np.column_stack([s[0] * x + s[1] for s, x in zip(self.scales, logits, strict=True)]), y)

    def scores(self, n: int, text: tuple[np.ndarray, np.ndarray], metadata: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """The combined score and each view's."""
        if self.flat:
            return [np.full(n, self.share)] * 3
        logits = [s[0] * model.logit(*x, n) + s[1] for model, s, x in zip(self.models, self.scales, (text, metadata), strict=True)]
        return [sigmoid(self.mix[0] * logits[0] + self.mix[1] * logits[1] + self.mix[2]), *map(sigmoid, logits)]


def examined(batches: Iterator[pa.RecordBatch], how: CoTraining) -> Iterator[pa.RecordBatch]:
    """FACTS of each row."""
    for batch in batches:
        for part in slices(batch, "text"):
            of, feature, *rest = text_view(part.column("text"), how.bits)
            ends = np.searchsorted(of, np.arange(part.num_rows + 1))
            lists = [feature[a:b].astype(np.uint32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([part.column("doc_id"), part.column("hash"), pa.array(lists, pa.binary()), pa.array(list(measured(part, *rest)), pa.list_(pa.float64()))], names=["doc_id", "hash", "features", "measures"])


def seen(part: pa.RecordBatch, cuts: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both views of rows of FACTS."""
    row = np.repeat(np.arange(part.num_rows), pc.binary_length(part.column("features")).to_numpy(zero_copy_only=False) // 4)
    feature = np.frombuffer(b"".join(part.column("features").to_pylist()), np.uint32).astype(np.int64)
    measures = part.column("measures").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(MEASURES) + 2)
    return [with_content(row, feature, measures, cuts, bits), metadata_view(measures, cuts)]


def first_of(rows: np.ndarray, limit: int) -> np.ndarray:
    """Of (hash, doc_id, logit), one row a hash, those of the largest logits by amount."""
    rows = rows[np.lexsort((rows["doc_id"], rows["hash"]))]
    rows = rows[np.concatenate([[True], rows["hash"][1:] != rows["hash"][:-1]])] if len(rows) else rows
    return rows[np.lexsort((rows["hash"], -np.abs(rows["logit"])))[:limit]]


def surest(facts: DataFrame, targets: list[Target], cuts: np.ndarray, how: CoTraining) -> list:
    """What each view is surest of among all documents of the pool: SUREST rows, at most the quotas of each target, view and kind.

    Each task keeps its own best; those are cut twice, first by shares of the hashes."""
    sent = facts.sparkSession.sparkContext.broadcast((targets, cuts))
    limit = np.log(how.sure / (1 - how.sure))
    kind = np.dtype([("hash", np.int64), ("doc_id", np.int64), ("logit", float)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets, cuts = sent.value
        best: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "features"):
                views = seen(part, cuts, how.bits)
                rows = np.zeros(part.num_rows, kind)
                rows["hash"], rows["doc_id"] = part.column("hash").to_numpy(), part.column("doc_id").to_numpy()
                for i, target in enumerate(targets):
                    if target.flat:
                        continue
                    free = ~np.isin(rows["doc_id"], target.doc_ids) & ~np.isin(rows["hash"], target.taken)
                    for j, (model, view) in enumerate(zip(target.models, views, strict=True)):
                        rows["logit"] = model.logit(*view, part.num_rows)
                        for yes in (False, True):
                            some = rows[free & (np.abs(rows["logit"]) >= limit) & ((rows["logit"] > 0) == yes)]
                            have = best.get((i, j, yes), np.zeros(0, kind))
                            best[i, j, yes] = first_of(np.concatenate([have, some]), target.quota(yes, how))
        for (i, j, yes), rows in best.items():
            n = len(rows)
            yield pa.record_batch([pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, j, np.int32)), pa.array([yes] * n, pa.bool_()), *(pa.array(rows[c].copy()) for c in kind.names)], names=[x.split()[0] for x in SUREST.split(", ")])

    by = "target", "view", "yes"
    found = facts.where("doc_id IS NOT NULL").mapInArrow(tidy(step), SUREST)
    found = found.groupBy(*by, "hash").agg(F.min("doc_id").alias("doc_id"), F.max("logit").alias("logit"))
    order = F.abs("logit").desc(), F.col("hash")
    for share in ([F.pmod("hash", F.lit(256))], []):
        found = found.withColumn("_tg_rank", F.row_number().over(Window.partitionBy(*by, *share).orderBy(*order))).where(F.col("_tg_rank") <= how.taught + 1)
    return [r for r in found.orderBy(*by, "_tg_rank").collect() if r["_tg_rank"] <= targets[r.target].quota(r.yes, how)]


def least_rows(facts: DataFrame, key: str, values: list[int]) -> list:
    """One row of FACTS, that of the least hash and doc_id, for each of some keys: a bounded list of keys is broadcast, not a table.

    Each task sends its least, so a hot key is not moved as a whole."""
    wanted = facts.sparkSession.createDataFrame([(k,) for k in values], "wanted long")
    rows = facts.where("doc_id IS NOT NULL").join(F.broadcast(wanted), F.col(key) == F.col("wanted"), "left_semi")
    rows = rows.groupBy(key).agg(F.min(F.struct("hash", "doc_id", "features", "measures")).alias("least")).select("least.*")
    return sorted(rows.collect(), key=lambda r: (r.doc_id, r.hash))


def quantile_cuts(facts: DataFrame, how: CoTraining) -> np.ndarray:
    """Quantiles of each measure over all documents, one row a doc_id."""
    one = facts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("hash", "measures")).alias("least"))
    at = np.linspace(0, 1, how.bins + 1)[1:-1].tolist()
    cuts = one.agg(*(F.percentile_approx(F.col("least.measures")[j], at, how.accuracy).alias(m) for j, m in enumerate(MEASURES))).first()
    return np.array([cuts[m] or [0.0] * len(at) for m in MEASURES], float).T


def train(facts: DataFrame, labels: DataFrame, how: CoTraining = CoTraining()) -> tuple[np.ndarray, Target, Target]:
    """The measures' quantiles, and the models of quality and toxicity."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("double").alias("q"), F.max("toxic").cast("double").alias("t"))
    truth = {r.doc_id: (r.q, r.t) for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.labelled).collect()}
    views = Views(quantile_cuts(facts, how), how.bits)
    found = least_rows(facts, "doc_id", list(truth))
    views.add(found)
    doc_ids, hashes, targets = np.array([r.doc_id for r in found], np.int64), np.array([r.hash for r in found], np.int64), []
    for j in range(2):
        y = np.array([np.nan if (v := truth[r.doc_id][j]) is None else float(v > 0) for r in found])
        targets.append(Target(y, np.flatnonzero(~np.isnan(y)), doc_ids, hashes, how))
    live = [t for t in targets if not t.flat]
    for turn in range(how.rounds + 1):
        for target in live:
            target.fit(views)
        if not live or turn == how.rounds:
            break
        taught = surest(facts, targets, views.cuts, how)
        if not taught:
            break
        views.add(least_rows(facts, "hash", sorted({r.hash for r in taught} - views.place.keys())))
        for i, target in enumerate(targets):
            if not target.flat:
                target.teach([r for r in taught if r.target == i], views)
    for target in live:
        target.calibrate(views)
    return views.cuts, *targets


def read_facts(docs: DataFrame, how: CoTraining = CoTraining()) -> DataFrame:
    """FACTS of every row, written once."""
    read = F.col("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *read).withColumn("hash", F.xxhash64("text", "source", "lang"))
    return stored(docs.mapInArrow(tidy(lambda b: examined(b, how)), FACTS), "facts")


def quality(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining()) -> DataFrame:
    """Scores of all documents."""
    facts = read_facts(docs, how)
    sent = facts.sparkSession.sparkContext.broadcast(train(facts, labels, how))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, good, toxic = sent.value
        for batch in batches:
            for part in slices(batch, "features"):
                n, views = part.num_rows, seen(part, cuts, how.bits)
                q, q_text, q_metadata = good.scores(n, *views)
                t = toxic.scores(n, *views)[0]
                kept = pa.array((q >= 0.5) & (t < 0.5) | ((q >= 0.5) & toxic.flat & (toxic.share == 0.5)))
                yield pa.record_batch([part.column("doc_id"), *map(pa.array, (q * (1 - t), q, t, q_text, q_metadata)), kept], names=[x.split()[0] for x in RESULT.split(", ")])

    return facts.mapInArrow(tidy(step), RESULT)
