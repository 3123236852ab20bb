"""Language identification: script ranges narrow the languages, Viterbi with a switching penalty labels spans.

A word is a run of letters.  Its script says which languages are possible (those that used the script in
training); each of these scores it by hashed character n-grams of one to four letters, word ends included
(naive Bayes).  A path of labels over a text's words is worth its scores less a penalty for each switch; the
best path gives spans, and the language with most letters is the text's.

Most texts need no path search: if for the language with the best sum no other gains more than the penalty
over any run of words, no switch pays, which a running minimum of the sums shows for all texts at once.

Training counts n-grams of a sample: about ``per_language`` texts of each language, chosen by a hash of doc_id and text,
a repeated row once.  That bound is all that is sampled; every text is labelled whole.  Every language that a label names
can be predicted: with very many of them each has fewer buckets, so that the model keeps its size.

Defined results: a null or empty text, or one without letters, is ``und`` with score 0; letters of a script
that no language used say nothing; without labelled texts everything is ``und``; null or equal doc_ids are
rows of their own; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, slices, tidy

RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
SPANS = "doc_id long, start long, end long, lang string"
#: First and last code points of scripts' main blocks (fixed values, Unicode).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2A6DF),
)
NAMES = ("other", *dict.fromkeys(name for name, *_ in SCRIPTS))
GRAMS = 4
MARK = 1


@dataclass(frozen=True)
class Languages:
    per_language: int = 2000
    #: Buckets of n-grams are 2 ** bits, or fewer where so many languages would pass ``model_bytes``: no language is left out.
    bits: int = 17
    model_bytes: int = 210_000_000
    penalty: float = 8.0
    smoothing: float = 0.5
    #: A language is possible for a script that has at least this share of its letters.
    least_share: float = 0.01


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, its script's number, its lower case (itself if that is longer)."""
    size = 0x110000
    letter = np.fromiter((chr(i).isalpha() for i in range(size)), bool, size)
    script = np.zeros(size, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    lower = np.arange(size, dtype=np.uint32)
    for i in np.flatnonzero(letter[:0x20000]).tolist():
        if len(low := chr(i).lower()) == 1:
            lower[i] = ord(low)
    return letter, script, lower


class Words:
    """The words of some texts: n-grams by place, and where each word and text begins."""

    def __init__(self, texts: list[str | None], bits: int):
        letter, script, lower = characters()
        parts = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        gap = np.zeros(1, np.uint32)
        codes = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
        base = np.cumsum([1, *(len(p) + 1 for p in parts)])
        is_letter = letter[codes]
        edges = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1
        self.first, self.last = edges[::2], edges[1::2]
        self.text = np.searchsorted(base, self.first, side="right") - 1
        self.start, self.end = self.first - base[self.text], self.last - base[self.text]
        self.letters = self.last - self.first
        self.script = script[codes[self.first]]
        # each word with a mark before and after
        n = len(self.first)
        self.begin = np.concatenate([[0], np.cumsum(self.letters + 2)])
        self.chars = np.full(self.begin[-1], MARK, np.uint32)
        inside = np.ones(len(self.chars), bool)
        inside[self.begin[:-1]] = False
        inside[self.begin[1:] - 1] = False
        self.chars[inside] = lower[codes[is_letter]]
        self.bits, self.n, self.n_texts = bits, n, len(texts)

    def grams(self) -> Iterator[np.ndarray]:
        """For each n the bucket of the n-gram at each place, or the last bucket but one (no n-gram) where the word ends before."""
        none = 1 << self.bits
        left = np.repeat(self.begin[1:], self.letters + 2) - np.arange(len(self.chars))
        key = np.zeros(len(self.chars), U64)
        with np.errstate(over="ignore"):
            for n in range(1, GRAMS + 1):
                ahead = np.zeros(len(self.chars), U64)
                ahead[: len(self.chars) - n + 1] = self.chars[n - 1 :]
                key = key * U64(0x9E3779B97F4A7C15) + ahead + U64(n)
                yield np.where(left >= n, (mix(key) >> U64(64 - self.bits)).astype(np.int64), none)


class Model:
    def __init__(self, languages: list[str], how: Languages, counts: np.ndarray, scripts: np.ndarray, rows: np.ndarray):
        """counts: (n, bucket, language); scripts: letters by (script, language); rows: texts by language."""
        self.languages, self.how = languages, how
        self.prior = int(rows.argmax()) if len(rows) else -1
        self.table = np.zeros((GRAMS, counts.shape[1] + 1, len(languages)), np.float32)  # the last row: no n-gram
        for n in range(GRAMS if languages else 0):
            score = np.log((counts[n] + how.smoothing) / (counts[n].sum(axis=0) + how.smoothing * counts.shape[1]))
            self.table[n, :-1] = (score - score.mean(axis=1, keepdims=True)) / GRAMS
        share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        self.allowed = share >= how.least_share
        self.allowed[~self.allowed.any(axis=1)] = True

    def scores(self, words: Words) -> np.ndarray:
        """(word, language); scripts no language used say nothing, impossible languages lose."""
        out = np.zeros((len(words.chars), len(self.languages)), np.float32)
        for n, buckets in enumerate(words.grams()):
            out += self.table[n][buckets]
        out = np.add.reduceat(out, words.begin[:-1], axis=0) if words.n else out[:0]
        allowed = self.allowed[words.script]
        out[allowed.all(axis=1) & (words.script == 0)] = 0
        return np.where(allowed, out, out.min(axis=1, keepdims=True) - np.float32(2 * self.how.penalty))

    def label(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each word's language, and each text's sums of scores."""
        k = len(self.languages)
        if not k:
            return np.zeros(words.n, np.int64), np.zeros((words.n_texts, 0))
        score = self.scores(words).astype(np.float64)
        ends = np.searchsorted(words.text, np.arange(words.n_texts + 1))
        sums = np.stack([np.bincount(words.text, score[:, j], words.n_texts) for j in range(k)], axis=1)
        best = sums.argmax(axis=1)
        label = best[words.text]
        if not words.n or k == 1:
            return label, sums
        gain = score - score[np.arange(words.n), label][:, None]
        running = np.concatenate([np.zeros((1, k)), np.cumsum(gain, axis=0)])
        # the least running sum before each word of its own text: a large step down at each text keeps texts apart
        span = 1 + running.max() - running.min()
        before = np.minimum.accumulate(running[:-1] - span * words.text[:, None], axis=0) + span * words.text[:, None]
        mixed = np.zeros(words.n_texts, bool)
        mixed[words.text[(running[1:] - before).max(axis=1) > self.how.penalty]] = True
        for t in np.flatnonzero(mixed):
            label[ends[t] : ends[t + 1]] = viterbi(score[ends[t] : ends[t + 1]], self.how.penalty)
        return label, sums


def viterbi(score: np.ndarray, penalty: float) -> np.ndarray:
    """The best path: each step keeps its label, or takes the best other one for the penalty."""
    n, k = score.shape
    came, rows = np.empty((n, k), np.int64), score.tolist()
    value, stay = rows[0], list(range(k))
    for i in range(1, n):
        top = max(value)
        best = value.index(top)
        top -= penalty
        came[i] = [j if value[j] >= top else best for j in stay]
        value = [(v if v >= top else top) + s for v, s in zip(value, rows[i], strict=True)]
    out = np.empty(n, np.int64)
    out[-1] = value.index(max(value))
    for i in range(n - 1, 0, -1):
        out[i - 1] = came[i, out[i]]
    return out


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, how: Languages = Languages()) -> Model:
    """Counts of a bounded sample, made in tasks and summed here: one row a task and language."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}  # a row a language
    languages = sorted(sizes)
    fitting = how.model_bytes // (4 * GRAMS * max(1, len(languages)))
    how = replace(how, bits=max(4, min(how.bits, fitting.bit_length() - 1)))
    size = 1 << how.bits
    if not languages:
        return Model([], how, np.zeros((GRAMS, size, 0)), np.zeros((len(NAMES), 0)), np.zeros(0))
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, how.per_language / n)))))
    # 62 bits: the bound holds for any number of rows; equal rows, which share a hash, are merged before they are moved
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)) < F.try_element_at(share, F.col("lang")) * float(1 << 62)).dropDuplicates().select("text", "lang").repartition(8)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                langs = np.array(part.column("lang").to_pylist())
                texts = part.column("text").to_pylist()
                for lang in set(langs.tolist()):
                    words = Words([texts[i] for i in np.flatnonzero(langs == lang)], how.bits)
                    own, scripts = counts.setdefault(lang, (np.zeros((GRAMS, size + 1), np.float32), np.zeros(len(NAMES))))
                    for n, buckets in enumerate(words.grams()):
                        own[n] += np.bincount(buckets, minlength=size + 1)
                    scripts += np.bincount(words.script, words.letters, len(NAMES))
        for lang, (own, scripts) in counts.items():
            yield pa.record_batch([pa.array([lang]), pa.array([own[:, :-1].tobytes()], pa.binary()), pa.array([scripts.tobytes()], pa.binary())], names=["lang", "counts", "scripts"])

    counts, scripts = np.zeros((GRAMS, size, len(languages))), np.zeros((len(NAMES), len(languages)))
    for row in chosen.mapInArrow(tidy(step), "lang string, counts binary, scripts binary").toLocalIterator():
        j = languages.index(row.lang)
        counts[:, :, j] += np.frombuffer(bytes(row.counts), np.float32).reshape(GRAMS, size)
        scripts[:, j] += np.frombuffer(bytes(row.scripts))
    return Model(languages, how, counts, scripts, np.array([sizes[x] for x in languages]))


def labelled(batches: Iterator[pa.RecordBatch], model: Model, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, "text", limit):
            words = Words(part.column("text").to_pylist(), model.how.bits)
            yield part, words, *model.label(words)


def languages(docs: DataFrame, how: Languages = Languages(), model: Model | None = None) -> DataFrame:
    """Each document's language, and the share of its letters in spans of it times how sure the scores are."""
    model = model or train(docs, how)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names, k = model.languages, len(model.languages)
        for part, words, label, sums in labelled(batches, model):
            letters = np.bincount(words.text, words.letters, words.n_texts)
            by = np.bincount(words.text * k + label, words.letters, words.n_texts * k).reshape(-1, k) if k else np.zeros((words.n_texts, 1))
            # texts that say nothing go to the most frequent language
            silent = (letters > 0) & (np.ptp(sums, axis=1) == 0) if k else np.zeros(words.n_texts, bool)
            best = np.where(silent, model.prior, by.argmax(axis=1))
            share = np.where(silent, 1 / max(k, 1), by.max(axis=1) / np.maximum(letters, 1))
            sure = np.where(silent, 1, 1 / np.exp(np.clip(sums - sums[np.arange(len(best)), best][:, None], -700, 0) / 4).sum(axis=1)) if k else np.zeros(words.n_texts)
            known = (letters > 0) & (k > 0)
            pred = [names[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(np.where(known, share * sure, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(tidy(step), RESULT)


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """Runs of words with one language: first and last place in the text, and the language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, label, _ in labelled(batches, sent.value):
            new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])])) if words.n else np.zeros(0, np.int64)
            last = np.append(new[1:], words.n)[: len(new)] - 1
            ids = part.column("doc_id").to_pylist()
            yield pa.record_batch(
                [pa.array([ids[t] for t in words.text[new]], pa.int64()), pa.array(words.start[new]), pa.array(words.end[last]), pa.array([sent.value.languages[j] for j in label[new]], pa.string())],
                names=["doc_id", "start", "end", "lang"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(step), SPANS)
