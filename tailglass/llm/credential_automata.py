"""Secret scan: probabilistic automata inferred from labelled credentials score every candidate by its format.

Base rules find credentials by their words and shapes; what they find is labelled with its kind.  From a bounded sample
of these a prefix tree is made for each kind, over classes of characters, and states that are statistically compatible
are merged (ALERGIA: red states, blue candidates, Hoeffding's bound on every common suffix).  One more automaton comes
from ordinary runs of characters.  Then each run that no base span touches is scored: the log-likelihood under a kind's
automaton less the one under the ordinary automaton, and spans above the odds that are asked for are added.

Nulls: a null text is an empty one and has no spans, a null doc_id is kept; rows that repeat are judged each for itself
and alike; equal likelihoods go to the kind listed first; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sliced, slices, tidy
from .tokens import gather

# The base rules by kind, and the least length of what they find.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: What may be a credential: a run of these characters, of the least length that any rule has.
RUN, LEAST_RUN = "A-Za-z0-9+/_.=-", 12

#: Characters that step together in runs that are much longer.
BLOCK = 1024

#: Number of "ordinary run" among the samples, behind the kinds.
ORDINARY = len(KINDS)
SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"

_byte = lambda pattern: np.array([b < 0x80 and re.fullmatch(pattern, chr(b)) is not None for b in range(256)])
_RUN, _HEX = _byte(f"[{RUN}]"), _byte("[0-9a-f]")
#: Class of each character of a run, the alphabet of the automata.
CLASSES = ("[0-9]", "[a-f]", "[g-z]", "[A-F]", "[G-Z]", "[+]", "/", "_", "[.]", "=", "-")
_CLASS = np.zeros(256, np.int8)
for _n, _pattern in enumerate(CLASSES):
    _CLASS[_byte(_pattern)] = _n


@dataclass(frozen=True)
class Format:
    """sample: labelled credentials of each kind to learn from; ordinary: runs of no kind to learn from; longest: bytes
    of the longest one that is learned from; alpha: of the merge test; odds: that a span needs to be added; typical: a
    run that is likelier by the character than this share of a kind's own is no example of ordinary ones."""

    sample: int = 1000
    ordinary: int = 4000
    longest: int = 256
    alpha: float = 0.05
    odds: float = 1e6
    typical: float = 0.1


@dataclass
class Automaton:
    """Next state by state and class, and natural logarithms of the probabilities of a class and of the end."""

    next: np.ndarray
    step: np.ndarray
    end: np.ndarray

    def score(self, ends: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Log-likelihood of each run (``ends`` cut ``symbols``); all runs step together, but long ones by themselves."""
        sizes = np.diff(ends)
        if (long := np.flatnonzero(sizes > BLOCK * 4)).size:
            short = np.flatnonzero(sizes <= BLOCK * 4)
            out = np.empty(len(sizes))
            out[short] = self.score(*gather(ends, symbols, short))
            out[long] = [self._long(symbols[ends[i] : ends[i + 1]]) for i in long]
            return out
        order = np.argsort(-sizes, kind="stable")
        first, left = ends[:-1][order], len(order)
        state, total = np.zeros(left, np.int64), np.zeros(left)
        longest = int(sizes.max(initial=0))
        still = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # runs longer than i
        for i in range(longest):
            left = still[i]
            symbol = symbols[first[:left] + i]
            total[:left] += self.step[state[:left], symbol]
            state[:left] = self.next[state[:left], symbol]
        out = np.empty(len(order))
        out[order] = total + self.end[state]
        return out

    def _long(self, symbols: np.ndarray) -> float:
        """The same for one run of any length: its blocks step together from every state, then they are chained."""
        at, total, many = 0, 0.0, len(self.end)
        whole = len(symbols) // BLOCK * BLOCK
        for low in range(0, whole, BLOCK * BLOCK):
            grid = symbols[low : min(low + BLOCK * BLOCK, whole)].reshape(-1, BLOCK)
            state, sums = np.tile(np.arange(many), (len(grid), 1)), np.zeros((len(grid), many))
            for i in range(BLOCK):
                symbol = grid[:, i : i + 1]
                sums += self.step[state, symbol]
                state = self.next[state, symbol]
            for follow, own in zip(state, sums, strict=True):
                total += own[at]
                at = follow[at]
        for symbol in symbols[whole:]:
            total += self.step[at, symbol]
            at = self.next[at, symbol]
        return total + self.end[at]


@dataclass
class Tree:
    """A prefix tree that becomes an automaton: how often each state was visited, ended in and left by a class."""

    visits: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    uses: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def add(self, symbols: list[int]) -> None:
        at = 0
        self.visits[0] += 1
        for s in symbols:
            self.uses[at][s] = self.uses[at].get(s, 0) + 1
            if s not in self.next[at]:
                self.next[at][s] = len(self.visits)
                for column, x in ((self.visits, 0), (self.ends, 0), (self.next, {}), (self.uses, {})):
                    column.append(x)
            at = self.next[at][s]
            self.visits[at] += 1
        self.ends[at] += 1

    def compatible(self, a: int, b: int, wide: float) -> bool:
        """Whether no frequency of the two states, or of what follows both, differs by more than chance allows."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            n, m = self.visits[a], self.visits[b]
            bound = wide * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound < 1 and abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for s in self.uses[a].keys() | self.uses[b].keys():
                if bound < 1 and abs(self.uses[a].get(s, 0) / n - self.uses[b].get(s, 0) / m) > bound:
                    return False
                if s in self.next[a] and s in self.next[b]:
                    waiting.append((self.next[a][s], self.next[b][s]))
        return True

    def fold(self, a: int, b: int) -> None:
        """All counts of the subtree ``b`` go to ``a`` and the states that follow it."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for s, n in self.uses[b].items():
                self.uses[a][s] = self.uses[a].get(s, 0) + n
                if s in self.next[a]:
                    waiting.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]


def infer(runs: list[bytes], alpha: float, smooth: float = 0.1) -> Automaton:
    """The automaton of these runs: the blue state that most runs pass is merged into a red one, or becomes red itself."""
    tree, wide = Tree(), math.sqrt(0.5 * math.log(2 / alpha))
    for run in sorted(runs):
        tree.add(_CLASS[np.frombuffer(run, np.uint8)].tolist())
    red = [0]
    known = {0}
    while blue := [(-tree.visits[b], r, s, b) for r in red for s, b in tree.next[r].items() if b not in known]:
        _, r, s, b = min(blue)
        if (same := next((x for x in red if tree.compatible(x, b, wide)), None)) is None:
            red.append(b)
            known.add(b)
        else:
            tree.next[r][s] = same
            tree.fold(same, b)
    number = {x: i for i, x in enumerate(red)}
    lost, n = len(red), len(CLASSES)  # a state for what never came
    uses, ends, follow = np.zeros((lost + 1, n)), np.zeros(lost + 1), np.full((lost + 1, n), lost)
    for x, i in number.items():
        ends[i] = tree.ends[x]
        for s, count in tree.uses[x].items():
            uses[i, s], follow[i, s] = count, number[tree.next[x][s]]
    total = uses.sum(axis=1) + ends + smooth * (n + 1)
    return Automaton(follow, np.log((uses + smooth) / total[:, None]), np.log((ends + smooth) / total))


def runs_of(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of at least ``least`` true values start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    start, end = edges[::2], edges[1::2]
    long = end - start >= least
    return start[long], end[long]


class Found:
    """Base spans and candidates of some texts, in code points counted through all of them; a line feed ends each text."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        own = texts.cast(pa.large_binary()).to_pylist()
        self.data = np.frombuffer(b"".join([x for t in own for x in (t, b"\n")]), np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 for t in own)])
        self.before = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        self.first = self.before[starts]
        spans: list[tuple[int, int, int]] = []
        #: What was labelled: kind and bytes.
        self.labelled: list[tuple[int, bytes]] = []
        hinted = pc.match_substring_regex(texts, r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]").to_numpy(zero_copy_only=False)
        for d in np.flatnonzero(hinted).tolist():
            for m in ASSIGN.finditer(own[d].decode()):
                if len(m[2]) >= LEAST["assign"]:
                    spans.append((self.first[d] + m.start(), 0, self.first[d] + m.end()))
                    self.labelled.append((0, m[2].encode()))
        hinted = pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False)
        for d in np.flatnonzero(hinted).tolist():
            for m in ACCESS.finditer(own[d].decode()):
                if len(m[0]) >= LEAST["access"]:
                    spans.append((self.first[d] + m.start(), 1, self.first[d] + m.end()))
                    self.labelled.append((1, m[0].encode()))
        for a, b in zip(*(x.tolist() for x in runs_of(_HEX[self.data], LEAST["hex"])), strict=True):
            spans.append((int(self.before[a]), 2, int(self.before[b])))
            self.labelled.append((2, self.data[a:b].tobytes()))
        spans.sort()
        #: start, kind, end; in order.
        self.spans = np.array(spans, np.int64).reshape(-1, 3)
        self.start, self.end = runs_of(_RUN[self.data], LEAST_RUN)
        reached = np.concatenate([[-1], np.maximum.accumulate(self.spans[:, 2])])
        near = np.searchsorted(self.spans[:, 0], self.before[self.end], side="left")
        free = reached[near] <= self.before[self.start]
        self.start, self.end = self.start[free], self.end[free]

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the candidates' characters, one run after the other."""
        cuts = np.stack([self.start, self.end], axis=1).ravel()
        return gather(cuts, _CLASS[self.data], np.arange(len(self.start)) * 2) if len(cuts) else (np.zeros(1, np.int64), np.zeros(0, np.int8))


def learned(docs: DataFrame, how: Format) -> list[list[bytes]]:
    """Distinct credentials of each kind, and ordinary runs: of all that the table holds, those of the least hashes."""
    most = [*[how.sample] * len(KINDS), how.ordinary]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[bytes, int]] = [{} for _ in most]

        def trim(k: int) -> None:
            kept[k] = dict(sorted(kept[k].items(), key=lambda x: (x[1], x[0]))[: most[k]])

        for batch in batches:
            for part in slices(batch, "text"):
                found = Found(part.column("text"))
                ordinary = [(ORDINARY, found.data[a:b].tobytes()) for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]
                for k, run in (*found.labelled, *ordinary):
                    if len(run) <= how.longest:
                        kept[k][run] = xxhash.xxh3_64_intdigest(run) >> 1
                for k, n in enumerate(most):
                    if len(kept[k]) > 4 * n:
                        trim(k)
        for k in range(len(most)):
            trim(k)
        rows = [(k, h, run) for k, own in enumerate(kept) for run, h in own.items()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "hash", "run"])

    found = docs.select("text").mapInArrow(tidy(step), "kind int, hash long, run binary").distinct()
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("hash", "run")))
    rows = best.where(F.col("n") <= F.element_at(F.array(*map(F.lit, most)), F.col("kind") + 1)).collect()  # how.sample of each kind, how.ordinary others
    return [[bytes(r.run) for r in rows if r.kind == k] for k in range(len(most))]


def automata_of(runs: list[list[bytes]], how: Format) -> list[Automaton | None]:
    """An automaton for each kind and one for ordinary runs; None where nothing was found to learn from.

    Credentials that no rule found are among the runs of no kind: those that look as typical ones are left out."""
    models = [infer(x, how.alpha) if x else None for x in runs[:ORDINARY]]
    ordinary = runs[ORDINARY]
    for own, model in zip(runs, models, strict=False):
        if model and ordinary:
            by_character = [model.score(*coded(x)) / (np.diff(coded(x)[0]) + 1) for x in (own, ordinary)]
            least = np.quantile(by_character[0], how.typical)
            ordinary = [x for x, value in zip(ordinary, by_character[1], strict=True) if value < least]
    return [*models, infer(ordinary, how.alpha) if ordinary else None]


def coded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum([0, *map(len, runs)]), _CLASS[np.frombuffer(b"".join(runs), np.uint8)]


def scan(docs: DataFrame, how: Format = Format()) -> DataFrame:
    """A row for each document: its base spans counted and digested, and all spans with those that the automata add."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    automata = docs.sparkSession.sparkContext.broadcast(automata_of(learned(docs, how), how))  # states of bounded samples
    least = math.log(how.odds)

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        found, models = Found(part.column("text")), automata.value
        ends, symbols = found.symbols()
        plain = models[ORDINARY].score(ends, symbols) if models[ORDINARY] else -(np.diff(ends) + 1) * math.log(len(CLASSES) + 1)
        scores = np.stack([m.score(ends, symbols) - plain if m else np.full(len(plain), -np.inf) for m in models[:ORDINARY]])
        kind = scores.argmax(axis=0)
        good = scores.max(axis=0) >= least
        added = np.stack([found.before[found.start[good]], kind[good], found.before[found.end[good]]], axis=1)
        base = np.searchsorted(found.spans[:, 0], found.first)
        every = np.concatenate([found.spans, added]).astype(np.int64)
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        cuts = np.searchsorted(every[:, 0], found.first)
        joined = lambda spans, first: ",".join(f"{KINDS[k]}:{a - first}:{b - first}" for a, k, b in spans.tolist())
        rows = []
        for d, first in enumerate(found.first[:-1].tolist()):
            own = found.spans[base[d] : base[d + 1]]
            counts = np.bincount(own[:, 1], minlength=len(KINDS)).tolist()
            rows.append((*counts, hashlib.sha256(joined(own, first).encode()).hexdigest(), joined(every[cuts[d] : cuts[d + 1]], first), int(cuts[d + 1] - cuts[d]) - sum(counts)))
        columns = [part.column("doc_id"), *(pa.array([r[i] for r in rows], pa.string() if i in (3, 4) else pa.int64()) for i in range(6))]
        return pa.record_batch(columns, names=[x.split()[0] for x in SPANS.split(", ")])

    return docs.mapInArrow(sliced(step), SPANS)
