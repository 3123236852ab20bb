"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A block's features are the tags and the words of class, id and role around it, and the shape of its text:
length, links, marks, punctuation, place on the page.  The field scores labels of blocks and of neighbours
(main text, page chrome, notices and forms, comments); it is trained by maximum likelihood on labelled pages
(a bounded number, a parameter) and decoded by Viterbi, many pages at a time.  The blocks labelled as main
text, joined by newlines, are the page's text.

Defined results: null or empty html has no blocks and an empty text; a page without markup is one block; equal
or null page_ids are rows of their own; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy
from .labelled_pages import LABELS, labelled
from .page_blocks import Block, blocks

RESULT = "page_id long, url string, text string, n_chars long, n_blocks long"
MAIN = LABELS.index("main")
PAGES, STEPS = 800, 150
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@lru_cache(maxsize=20_000)
def path_features(path: tuple) -> tuple[str, ...]:
    """Of the elements around a block."""
    tags = [tag for tag, _ in path if tag not in ("html", "body")]
    names = {w.rstrip("s") for _, words in path for w in words}
    # the innermost element of a kind that says where we are
    inner = next((t for t in reversed(tags) if t in ("article", "main", "aside", "nav", "header", "footer", "form", "head")), "none")
    named = next((words for _, words in reversed(path) if words), ())
    out = [f"tag {t}" for t in set(tags)] + [f"name {n}" for n in names] + [f"in {inner}", f"parent {tags[-1] if tags else 'none'}", f"depth {min(len(tags), 5)}"]
    out += [f"near {n.rstrip('s')}" for n in named]
    body = "article" in tags or "main" in tags
    out.append(f"spot {inner} {'inside' if body else 'outside'} {'heading' if tags and tags[-1] in HEADINGS else 'text'}")
    if body:
        out.append(f"inside {'named' if any(words for tag, words in path[next(i for i, p in enumerate(path) if p[0] in ('article', 'main')) + 1 :]) else 'plain'}")
    return tuple(out)


def text_features(block: Block, i: int, n: int) -> list[str]:
    text = block.text
    size = len(text)
    words = text.count(" ") + 1
    links = block.linked / size
    return [
        "bias",
        f"size {size.bit_length()}",
        f"words {min(words, 4) if words < 5 else 3 + words.bit_length()}",
        f"links {'none' if not links else 'all' if links >= 0.9 else 'some'}",
        f"marks {'none' if not block.marked else 'some'}",
        f"end {'stop' if text[-1] in '.!?:…' else 'other'}",
        f"comma {', ' in text}",
        f"copyright {'©' in text or '·' in text}",
        f"bar {'|' in text or '»' in text}",
        f"first {'upper' if text[0].isupper() else 'other'}",
        f"place {0 if i == 0 else 9 if i == n - 1 else 1 + 6 * i // n}",
    ]


class Crf:
    """Weights of features, neighbours and ends; the features known are those of the training pages."""

    def __init__(self, known: dict[str, int], weights: np.ndarray):
        self.known = known
        k, n = len(LABELS), len(known)
        self.emit, self.step, self.start, self.stop = weights[: n * k].reshape(n, k), weights[n * k : n * k + k * k].reshape(k, k), weights[-2 * k : -k], weights[-k:]

    def scores(self, pages: list[list[Block]]) -> np.ndarray:
        """(block, label) of all pages, one after the other."""
        ids, ends = [], [0]
        for page in pages:
            for i, block in enumerate(page):
                ids += [f for x in (*path_features(block.path), *text_features(block, i, len(page))) if (f := self.known.get(x)) is not None]
                ends.append(len(ids))
        return np.add.reduceat(self.emit[ids], ends[:-1], axis=0)

    def decode(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Labels of the blocks of each page, by Viterbi; pages of all lengths step together."""
        sizes = np.array([len(p) for p in pages])
        if not sizes.sum():
            return [np.zeros(0, np.int64) for _ in pages]
        score, first = self.scores(pages), np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        value = self.start + score[first[order]]
        came: list[np.ndarray] = []
        final = value + self.stop
        for t in range(1, int(sizes.max())):
            live = int((sizes[order] > t).sum())
            paths = value[:live, :, None] + self.step
            came.append(paths.argmax(axis=1))
            value = paths.max(axis=1) + score[first[order[:live]] + t]
            final[:live] = value + self.stop
        label, out = final.argmax(axis=1), [np.zeros(n, np.int64) for n in sizes]
        for row, p in enumerate(order.tolist()):
            at = out[p]
            at[-1] = label[row]
            for t in range(len(at) - 1, 0, -1):
                at[t - 1] = came[t - 1][row, at[t]]
        return out


def likelihood(weights: np.ndarray, n: int, flat: np.ndarray, begins: np.ndarray, page_of: np.ndarray, place: np.ndarray, truth: np.ndarray, sizes: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of all labelled pages and its gradient, by the forward-backward recursions."""
    k = len(LABELS)
    model = Crf(dict.fromkeys(range(n)), weights)
    score = np.add.reduceat(model.emit[flat], begins, axis=0)
    pages, longest = len(sizes), int(sizes.max())
    grid = np.zeros((pages, longest, k))
    grid[page_of, place] = score
    gold = np.zeros((pages, longest), np.int64)
    gold[page_of, place] = truth
    inside = np.arange(longest) < sizes[:, None]
    last = np.arange(pages), sizes - 1

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    ahead = np.zeros((pages, longest, k))
    ahead[:, 0] = model.start + grid[:, 0]
    for t in range(1, longest):
        ahead[:, t] = total(ahead[:, t - 1, :, None] + model.step, 1) + grid[:, t]
    back = np.zeros((pages, longest, k))
    back[last] = model.stop
    for t in range(longest - 2, -1, -1):
        found = total(model.step + (grid[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where((t < sizes - 1)[:, None], found, back[:, t])
    norm = total(ahead[last] + model.stop, 1)
    each = np.exp(np.where(inside[..., None], ahead + back - norm[:, None, None], -np.inf))
    hot = np.eye(k)[gold] * inside[..., None]
    both = inside[:, 1:]
    pair = np.exp(np.where(both[..., None, None], ahead[:, :-1, :, None] + model.step + (grid + back)[:, 1:, None, :] - norm[:, None, None, None], -np.inf))
    seen = np.einsum("pti,ptj->ij", hot[:, :-1] * both[..., None], hot[:, 1:])
    worth = (score * np.eye(k)[truth]).sum() + (seen * model.step).sum() + model.start[gold[:, 0]].sum() + model.stop[gold[last]].sum() - norm.sum()
    emit = np.zeros((n, k))
    np.add.at(emit, flat, np.repeat((hot - each)[page_of, place], np.diff(np.append(begins, len(flat))), axis=0))
    return worth, np.concatenate([emit.ravel(), (seen - pair.sum(axis=(0, 1))).ravel(), (hot - each)[:, 0].sum(axis=0), (hot - each)[last].sum(axis=0)])


@lru_cache(maxsize=4)
def trained(pages: int = PAGES, steps: int = STEPS, seed: int = 1) -> Crf:
    """The field for ``pages`` labelled pages."""
    return fit(labelled(pages, seed), steps)


def fit(examples: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = 0.15, prior: float = 0.1) -> Crf:
    """Maximum likelihood with a Gaussian prior, by gradient steps of adapted size (Adam)."""
    known: dict[str, int] = {}
    flat: list[int] = []
    begins, page_of, place, truth = [], [], [], []
    for p, (page, labels) in enumerate(examples):
        for i, (block, label) in enumerate(zip(page, labels, strict=True)):
            begins.append(len(flat))
            flat += [known.setdefault(x, len(known)) for x in (*path_features(block.path), *text_features(block, i, len(page)))]
            page_of.append(p)
            place.append(i)
            truth.append(label)
    k, n = len(LABELS), len(known)
    arrays = [np.array(x) for x in (flat, begins, page_of, place, truth)]
    sizes = np.bincount(arrays[2])
    weights = np.zeros(n * k + k * k + 2 * k)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        _, up = likelihood(weights, n, *arrays, sizes)
        up = up - prior * weights
        mean, square = 0.9 * mean + 0.1 * up, 0.99 * square + 0.01 * up**2
        weights = weights + rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Crf(known, weights)


def main_text(pages: list[str | None], model: Crf) -> list[tuple[str, int]]:
    """Each page's text and its number of blocks."""
    found = [blocks(p) for p in pages]
    return [("\n".join(b.text for b, y in zip(page, labels, strict=True) if y == MAIN), len(page)) for page, labels in zip(found, model.decode(found), strict=True)]


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page; narrow, no shuffle."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                texts, sizes = zip(*main_text(part.column("html").to_pylist(), sent.value), strict=True)
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(tidy(step), RESULT)
