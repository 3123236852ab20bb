"""Token ids of whole texts with the tokenizers library, a distinct word at a time.

The default vocabulary turns white space into word ends and drops it, lower-cases each character by itself
and never lets a token cross white space, so the ids of a text are the ids of its words, one after the other.
Each task encodes a word once and keeps its ids in a bounded table.  Vocabularies for which that does not
hold (tokens with a space in them) take ``by_word=False`` and are encoded text by text.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from .common import split_words

VOCABULARY = "word_bpe_49k.json"
#: Bytes of words and ids, with what Python adds, in each of the two generations that a worker keeps.
CACHE_BYTES, OBJECT_BYTES = 28 << 20, 110
#: Bytes of text to encode at once: a word that recurs within is looked up once.
ENCODE_BYTES = 2 << 20
#: Words in one call of the library.
JOINED = 200


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None, by_word: bool = True, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """The worker's encoder: its vocabulary and known words serve all its tasks."""
    return Encoder(path, by_word, cache_bytes)


class Encoder:
    def __init__(self, path: str | None = None, by_word: bool = True, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        special = self.tokenizer.get_added_tokens_decoder()
        #: A special token is never part of a word: it keeps the words of one call apart.
        self.fence = next(((n, t.content) for n, t in special.items() if t.special), None)
        #: Which ids end a run of letters; "," and "." by themselves.
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = [np.frombuffer(x, np.uint32) for x in self.ids([",", "."])]
        self.split_letters = self.ends.any() and all(len(x) == 1 for x in self.marks)
        self.by_word, self.cache_bytes, self.known, self.older, self.held = by_word, cache_bytes, {}, {}, 0

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, many words to a call."""
        if self.fence is None:
            return self.ids(words)
        number, fence = self.fence
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for group, joined in zip(groups, self.ids([f" {fence} ".join(g) for g in groups]), strict=True):
            cuts = (np.flatnonzero(np.frombuffer(joined, np.uint32) == number) * 4).tolist()
            if len(cuts) == len(group) - 1:
                out += [joined[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(joined)], strict=True)]
            else:  # a word has the token's text in it
                out += self.ids(group)
        return out

    def ids_of_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone: each has one id that ends it, its last."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for group, joined in zip(groups, self.ids([" ".join(g) for g in groups]), strict=True):
            cuts = (np.flatnonzero(self.ends[np.frombuffer(joined, np.uint32)]) * 4 + 4).tolist()
            if len(cuts) == len(group) and cuts[-1] == len(joined):
                out += [joined[a:b] for a, b in zip([0, *cuts], cuts)]  # noqa: B905
            else:
                out += self.ids(group)
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each with ``end`` after its own: offsets by text, and ids."""
        if self.by_word:
            offsets, flat = self._by_word(texts)
        else:
            parts = self.ids([x or "" for x in texts.to_pylist()])
            offsets, flat = np.cumsum([0, *(len(x) // 4 for x in parts)]), np.frombuffer(b"".join(parts), np.uint32)
        n = len(offsets) - 1
        out = np.insert(flat, offsets[1:], end) if n else flat
        return offsets + np.arange(n + 1), out

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, words = split_words(texts)
        if not len(words):
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint32)
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        keys, plain, mark = self._keys(distinct)
        coded = keys.dictionary_encode()
        of, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        letters = np.zeros(len(keys), bool)
        letters[of] = plain
        own = self._known(keys, letters.tolist())
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ends, flat = gather(np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(own), np.uint32), of)
        marked = np.flatnonzero(mark >= 0)
        flat = np.insert(flat, ends[marked + 1], np.concatenate(self.marks)[mark[marked]]) if len(marked) else flat
        ends = ends + np.concatenate([[0], np.cumsum(mark >= 0)])
        ends, flat = gather(ends, flat, codes)
        return ends[offsets], flat

    def _keys(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What is to be encoded for each word, whether that is letters alone, and which mark follows (or -1).

        Letters up to U+024F have one lower case each (but for U+0130), and letters and a comma or full stop after
        them are encoded apart; so "The," takes the ids of "the" and of ","."""
        if not self.split_letters:
            return words, np.zeros(len(words), bool), np.full(len(words), -1)
        last = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, -1), value_set=pa.array([",", "."], words.type)), -1)
        core = pc.if_else(pc.equal(last, -1), words, pc.utf8_slice_codeunits(words, 0, -1))
        plain = pc.and_(pc.utf8_is_alpha(core), pc.invert(pc.match_substring_regex(core, r"[^\x{0000}-\x{024F}]|\x{0130}")))
        keys = pc.if_else(plain, pc.utf8_lower(core), words)
        plain = plain.to_numpy(zero_copy_only=False)
        return keys, plain, np.where(plain, last.to_numpy(zero_copy_only=False), -1)

    def _known(self, keys: list[str], letters: list[bool]) -> list[bytes]:
        if self.held > self.cache_bytes:
            self.known, self.older, self.held = {}, self.known, 0
        own = list(map(self.known.get, keys))
        missing = [i for i, x in enumerate(own) if x is None]
        if self.older:
            for i in missing:
                own[i] = self.older.get(keys[i])
            self._keep([(keys[i], own[i]) for i in missing if own[i] is not None])
            missing = [i for i in missing if own[i] is None]
        for kind, ids in ((True, self.ids_of_letters), (False, self.ids_of_words)):
            chosen = [i for i in missing if letters[i] == kind]
            words = [keys[i] for i in chosen]
            for i, found in zip(chosen, ids(words), strict=True):
                own[i] = found
            self._keep([(keys[i], own[i]) for i in chosen])
        return own

    def _keep(self, found: list[tuple[str, bytes]]) -> None:
        """Remember words; one so long that it is no word stays out."""
        found = [(k, v) for k, v in found if len(k) < 1000]
        self.known.update(found)
        self.held += sum(len(k) + len(v) + OBJECT_BYTES for k, v in found)


def gather(ends: np.ndarray, flat: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` between ``ends``, one for each number in ``of``: their ends, and all in order."""
    each = np.diff(ends)[of]
    out = np.concatenate([[0], np.cumsum(each)])
    return out, flat[np.arange(out[-1]) + np.repeat(ends[:-1][of] - out[:-1], each)]
