"""Token ids of whole texts with a public tokenizer file, one encoding per distinct word of a batch."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

#: Bytes, about, of the words that a worker remembers before it keeps only those met often; it bounds the worker's memory, not
#: the result. A word's share is its characters and WORD_BYTES.
REMEMBERED, WORD_BYTES = 72 << 20, 200
#: Characters that are encoded at once; a longer text is cut where the vocabulary's split into words never depends on both sides.
AT_ONCE = 1 << 20
#: Such a place: before a blank between letters, or a line end between characters that are no white space.
CUT = re.compile("(?<=[a-z]) (?=[a-z])|(?<=[a-z,.])\n(?=[A-Za-z])")


def _classes() -> tuple[str, str, str]:
    letters, numbers = ("".join(f"\\u{i:04x}" for i in range(0x250) if unicodedata.category(chr(i))[0] == k) for k in "LN")
    return letters, numbers, r"\t\n\x0b\x0c\r \x85\xa0"


class Known(dict):
    """Numbers of words; a word not met before gets the next number and waits in ``new``."""

    new: list[str]

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Ids of texts under a byte-level vocabulary file of the ``tokenizers`` library.

    The vocabulary splits text into words before it merges bytes, so a text's ids are its words' ids in a
    row. Texts in Latin letters are split here and each distinct word is encoded once; any other text, and one that
    holds the string of an added token, goes to the library as it is. Ids are those of the library's
    ``encode(text, add_special_tokens=False)``: no token is added, and an added token's string is that token.
    """

    def __init__(self, path: str, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        letters, numbers, space = _classes()
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.other = re.compile("|".join(["[^\\x00-\\x1b\\x20-\\u024f]", *map(re.escape, added)]))
        vocabulary = self.tokenizer.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int32)
        self.id_bytes[list(vocabulary.values())] = list(map(len, vocabulary))  # a character stands for a byte
        self.clear()

    def clear(self) -> None:
        """Forget every word."""
        self.known, self.used, self.weight = Known(), 0, 0
        self.known.new = []
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin, self.size, self.hits = (np.zeros(1 << 14, t) for t in (np.int64, np.int32, np.int32))

    def forget(self) -> None:
        """Keep the words met often, or none if those are too many."""
        words = list(self.known)
        keep = np.flatnonzero(self.hits[: len(words)] > 2)
        self.weight = sum(len(words[i]) + WORD_BYTES for i in keep.tolist())
        if self.weight > (self.remembered or REMEMBERED) // 2:
            return self.clear()
        size, begin = self.size[keep], self.begin[keep]
        ends = np.cumsum(size, dtype=np.int64)
        self.used = int(ends[-1]) if len(ends) else 0
        self.flat[: self.used] = self.flat[np.arange(self.used) + np.repeat(begin - (ends - size), size)]
        self.known = Known(zip([words[i] for i in keep.tolist()], range(len(keep)), strict=True))
        self.known.new = []
        self.begin[: len(keep)], self.size[: len(keep)] = ends - size, size
        self.hits[:] = 0

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and how many each word has. Words of a space and letters are encoded side by side."""
        plain = np.fromiter((w[0] == " " and w[1:].isalpha() for w in words), bool, len(words))
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * 2
        sizes = np.zeros(len(words), np.int32)
        if plain.any():
            some = [w for w, p in zip(words, plain.tolist(), strict=True) if p]
            runs = ["".join(some[i : i + 500]) for i in range(0, len(some), 500)]
            ids[0] = np.concatenate([np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
            after = np.cumsum(self.id_bytes[ids[0]])
            sizes[plain] = np.diff(np.searchsorted(after, np.cumsum(list(map(len, map(str.encode, some)))), side="right"), prepend=0)
        if not plain.all():
            lists = [x.ids for x in self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain.tolist(), strict=True) if not p], add_special_tokens=False)]
            ids[1] = np.fromiter((i for x in lists for i in x), np.int32)
            sizes[~plain] = list(map(len, lists))
        out = np.empty(int(sizes.sum()), np.int32)
        of_plain = np.repeat(plain, sizes)
        out[of_plain], out[~of_plain] = ids
        return out, sizes

    def learn(self, words: list[str]) -> None:
        flat, sizes = self.encoded(words)
        n = len(self.known)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.begin):
            self.begin, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.hits))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[n - len(words) : n] = self.used + np.cumsum(sizes) - sizes
        self.size[n - len(words) : n] = sizes
        self.used += len(flat)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (int32) and each text's number of ids; a null text is an empty one."""
        if max((len(t) for t in texts if t), default=0) <= AT_ONCE:
            return self.some(texts)
        flat, sizes = [], []
        for text in texts:
            ids = [self.some([p])[0] for p in cut(text or "")]
            flat += ids
            sizes.append(sum(map(len, ids)))
        return np.concatenate(flat), np.array(sizes, np.int64)

    def some(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        counts, whole = [], {}
        for k, text in enumerate(texts):
            if text and self.other.search(text):
                whole[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                counts.append(0)
            else:
                found = self.words.findall(text) if text else []
                words += found
                counts.append(len(found))
        if self.weight > (self.remembered or REMEMBERED):
            self.forget()
        at = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        if self.known.new:
            self.weight += sum(len(w) + WORD_BYTES for w in self.known.new)
            self.learn(self.known.new)
            self.known.new = []
        self.hits[: len(self.known)] += np.bincount(at, minlength=len(self.known)).astype(np.int32)
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[at] - ends[:-1], size)]
        of = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        edges = ends[of]
        if not whole:
            return ids, np.diff(edges)
        parts = [whole[k] if k in whole else ids[edges[k] : edges[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def cut(text: str, size: int | None = None) -> Iterator[str]:
    """``text`` in a row, cut at the first :data:`CUT` from every ``size`` characters on."""
    at, size = 0, size or AT_ONCE
    while len(text) - at > size and (found := CUT.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end`` after each text's."""
    return np.insert(ids, np.cumsum(sizes), end), sizes + 1


def each(ids: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    for n in sizes.tolist():
        yield ids[at : at + n]
        at += n


_ENCODERS: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, remembered: int | None = None) -> Encoder:
    """One encoder of a worker process for each vocabulary file; it keeps its words, within their bound (``remembered`` bytes,
    about, or :data:`REMEMBERED`), from task to task."""
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]
