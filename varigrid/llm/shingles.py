"""Hashes of word shingles, vectorised over the UTF-8 bytes of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x5851F42D4C957F2D)
WORDS = 5
#: Characters from which a text is read in pieces.
LONG = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_TABLE = np.random.Generator(np.random.Philox(key=5)).integers(0, 1 << 64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Places of one block of sums.
_BLOCK = 1 << 16
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, first: int, many: int) -> np.ndarray:
    """``base`` to the powers from ``first`` on."""
    out = np.full(many, base, np.uint64)
    out[:1] = pow(int(base), first, 1 << 64)
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of any substrings of an array of bytes, or of code points, in constant time each.

    It keeps eight bytes a place: sums are made in blocks, and powers are products of two short tables.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        within = _powers(BASE, 0, min(n, _BLOCK) + 1)
        for a in range(0, n, _BLOCK):
            part = data[a : a + _BLOCK]
            value = _TABLE[part] if data.dtype == np.uint8 else mixed(part.astype(np.uint64) + GOLDEN)
            value *= within[: len(part)] * np.uint64(pow(int(BASE), a, 1 << 64))
            np.cumsum(value, out=self.sums[a + 1 : a + 1 + len(part)])
            self.sums[a + 1 : a + 1 + len(part)] += self.sums[a]
        self.low = _powers(_INVERSE, 0, 1024)
        self.high = _powers(np.uint64(pow(int(_INVERSE), 1024, 1 << 64)), 0, n // 1024 + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * (self.low[begin & 1023] * self.high[begin >> 10]))

    def runs(self, begin: int, end: int, length: int) -> np.ndarray:
        """Hashes of the substrings of ``length`` that begin at ``begin`` to ``end`` - 1."""
        at = np.arange(begin, end)
        return mixed((self.sums[begin + length : end + length] - self.sums[begin:end]) * (self.low[at & 1023] * self.high[at >> 10]))


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """``text`` in a row, cut before blanks or line ends so that a piece has about ``size`` characters; words stay whole."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at + 1, at + size), text.rfind("\n", at + 1, at + size))
        if cut < 0:
            cut = min((x for x in (text.find(" ", at + size), text.find("\n", at + size)) if x > 0), default=-1)
            if cut < 0:
                break
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and each text's number of words.

    A word is a maximal run of ASCII letters, digits and any other character beyond ASCII, in lower case. Long
    texts are read in pieces.
    """
    if max((len(t) for t in texts if t), default=0) > LONG:
        each = [[_word_hashes([p])[0] for p in pieces(t or "")] for t in texts]
        return np.concatenate([x for parts in each for x in parts]), np.array([sum(map(len, parts)) for parts in each], np.int64)
    return _word_hashes(texts)


def _word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    word = np.concatenate([[False], _WORD[data]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edge[::2], edge[1::2]
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return Rolling(data).of(begin, end), np.diff(np.searchsorted(begin, starts))


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
    """Distinct shingle hashes of each text in order, their counts, and a digest of its words.

    A text of fewer words than ``width`` is one shingle; a text without words has none.
    """
    words, sizes = word_hashes(texts)
    n = len(words)
    rolled = words.copy()
    for j in range(1, width):
        rolled[: n - j] = rolled[: n - j] * BASE + words[j:] if n > j else rolled[:0]
    rolled = mixed(rolled)
    out, at = [], 0
    for size in sizes.tolist():
        own = words[at : at + size]
        if size >= width:
            hashes = np.sort(rolled[at : at + size - width + 1])
        else:
            hashes = own[:0] if not size else np.array([xxhash.xxh3_64_intdigest(own.tobytes())], np.uint64)
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        out.append((hashes[first], np.diff(first, append=len(hashes)), xxhash.xxh3_128_digest(own.tobytes())))
        at += size
    return out
