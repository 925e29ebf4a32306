"""Words, lines and n-grams of many texts at once, as numpy arrays over UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes
inside a longer character, so byte runs and character runs agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = ~_SPACE
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a little-endian number


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def folded(value: Callable[[np.ndarray, np.ndarray], np.ndarray], count: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of 64-bit numbers: ``value(run, k)`` is the k-th number of each of some runs.

    Numbers are mixed in one after another, eight to a block, and the blocks' hashes in
    turn, so that a run's hash depends on nothing but its numbers.
    """
    out = np.zeros(len(count), np.uint64)
    blocks = -(-count // 8)
    first = np.cumsum(blocks) - blocks
    run = np.repeat(np.arange(len(count)), blocks) if blocks.max(initial=0) > 1 else np.flatnonzero(blocks)
    place = (np.arange(len(run)) - first[run]) * 8
    left = count[run] - place
    h = np.zeros(len(run), np.uint64)
    for k in range(min(8, int(left.max(initial=0)))):
        on = np.flatnonzero(left > k) if k else slice(None)
        h[on] = mixed(h[on] * _STEP + value(run[on], place[on] + k))
    out[run[place == 0]] = h[place == 0]
    long = np.flatnonzero(blocks > 1)
    if len(long):
        out[long] = folded(lambda r, k: h[first[long[r]] + k], blocks[long])
    return out


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
ASCII_LETTER = _LETTER & (np.arange(256) < 0x80)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray, latin: bool = True) -> np.ndarray:
    """Lower case of A-Z, and of the letters U+00C0 to U+00DE if ``latin``."""
    out = _LOWER[data]
    if latin and len(out) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 0x20
    return out


class Texts:
    """A run of texts: bytes, offsets, and where their words are (``inside``: bytes of words)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _WORD):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._wide: np.ndarray | None = None
        self._at: np.ndarray | None = None  # of characters
        self._words: np.ndarray | None = None
        word = inside[data]
        first, last = word.copy(), word.copy()
        if len(word):
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            full = offsets[1:] > offsets[:-1]
            begins, ends = offsets[:-1][full], offsets[1:][full] - 1
            first[begins], last[ends] = word[begins], word[ends]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # of each text's words
        self.n_words = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(self.n), self.n_words)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, alike wherever the same bytes stand."""
        if self._wide is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._wide = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        sizes = ends - starts

        def value(run: np.ndarray, k: np.ndarray) -> np.ndarray:
            return self._wide[starts[run] + 8 * k] & _MASKS[np.minimum(sizes[run] - 8 * k, 8)]

        return mixed(folded(value, -(-sizes // 8)) + sizes.astype(np.uint64))

    def letters(self) -> Texts:
        """The same texts in lower case, with runs of letters as words."""
        return Texts(lowered(self.data), self.offsets, _LETTER)

    def affixes(self, width: int, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(words that are longer than ``width`` characters, hashes of their first or last ``width``)."""
        if self._at is None:
            lead = (self.data & 0xC0) != 0x80
            self._at = np.append(np.flatnonzero(lead), len(self.data))
            before = np.concatenate([[0], np.cumsum(lead)])
            self._from, self._to = before[self.starts], before[self.ends]
        long = np.flatnonzero(self._to - self._from > width)
        if end:
            return long, self.hashes(self._at[self._to[long] - width], self.ends[long])
        return long, self.hashes(self.starts[long], self._at[self._from[long] + width])

    def word_hashes(self) -> np.ndarray:
        if self._words is None:
            self._words = self.hashes(self.starts, self.ends)
        return self._words

    def characters(self) -> np.ndarray:
        """Characters before each byte, one entry more than bytes."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array by text."""
        before = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(before[self.offsets])


def texts_of(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, Texts) over pieces of a string column; null reads as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if offsets is not None and n else np.zeros(n + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j, Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        equal = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][equal]] = True
        out[order[:-1][equal]] = True
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Positions of 0..n-1 inside any window [start, start + width); starts are distinct."""
    steps = np.zeros(n + 1, np.int32)
    steps[starts] += 1
    steps[starts + width] -= 1
    return np.cumsum(steps[:-1]) > 0
