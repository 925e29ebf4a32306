"""BagMinHash signatures of multisets of word shingles.

A shingle that occurs c times has c unit levels. Its levels fall into dyadic ranges
[0, 1), [1, 2), [2, 4), [4, 8), ...; each range is a Poisson process over (time, level,
component) seeded by shingle and range, so that equal shingles of different texts share
points, and a point counts for a text if its level is under c: a point's level comes from
halving its range again and again by the bits of a hash. The earliest point of each
component is its signature value, so two texts agree in a component with probability
sum(min(c, c')) / sum(max(c, c')), the weighted Jaccard similarity, without bias.
"""

from __future__ import annotations

import numpy as np

from quarry.llm import scan

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Points are made up to a time by which a text lacks a component with probability exp(-SLACK) at most; then later.
SLACK = 4.0


def shingles(t: scan.Texts, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), by text: 64-bit hashes of windows of ``width`` words.

    A text of fewer words, but one at least, is one shingle as a whole.
    """
    words = t.word_hashes()
    n = len(words)
    at = np.arange(n)
    left = t.bounds[1:][t.doc] - at
    short = (t.n_words < width)[t.doc]
    begin = np.flatnonzero((left >= width) | (short & (at == t.bounds[:-1][t.doc])))
    rolling = words[begin].copy()
    factor = 1
    for k in range(1, width):
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
        more = left[begin] > k
        rolling[more] += words[begin[more] + k] * _U(factor)
    rolling += np.minimum(left[begin], width).astype(np.uint64)
    doc, keys = t.doc[begin], scan.mixed(rolling)
    order = np.argsort(keys)
    order = order[np.argsort(doc[order].astype(np.uint16) if t.n < 1 << 16 else doc[order], kind="stable")]  # 16 bits: a radix sort
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], keys[first], np.diff(np.append(first, len(keys)))


def _points(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, horizon: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text and component, time over the text's horizon, value) of all points in time that count."""
    ranges = [(doc, shingle, count, np.zeros(len(doc), np.int64), np.ones(len(doc)))]
    low = 1
    while len(doc):
        more = count > low
        doc, shingle, count = doc[more], shingle[more], count[more]
        ranges.append((doc, shingle, count, np.full(len(doc), low), np.full(len(doc), float(low))))
        low *= 2
    slots, times, values = [], [], []
    for number, (doc, shingle, count, base, span) in enumerate(ranges):
        seed = scan.mixed(shingle + _U((number + 1) * int(_STEP) % 2**64))
        rate, until = span * size, horizon[doc]
        limit = np.exp(-rate * until)  # the first point is in time if its uniform exceeds this
        at = np.zeros(len(doc))
        k = 0
        while len(seed):
            k += 1
            draw = scan.mixed(seed + _U(k * int(_STEP) % 2**64))
            uniform = ((draw >> _U(11)).astype(np.float64) + 1) * 2.0**-53
            on = np.flatnonzero(uniform > limit)  # limit: of the time that is left
            doc, seed, rate, until, base, span, count = (x[on] for x in (doc, seed, rate, until, base, span, count))
            at, draw = at[on] - np.log(uniform[on]) / rate, draw[on]
            limit = np.exp(-rate * (until - at))
            place = scan.mixed(draw ^ _U(0xA0761D6478BD642F))
            level = base + ((place & _U(0xFFFFFFFF)).astype(np.float64) * span * 2.0**-32).astype(np.int64)
            counts = np.flatnonzero(level < count) if number else slice(None)
            slots.append((doc * size + ((place >> _U(32)) * _U(size) >> _U(32)).astype(np.int64))[counts])
            times.append((at / until)[counts])
            values.append(((draw * _STEP) >> _U(32)).astype(np.uint32)[counts])
    return np.concatenate(slots), np.concatenate(times), np.concatenate(values)


def signatures(n: int, doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """``size`` 32-bit values for each of ``n`` texts; texts without shingles have zeros."""
    out = np.zeros((n, size), np.uint32)
    weight = np.bincount(doc, count, n)
    due, slack = weight > 0, SLACK
    while due.any():
        on = due[doc]
        horizon = (np.log(size) + slack) / np.maximum(weight, 1)
        slot, time, value = _points(doc[on], shingle[on], count[on], horizon, size)
        key = (slot.astype(np.uint64) << _U(40)) | np.minimum(time * 2.0**40, 2.0**40 - 1).astype(np.uint64)
        order = np.argsort(key)
        slot = slot[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        slot, value = slot[first], value[order[first]]
        whole = np.bincount(slot // size, minlength=n) == size
        own = whole[slot // size]
        out.reshape(-1)[slot[own]] = value[own]
        due &= ~whole
        slack *= 2
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` values; the run's number is part of it."""
    n, size = signature.shape
    parts = signature.reshape(n, size // rows, rows).astype(np.uint64)
    key = np.tile(np.arange(1, size // rows + 1, dtype=np.uint64), (n, 1))
    for k in range(rows):
        key = scan.mixed(key * _STEP + parts[:, :, k])
    return key.view(np.int64)
