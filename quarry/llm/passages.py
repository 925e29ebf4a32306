"""A memory of passages: how often stretches of ids occur in the training documents.

A text's ids, its end included, are cut wherever a hash of the last two ids says so, so
that a passage is cut alike in any text. The memory counts whole stretches; absolute
discounting leaves what it takes off the counts to another model of the same stretch:

    P(stretch) = max(count - D, 0) / N + D * V / N * P(stretch by the other model)

with N stretches in all, V distinct ones and D = n1 / (n1 + 2 n2) by the numbers of
stretches that occur once and twice. No stretch begins another one after the same id, so
these probabilities sum to one at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import scan

#: Ids of a stretch, about.
MEAN = 32
#: The least and the largest discount, whatever the counts: each part keeps some weight.
LEAST, MOST = 0.1, 0.95


def cut(row: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, hash) of each stretch of a flat row of texts; ``ends`` has the places of their ends."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    number = row.astype(np.uint64)
    before = np.concatenate([[np.uint64(end)], number[:-1]])
    last = (scan.mixed((before << np.uint64(32)) + number) >> np.uint64(32)) % np.uint64(MEAN) == 0
    last[ends] = True
    stops = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], stops[:-1]])
    sizes = stops - starts
    doubled = np.concatenate([(number[:-1] << np.uint64(32)) | number[1:], number[-1:] << np.uint64(32)])  # two ids from each place on

    def value(run: np.ndarray, k: np.ndarray) -> np.ndarray:
        got = doubled[starts[run] + 2 * k]
        return np.where(2 * k + 1 < sizes[run], got, got >> np.uint64(32) << np.uint64(32))

    return starts, scan.mixed(scan.folded(value, -(-sizes // 2)) + sizes.astype(np.uint64))


def multiplicities(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often each stretch occurs in its own text."""
    keys = scan.mixed(text.astype(np.uint64) + np.uint64(1)) ^ hashes
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[at]


@dataclass(frozen=True)
class Totals:
    """N, V and D."""

    stretches: int
    distinct: int
    discount: float

    @property
    def left(self) -> float:
        """The share of the other model."""
        return self.discount * self.distinct / self.stretches if self.stretches else 1.0

    def gain(self, count: Column, other: Column) -> Column:
        """log10 of P(stretch) over ``left`` times the other model's probability, whose log10 is ``other``."""
        z = F.log10(F.greatest(count - self.discount, F.lit(1e-300))) - F.lit(float(np.log10(max(self.stretches * self.left, 1e-300)))) - other
        return F.when(z > 15, z).otherwise(F.log10(1 + F.pow(F.lit(10.0), z)))


def totals(counts: DataFrame) -> Totals:
    """Of a table with ``n`` for each distinct stretch."""
    got = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    return Totals(got[0], got[1], min(max(got[2] / max(got[2] + 2 * got[3], 1), LEAST), MOST))
