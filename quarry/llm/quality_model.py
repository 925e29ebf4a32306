"""Quality classifier: a factorisation machine.

Inputs are hashed words (presence, scaled to unit length), statistics of a text's
structure and its size as metadata. Pairwise interactions have low rank, so a score takes
linear time: 1/2 * sum over factors of (sum v x)^2 - sum (v x)^2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quarry.llm import scan, training
from quarry.llm.shared import over_batches

WORD_BITS, RANK, EPOCHS, BATCH, LEAST_STEPS = 15, 8, 6, 256, 240
#: Structure statistics and size classes that follow the words among the inputs.
STATISTICS = ("log_words", "mean_word", "upper", "digits", "marks", "symbols", "shouts", "adjacent", "distinct", "lines", "line_words", "long_words")
SIZE_CLASSES = 12
_N = 1 << WORD_BITS


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


_UPPER, _DIGIT = _flags(bytes(range(65, 91))), _flags(b"0123456789")
_MARK, _SYMBOL, _SHOUT = _flags(b".,;:?'\"()-"), _flags(b"#*$%&|<>@^~=+_\\{}[]"), _flags(b"!")


def _by_text(t: scan.Texts, values: np.ndarray) -> np.ndarray:
    return np.bincount(t.doc, values, t.n)


def statistics(t: scan.Texts) -> np.ndarray:
    """One row of STATISTICS for each text, about 0 to 5 each."""
    words, size = np.maximum(t.n_words, 1), np.maximum(np.diff(t.offsets), 1)
    hashes, lengths = t.word_hashes(), t.ends - t.starts
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (t.doc[1:] == t.doc[:-1])
    own = hashes + scan.mixed(t.doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own)
    first = np.ones(len(own), bool)
    first[order[1:]] = own[order[1:]] != own[order[:-1]]
    lines = t.per_text(t.data == 0x0A) + 1
    return np.stack(
        [
            np.log1p(t.n_words) / 2,
            _by_text(t, lengths) / words / 4,
            t.per_text(_UPPER[t.data]) / size * 5,
            t.per_text(_DIGIT[t.data]) / size * 10,
            t.per_text(_MARK[t.data]) / words,
            t.per_text(_SYMBOL[t.data]) / words,
            t.per_text(_SHOUT[t.data]) / words,
            _by_text(t, same) / words * 5,
            _by_text(t, first) / words * 2,
            np.log1p(lines) / 2,
            np.log1p(words / lines) / 2,
            _by_text(t, lengths > 20) / words * 5,
        ],
        1,
    )


@dataclass(frozen=True)
class Inputs:
    """Sparse rows: ``doc`` ascending, ``at`` the input's number, ``x`` its value."""

    n: int
    doc: np.ndarray
    at: np.ndarray
    x: np.ndarray

    def rows(self, chosen: np.ndarray) -> Inputs:
        """Rows in the order of ``chosen``."""
        bounds = np.searchsorted(self.doc, np.arange(self.n + 1))
        counts = np.diff(bounds)[chosen]
        flat = np.arange(counts.sum()) + np.repeat(bounds[chosen] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        return Inputs(len(chosen), np.repeat(np.arange(len(chosen)), counts), self.at[flat], self.x[flat])


def inputs(t: scan.Texts) -> Inputs:
    keys = np.unique((t.doc << WORD_BITS) | (t.word_hashes() & np.uint64(_N - 1)).astype(np.int64))
    word_doc, word = keys >> WORD_BITS, keys & (_N - 1)
    x_word = 1 / np.sqrt(np.bincount(word_doc, minlength=t.n)[word_doc]) if len(keys) else np.zeros(0)
    stats = np.minimum(statistics(t), 5.0)
    size = _N + len(STATISTICS) + np.minimum(np.log2(np.diff(t.offsets) + 1).astype(np.int64) // 2, SIZE_CLASSES - 1)
    each = np.arange(t.n)
    doc = np.concatenate([word_doc, np.repeat(each, len(STATISTICS)), each])
    at = np.concatenate([word, np.tile(_N + np.arange(len(STATISTICS)), t.n), size])
    x = np.concatenate([x_word, stats.ravel(), np.ones(t.n)]).astype(np.float32)
    order = np.argsort(doc, kind="stable")
    return Inputs(t.n, doc[order].astype(np.int32), at[order].astype(np.int32), x[order])


@dataclass
class Model:
    bias: float
    w: np.ndarray  # by input
    v: np.ndarray  # (input, RANK)

    def parts(self, rows: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(odds, sums of v x by row and factor, v x by entry)."""
        vx = self.v[rows.at] * rows.x[:, None]
        starts = np.searchsorted(rows.doc, np.arange(rows.n))  # each row has entries
        sums = np.add.reduceat(vx, starts) if rows.n else np.zeros((0, RANK), np.float32)
        squares = np.add.reduceat((vx * vx).sum(1), starts) if rows.n else np.zeros(0, np.float32)
        linear = np.bincount(rows.doc, self.w[rows.at] * rows.x, rows.n)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums, vx

    def scores(self, t: scan.Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(inputs(t))[0], -40, 40).astype(np.float64)))


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Logistic loss by Adam over mini-batches; the word inputs are shrunk towards nothing.

    Without rows, or with one class only, every score is that class's share (1/2 of nothing).
    """
    random = np.random.default_rng(seed)
    n_inputs = _N + len(STATISTICS) + SIZE_CLASSES
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(n_inputs, np.float32), random.normal(0, 0.02, (n_inputs, RANK)).astype(np.float32))
    if not len(labels) or labels.min() == labels.max():
        model.v[:] = 0
        return model
    parts = [(i, inputs(t)) for i, _, t in scan.texts_of(texts)]
    rows = Inputs(len(labels), *(np.concatenate(x) for x in zip(*((p.doc + np.int32(i), p.at, p.x) for i, p in parts), strict=True)))
    params = [model.w, model.v]
    means, spreads = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    batches = max(1, len(labels) // BATCH)
    for _ in range(max(epochs, -(-LEAST_STEPS // batches))):
        for chosen in np.array_split(random.permutation(len(labels)), batches):
            step += 1
            batch = rows.rows(chosen)
            odds, sums, vx = model.parts(batch)
            off = ((1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[chosen]) / len(chosen)).astype(np.float32)
            entry = off[batch.doc] * batch.x
            pull = entry[:, None] * (sums[batch.doc] - vx)
            grads = [
                np.bincount(batch.at, entry, n_inputs).astype(np.float32),
                np.stack([np.bincount(batch.at, pull[:, f], n_inputs) for f in range(RANK)], 1).astype(np.float32),
            ]
            for p, g, m, s in zip(params, grads, means, spreads, strict=True):
                g[:_N] += 1e-4 * p[:_N]
                m += 0.1 * (g - m)
                s += 0.02 * (g * g - s)
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-5)
            model.bias -= 0.02 * float(off.sum())
    return model


def trained(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 4, held_out: int = 2, rows: int = training.SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled rows outside of the held-out fold."""
    got = training.sample(docs, labels, target, training.fold("doc_id", folds) != held_out, rows)
    model = fit(got["text"].combine_chunks(), (got[target].to_numpy() == 1).astype(np.float32))
    training.released()
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the quality of each whole text, 0 to 1; null reads as empty, and empty texts have a score.

    Rows are judged alone, so order, ties and repeated rows don't matter; a column that
    is already named ``score`` is replaced.
    """
    docs = docs.select(*[docs[c] for c in docs.columns if c.lower() != score.lower()])
    at, names = docs.columns.index(text), [*docs.columns, score]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [model.scores(t) for _, _, t in scan.texts_of(batch.column(at))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts))], names)

    return over_batches(docs, work, StructType([*docs.schema.fields]).add(score, "double"))
