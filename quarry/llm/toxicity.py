"""Toxicity by weak supervision.

Lexicon voters (whole words), pattern voters (beginnings of words) and shape voters
(shouting, several lexicon words) vote "toxic" or abstain. A generative label model
estimates from their votes alone how often each fires in either class, alone and together
with the voter that it depends on most; its posterior labels train a linear classifier
over hashed words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm import scan, training
from quarry.llm.shared import over_batches

THRESHOLD = 0.7
#: Lengths of the beginnings of words that may become voters.
PREFIXES = (3, 4, 5, 6)
#: A voter fires in so many toxic sample texts (and such a share of them) at least, and is
#: so many times likelier there than in others.
MIN_SUPPORT, MIN_SHARE, MIN_LIFT = 4, 0.01, 60.0
#: Size of the model, whatever the corpus: voters, the best supported ones, and the classifier's words.
MAX_VOTERS, MAX_FEATURES = 384, 512
_TABLE_BITS = 22


def _hits(t: scan.Texts, codes: np.ndarray, table: tuple[np.ndarray, np.uint64]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for each word or beginning of a word in ``codes``, distinct."""
    found, (slots, shift) = [], table
    t = t.letters()
    for width in (0, *PREFIXES):
        words, hashes = t.affixes(width) if width else (np.arange(len(t.starts)), t.word_hashes())
        hashes = scan.mixed(hashes + np.uint64(width))
        at = slots[(hashes >> shift) & np.uint64((1 << _TABLE_BITS) - 1)]
        near = np.flatnonzero(at >= 0)
        near = near[codes[at[near]] == hashes[near]]
        found.append(t.doc[words[near]] * len(codes) + at[near])
    pairs = np.unique(np.concatenate(found))
    return pairs // max(len(codes), 1), pairs % max(len(codes), 1)


def _table(codes: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """(number of a code by some of its bits, else -1; where those bits begin): no two codes share them."""
    for shift in range(64 - _TABLE_BITS):
        own = (codes >> np.uint64(shift)) & np.uint64((1 << _TABLE_BITS) - 1)
        if len(np.unique(own)) == len(codes):
            out = np.full(1 << _TABLE_BITS, -1, np.int16)
            out[own] = np.arange(len(codes))
            return out, np.uint64(shift)
    raise ValueError("codes are not distinct")


def _shapes(t: scan.Texts, lexicon_hits: np.ndarray) -> np.ndarray:
    """Shape voters for each text: two lexicon hits or more, shouting marks, capitals."""
    marks = np.zeros(len(t.data), bool)
    if len(t.data) > 1:
        marks[1:] = (t.data[1:] == 0x21) & (t.data[:-1] == 0x21)
    upper = t.per_text((t.data >= 0x41) & (t.data <= 0x5A))
    lower = t.per_text((t.data >= 0x61) & (t.data <= 0x7A))
    return np.stack([lexicon_hits >= 2, t.per_text(marks) > 0, upper > lower], 1)


SHAPES = 3
#: Times that each voter's vote alone counts among the classifier's training texts.
ALONE = 3
#: Residual correlation from which a voter depends on another one.
DEPENDENT = 0.3


@dataclass(frozen=True)
class Voters:
    """What the label model knows: ``rates[y, v, j]`` is how likely voter j votes in class y if the voter that it
    depends on votes (v = 1) or not, ``leader`` that voter or -1, ``prior`` P(toxic)."""

    rates: np.ndarray
    leader: np.ndarray
    prior: float

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic of each row from the votes that are cast; to abstain says nothing."""
        odds = np.log(self.rates[1] / self.rates[0])
        led = votes[:, self.leader] * (self.leader >= 0)
        return votes @ odds[0] + (votes * led) @ (odds[1] - odds[0])


def _leaders(votes: np.ndarray, posterior: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """For each voter the one that it agrees with most beyond what the class explains; leaders vote more often, so that none leads itself."""
    rest = (votes - np.outer(1 - posterior, rates[0]) - np.outer(posterior, rates[1])).astype(np.float32)
    spread = np.sqrt((rest**2).sum(0)) + 1e-9
    alike = (rest.T @ rest) / np.outer(spread, spread)
    rank = np.argsort(np.argsort(-votes.sum(0), kind="stable"))
    alike[rank[None, :] >= rank[:, None]] = 0
    return np.where(alike.max(1, initial=0) > DEPENDENT, alike.argmax(1) if len(alike) else -1, -1)


def label_model(votes: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, Voters]:
    """Posterior P(toxic) of each row of ``votes`` (bool), and what the model has learned.

    Expectation-maximisation over a latent class. A voter that abstains says nothing; that
    all abstain is evidence of its own. Voters form trees: the rates of a voter are
    estimated apart for texts where its leader votes and where not, so that a voter that
    mostly repeats another one adds nothing. Leaders are found anew every few rounds.
    """
    votes = votes.astype(np.float32)
    n, m = votes.shape
    silent = (votes.sum(1) == 0).astype(np.float64)
    posterior = 1 - 0.3 ** votes.sum(1)
    leader, known = np.full(m, -1), Voters(np.ones((2, 2, m)), np.full(m, -1), 0.5)
    for k in range(rounds):
        mass = np.stack([(1 - posterior).sum(), posterior.sum()])
        every = np.stack([(1 - posterior) @ votes + 0.05, posterior @ votes + 0.5]) / (mass[:, None] + 1)
        if k % 5 == 0:
            leader = _leaders(votes, posterior, every)
        led = votes[:, leader] * (leader >= 0)
        both, of = votes * led, np.stack([1 - posterior, posterior])
        pooled = both.sum(0) / np.maximum(led.sum(0), 1)
        with_leader = (of @ both + 2 * pooled) / (of @ led + 2)  # where a class has few texts, both follow the same rate
        alone = (of @ (votes - both) + 2 * every) / (mass[:, None] - of @ led + 2)
        alone = np.where(leader >= 0, alone, every)
        prior = (mass[1] + 1) / (n + 2)
        known = Voters(np.clip(np.stack([alone, with_leader], 1), 1e-5, 1 - 1e-5), leader, prior)
        silence = np.log((posterior @ silent + 0.5) / (mass[1] + 1)) - np.log(((1 - posterior) @ silent + 0.5) / (mass[0] + 1))
        odds = np.log(prior / (1 - prior)) + known.evidence(votes) + silent * silence
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, known


def _linear(x: np.ndarray, y: np.ndarray, steps: int = 800) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam, lightly shrunk."""
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    m = np.zeros(len(w) + 1, np.float32)
    v = np.zeros(len(w) + 1, np.float32)
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = np.append(x.T @ (p - y) / len(y) + 1e-5 * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    return w, float(b)


@dataclass(frozen=True)
class Model:
    codes: np.ndarray  # hashes of words and beginnings
    weights: np.ndarray  # of those, then of the shape voters
    bias: float
    lexicon: int  # the first so many codes are voters

    def scores(self, t: scan.Texts, table: tuple[np.ndarray, np.uint64]) -> np.ndarray:
        doc, feature = _hits(t, self.codes, table)
        sums = np.bincount(doc, self.weights[feature], t.n) + self.bias
        shapes = _shapes(t, np.bincount(doc[feature < self.lexicon], minlength=t.n))
        return 1 / (1 + np.exp(-np.clip(sums + shapes @ self.weights[len(self.codes) :], -40, 40)))


def _features(t: scan.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs of words and beginnings of words, one array each."""
    t = t.letters()
    docs, codes = [], []
    for width in (0, *PREFIXES):
        words, hashes = t.affixes(width) if width else (np.arange(len(t.starts)), t.word_hashes())
        docs.append(t.doc[words])
        codes.append(scan.mixed(hashes + np.uint64(width)))
    doc, code = np.concatenate(docs), np.concatenate(codes)
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    return doc[new], code[new]


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Mine voters where the labels say toxic, fit the label model on votes, the classifier on its posteriors.

    Copies of a text count once, else words of a text that is often copied would pass for voters.
    """
    whole = [t.hashes(t.offsets[:-1], t.offsets[1:]) for _, _, t in scan.texts_of(texts)]
    first = np.sort(np.unique(np.concatenate([np.zeros(0, np.uint64), *whole]), return_index=True)[1])
    texts, labels = texts.take(pa.array(first)), labels[first]
    n = len(labels)
    if not n or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(SHAPES), -5.0, 0)
    # only what occurs often enough in toxic texts is looked for in all
    likely, counts = np.unique(np.concatenate([_features(t)[1] for _, _, t in scan.texts_of(texts.filter(pa.array(labels == 1)))]), return_counts=True)
    names = likely[counts >= MIN_SUPPORT]
    docs, found = [], []
    for i, _, t in scan.texts_of(texts):
        doc, code = _features(t)
        near = np.minimum(np.searchsorted(names, code), max(len(names) - 1, 0))
        on = names[near] == code if len(names) else np.zeros(len(code), bool)
        docs.append(doc[on] + i)
        found.append(near[on])
    doc, at = np.concatenate(docs), np.concatenate(found)
    toxic = np.bincount(at, labels[doc], len(names))
    clean = np.bincount(at, 1 - labels[doc], len(names))
    lift = (toxic + 0.5) / (labels.sum() + 1) / ((clean + 0.5) / (n - labels.sum() + 1))
    strong = np.flatnonzero((toxic >= max(MIN_SUPPORT, MIN_SHARE * labels.sum())) & (lift >= MIN_LIFT))
    # voters that fire in the same texts are one
    where = np.zeros(len(names), np.uint64)
    np.add.at(where, at, scan.mixed(doc.astype(np.uint64) + np.uint64(7)))
    strong = strong[np.sort(np.unique(where[strong], return_index=True)[1])]
    strong = strong[np.argsort(-toxic[strong], kind="stable")][:MAX_VOTERS]
    mine = np.full(len(names), -1)
    mine[strong] = np.arange(len(strong))
    on = mine[at] >= 0
    votes = np.zeros((n, len(strong) + SHAPES), bool)
    votes[doc[on], mine[at[on]]] = True
    hits = votes.sum(1)
    for i, _, t in scan.texts_of(texts):
        votes[i : i + t.n, len(strong) :] = _shapes(t, hits[i : i + t.n])
    for k in range(len(strong), votes.shape[1]):  # a shape votes if it lifts as much as a word must
        on_toxic, on_clean = labels @ votes[:, k], (1 - labels) @ votes[:, k]
        if (on_toxic + 0.5) / (labels.sum() + 1) < MIN_LIFT * (on_clean + 0.5) / (n - labels.sum() + 1):
            votes[:, k] = False
    posterior, voters = label_model(votes)

    # further words that the posterior speaks for or against
    mass = np.bincount(at, posterior[doc], len(names))
    total = toxic + clean
    base = posterior.mean()
    z = (mass - base * total) / np.sqrt(base * (1 - base) * total + 1)
    z[strong] = 0
    more = np.flatnonzero((np.abs(z) >= 6) & (total >= 20))
    more = more[np.argsort(-np.abs(z[more]), kind="stable")][: MAX_FEATURES - len(strong)]
    chosen = np.concatenate([strong, more])
    mine[:] = -1
    mine[chosen] = np.arange(len(chosen))
    on = mine[at] >= 0
    x = np.zeros((n, len(chosen) + SHAPES), np.float32)
    x[doc[on], mine[at[on]]] = 1
    x[:, len(chosen) + 1 :] = votes[:, len(strong) + 1 :]  # not "two hits": one word must do where there is one
    # what the label model says of a text with one vote alone, for words that mostly come together
    odds = np.log(voters.prior / (1 - voters.prior)) + voters.evidence(np.eye(len(strong), votes.shape[1], dtype=np.float32))
    alone = np.eye(len(strong), x.shape[1], dtype=np.float32)
    x = np.concatenate([x, *[alone] * ALONE])
    y = np.concatenate([posterior, *[1 / (1 + np.exp(-odds))] * ALONE])
    weights, bias = _linear(x, y.astype(np.float32))
    return Model(names[chosen], weights, bias, len(strong))


def trained(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 3, held_out: int = 1, rows: int = training.SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled rows outside of the held-out fold."""
    got = training.sample(docs, labels, target, training.fold("doc_id", folds) != held_out, rows)
    model = fit(got["text"].combine_chunks(), (got[target].to_numpy() == 1).astype(np.float64))
    training.released()
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each whole text, 0 to 1; null and empty texts get the score of no evidence.

    Rows are judged alone, so order, ties and repeated rows don't matter; a column that
    is already named ``score`` is replaced.
    """
    docs = docs.select(*[docs[c] for c in docs.columns if c.lower() != score.lower()])
    at, names = docs.columns.index(text), [*docs.columns, score]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = _table(model.codes)
        parts = [model.scores(t, table) for _, _, t in scan.texts_of(batch.column(at))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts))], names)

    return over_batches(docs, work, StructType([*docs.schema.fields]).add(score, "double"))


def clean_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score under ``threshold``, with their columns unchanged."""
    model = trained(docs, labels)
    return scored(docs, model, score="__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity")
