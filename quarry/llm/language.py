"""Language identification by a linear-chain conditional random field.

Each word gets a label: affix, character n-gram and lexicon features score it alone, and
learned transitions tie it to its neighbours. Forward-backward gives the probability of
each label at each word of a text, code-switched ones included; a text's language is that
with the largest expected share of its words. Long texts are cut into blocks whose
transfer matrices are chained, which is exact and keeps numpy's loops short.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quarry.llm import scan, training
from quarry.llm.shared import over_batches

#: Bounds of the training sample, and hash buckets of features.
SAMPLE_ROWS, SAMPLE_BYTES, FEATURE_BITS = 4_000, 12 << 20, 16
#: Words of the sample's texts in the spliced sequences that the weights learn from, at most.
SPLICED = 400_000
AFFIXES, NGRAMS = (1, 2, 3), (2, 3)
BLOCK = 32
UNKNOWN = "und"
_N = 1 << FEATURE_BITS


@dataclass
class Words:
    """Distinct words of some texts: their hashes, and bucket numbers of their features.

    ``features`` run by word, ``starts`` is where each word's begin.
    """

    code: np.ndarray
    features: np.ndarray
    starts: np.ndarray


def distinct(t: scan.Texts) -> tuple[Words, np.ndarray]:
    """(distinct words, number of each word of ``t`` among them); ``t`` has letters as words."""
    code, first, at = np.unique(t.word_hashes(), return_index=True, return_inverse=True)
    lead = (t.data & 0xC0) != 0x80
    char_at = np.append(np.flatnonzero(lead), len(t.data))
    before = np.concatenate([[0], np.cumsum(lead)])
    begin, end = before[t.starts[first]], before[t.ends[first]]
    words, buckets = [np.arange(len(code))], [(scan.mixed(code) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)]

    def add(word: np.ndarray, low: np.ndarray, high: np.ndarray, kind: int) -> None:
        hashes = scan.mixed(t.hashes(char_at[low], char_at[high]) + np.uint64(kind))
        words.append(word)
        buckets.append((hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))

    for width in AFFIXES:
        word = np.flatnonzero(end - begin >= width)
        add(word, begin[word], begin[word] + width, width)
        add(word, end[word] - width, end[word], 10 + width)
    for width in NGRAMS:
        many = np.maximum(end - begin - width + 1, 0)
        word = np.repeat(np.arange(len(code)), many)
        low = begin[word] + np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
        add(word, low, low + width, 20 + width)
    word, bucket = np.concatenate(words), np.concatenate(buckets)
    order = np.argsort(word, kind="stable")
    return Words(code, bucket[order], np.searchsorted(word[order], np.arange(len(code)))), at


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (bucket, label)
    lexicon: np.ndarray  # sorted word hashes
    lexicon_label: np.ndarray
    lexicon_weights: np.ndarray  # (label of the lexicon, label)
    transitions: np.ndarray  # (label, label)

    def in_lexicon(self, code: np.ndarray) -> np.ndarray:
        """The label whose lexicon has each word, or -1."""
        if not len(self.lexicon):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.lexicon, code), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == code, self.lexicon_label[at], -1)

    def emissions(self, words: Words, lexical: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(self.weights[words.features], words.starts).astype(np.float64) if len(words.code) else np.zeros((0, len(self.labels)))
        known = lexical >= 0
        out[known] += self.lexicon_weights[lexical[known]]
        return out


def marginals(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """P(label) at each word: ``scores`` (word, label) of texts whose words lie between ``bounds``.

    A text starts from equal labels. Work arrays hold all blocks at one place within them.
    """
    n, k = scores.shape
    if not n:
        return scores
    local = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(transitions)
    sizes = np.diff(bounds)
    many = -(-sizes // block)
    first_block = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(doc)) - first_block[:-1][doc]
    begin = bounds[:-1][doc] + number * block
    length = np.minimum(block, bounds[1:][doc] - begin)
    order = np.argsort(-length, kind="stable")  # at each place the blocks that reach it come first
    begin_s, length_s = begin[order], length[order]
    reach = [int(np.searchsorted(-length_s, -j, "left")) for j in range(block + 1)]  # blocks longer than j

    transfer = np.broadcast_to(np.eye(k), (len(doc), k, k)).copy()
    for j in range(block):
        m = reach[j]
        if not m:
            break
        transfer[:m] = (transfer[:m].reshape(m * k, k) @ step).reshape(m, k, k) * local[begin_s[:m] + j][:, None, :]
    place = np.empty(len(doc), np.int64)
    place[order] = np.arange(len(doc))
    transfer /= transfer.max((1, 2), keepdims=True)

    by_size = np.argsort(-many, kind="stable")  # texts with the most blocks first
    most = int(many.max())
    live = [int(np.searchsorted(-many[by_size], -j, "left")) for j in range(most + 1)]
    enter, leave = np.full((len(doc), k), 1.0 / k), np.ones((len(doc), k))  # before a block; after it, from behind
    for j in range(1, most):
        texts = by_size[: live[j]]
        at = first_block[texts] + j
        v = np.einsum("bi,bij->bj", enter[at - 1], transfer[place[at - 1]])
        enter[at] = v / v.sum(1, keepdims=True)
    for j in range(most - 2, -1, -1):
        texts = by_size[: live[j + 1]]
        at = first_block[texts] + j
        v = np.einsum("bij,bj->bi", transfer[place[at + 1]], leave[at + 1])
        leave[at] = v / v.sum(1, keepdims=True)

    out = np.empty((n, k))
    a = enter[order]
    for j in range(block):
        m = reach[j]
        if not m:
            break
        v = (a[:m] @ step) * local[begin_s[:m] + j]
        a[:m] = v / v.sum(1, keepdims=True)
        out[begin_s[:m] + j] = a[:m]
    b = leave[order]
    for j in range(block - 1, -1, -1):
        m = reach[j]
        at = begin_s[:m] + j
        both = out[at] * b[:m]
        out[at] = both / both.sum(1, keepdims=True)
        v = (local[at] * b[:m]) @ step.T
        b[:m] = v / v.sum(1, keepdims=True)
    return out


def _pair_marginals(local: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(label) at each place, summed P(pair of labels)) of sequences (sequence, place, label) of one length."""
    n, size, k = local.shape
    alpha, beta = np.empty_like(local), np.ones_like(local)
    v = np.full((n, k), 1.0 / k)
    for j in range(size):
        v = (v @ step) * local[:, j]
        v /= v.sum(1, keepdims=True)
        alpha[:, j] = v
    for j in range(size - 2, -1, -1):
        v = (local[:, j + 1] * beta[:, j + 1]) @ step.T
        beta[:, j] = v / v.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    before = np.concatenate([np.full((n, 1, k), 1.0 / k), alpha[:, :-1]], 1)
    pairs = before[:, :, :, None] * step * (local * beta)[:, :, None, :]
    pairs /= pairs.sum((2, 3), keepdims=True)
    return gamma, pairs.sum((0, 1))


def fit(texts: pa.Array, langs: list[str], steps: int = 120, length: int = 48, seed: int = 5) -> Model:
    """Learns from texts whose words all count as of the text's language.

    One half of the texts makes the lexicons, the other the weights. Its texts are spliced,
    in spans of 4 to 40 words, into sequences that switch languages, so that transitions
    can be learned.
    """
    random = np.random.default_rng(seed)
    labels = sorted(set(langs))
    k = len(labels)
    number = np.array([labels.index(x) for x in langs], np.int64)
    empty = np.zeros(0, np.uint64)
    model = Model(labels, np.zeros((_N, k), np.float32), empty, np.zeros(0, np.int64), np.zeros((k, k)), np.zeros((k, k)))
    if k < 2 or len(langs) < 4:
        return model
    half = random.permutation(len(langs)) % 2 == 0
    codes, owners = [], []
    for i, j, t in scan.texts_of(texts.filter(pa.array(half)), 4 << 20):
        t = t.letters()
        codes.append(t.word_hashes())
        owners.append(number[half][i:j][t.doc])
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    seen = np.stack([np.bincount(at[np.concatenate(owners) == c], minlength=len(code)) for c in range(k)], 1)
    share = seen / np.maximum(np.bincount(np.concatenate(owners), minlength=k), 1)
    best = share.argmax(1)
    sure = (seen.max(1) >= 3) & (share.max(1) >= 0.9 * share.sum(1))
    model.lexicon, model.lexicon_label = code[sure], best[sure]

    part = texts.filter(pa.array(~half))
    t = next(scan.texts_of(part, 1 << 40))[2].letters()  # the sample is bounded: one piece
    if not len(t.starts):
        return model
    words, at = distinct(t)
    lexical = model.in_lexicon(words.code)
    label = number[~half][: t.n][t.doc]
    spans: list[list[tuple[int, int]]] = [[] for _ in range(k)]
    for d in range(t.n):
        low, high = t.bounds[d], t.bounds[d + 1]
        while low < high:
            next_ = min(high, low + int(random.integers(4, 41)))
            spans[label[low]].append((low, next_))
            low = next_
    spans = [s for s in spans if s]
    if not spans:
        return model
    order, now, total = [], 0, 0
    while total < min(len(label), SPLICED):
        if random.random() < 0.4:
            now = int(random.integers(len(spans)))
        low, high = spans[now][int(random.integers(len(spans[now])))]
        order.append(np.arange(low, high))
        total += high - low
    sequence = np.concatenate(order)
    sequence = np.resize(sequence, (max(1, len(sequence) // length), length))
    params = [model.weights, model.lexicon_weights, model.transitions]
    means, spreads = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params]
    ends = np.append(words.starts, len(words.features))
    for s in range(1, steps + 1):
        rows = sequence[random.integers(0, len(sequence), min(512, len(sequence)))]
        used, where = np.unique(at[rows], return_inverse=True)
        sizes = ends[used + 1] - ends[used]
        flat = np.arange(sizes.sum()) + np.repeat(ends[used] - (np.cumsum(sizes) - sizes), sizes)
        part_words = Words(words.code[used], words.features[flat], np.cumsum(sizes) - sizes)
        scores = model.emissions(part_words, lexical[used])[where.reshape(rows.shape)]
        local = np.exp(scores - scores.max(2, keepdims=True))
        gamma, pairs = _pair_marginals(local, np.exp(model.transitions))
        truth = np.eye(k)[label[rows]]
        off = (gamma - truth) / rows.size
        by_word = np.stack([np.bincount(where.ravel(), off[:, :, c].ravel(), len(used)) for c in range(k)], 1)
        spread_out = np.repeat(by_word, sizes, 0)
        gold = np.einsum("sji,sjc->ic", truth[:, :-1], truth[:, 1:]) / rows.size
        grads = [
            np.stack([np.bincount(part_words.features, spread_out[:, c], _N) for c in range(k)], 1) + 1e-6 * model.weights,
            np.stack([by_word[lexical[used] == c].sum(0) for c in range(k)]) + 1e-6 * model.lexicon_weights,
            pairs / rows.size - gold + 1e-4 * model.transitions,
        ]
        for p, g, m, v in zip(params, grads, means, spreads, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p -= (0.05 * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.98**s)) + 1e-8)).astype(p.dtype)
        np.clip(model.transitions, -6, 6, out=model.transitions)
    return model


def predict(t: scan.Texts, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, its expected share of words, number of words) of each text."""
    words_of = t.letters()
    if not len(words_of.starts) or not model.labels:
        return [UNKNOWN] * t.n, np.zeros(t.n), words_of.n_words
    words, at = distinct(words_of)
    scores = model.emissions(words, model.in_lexicon(words.code))[at]
    found = marginals(scores, words_of.bounds, model.transitions)
    sums = np.stack([np.bincount(words_of.doc, found[:, c], t.n) for c in range(len(model.labels))], 1)
    share = sums / np.maximum(words_of.n_words, 1)[:, None]
    best = share.argmax(1)
    names = [model.labels[b] for b in best]
    # bytes over 0x7F may be signs: such words are letters only if a character is
    ascii_letters = t.per_text(scan.ASCII_LETTER[t.data])
    for i in np.flatnonzero(ascii_letters == 0):
        if not any(c.isalpha() for c in t.data[t.offsets[i] : t.offsets[i + 1]].tobytes().decode("utf-8", "replace")):
            names[i] = UNKNOWN
    score = np.where(np.array([x == UNKNOWN for x in names]), 0.0, np.clip(share.max(1), 0, 1))
    return names, score, words_of.n_words


def trained(docs: DataFrame, folds: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``rows`` texts with a language outside of the held-out fold."""
    in_fold = training.fold("doc_id", folds) != held_out
    got = training.sample(docs, None, "lang", in_fold, rows, text_bytes)
    model = fit(got["text"].combine_chunks(), got["lang"].to_pylist())
    training.released()
    return model


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) of each whole text.

    Texts that are null or have no letter are ``und`` with score 0. Rows are judged alone;
    columns that are already named like a result are replaced.
    """
    docs = docs.select(*[docs[c] for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    at, names = docs.columns.index(text), [*docs.columns, "lang_pred", "score"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [predict(t, model) for _, _, t in scan.texts_of(batch.column(at))]
        langs = pa.array([x for p in parts for x in p[0]], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, langs, pa.array(np.concatenate([p[1] for p in parts]))], names)

    return over_batches(docs, work, StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double"))
