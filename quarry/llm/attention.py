"""A small causal self-attention model in numpy over subword ids, with its training.

One attention layer with a learned bias by distance, a shifted-token path and a
feed-forward layer. The output has two steps: a softmax over classes of ids and, within
the id's class, one over slots; a class's last slot stands for its rarer ids, times each
one's share. So the probabilities of all ids sum to one, and a place costs a few dozen
products. Both softmaxes begin from the logarithms of how often a class, and a slot in
it, follows the id before, as counted in the whole corpus: the layers learn what the
rest of the window changes about that. Windows overlap: each scores its last STRIDE places once, and the places before
them are context only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

WINDOW, STRIDE = 32, 24
WIDTH, HIDDEN = 24, 48
CLASSES, SLOTS, INPUT_IDS = 32, 32, 1024
#: Windows that go through the layers together: few enough that they stay in a core's cache.
TOGETHER = 64
#: So many of those go through the output together, class by class.
OUTPUTS = 3
#: Rows whose products are summed up in one go.
PART = 256


@dataclass
class Classes:
    """How ids map to inputs and outputs; ``end`` is the id past the vocabulary that begins and ends a text."""

    inputs: np.ndarray  # by id
    group: np.ndarray  # by id: class
    slot: np.ndarray  # by id: place in the class; the last is shared
    within: np.ndarray  # by id: log of its share of the slot
    end: int
    top: np.ndarray  # (input, class): log of how likely a class is after an input; the last row is of no input
    leaf: np.ndarray  # (input, class, slot): the same of a slot within its class

    @property
    def n_inputs(self) -> int:
        return INPUT_IDS + CLASSES


#: Left neighbours that tell ids apart: the commonest.
LEFT = 128


def _ranked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank by id, the ids that can have a slot): the commonest ids first."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    return rank, order[: int((counts >= 5).sum())][: 4 * CLASSES * SLOTS]


def flat(texts: list[np.ndarray], end: int) -> np.ndarray:
    """Ids of all texts in a row, each followed by its end."""
    return np.concatenate([np.append(x, end) for x in texts]).astype(np.int64) if texts else np.zeros(0, np.int64)


def neighbours(row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of the LEFT commonest ids of ``counts`` is before each id with a slot, flat: (id, left)."""
    rank, known = _ranked(counts)
    place = np.full(len(counts), -1)
    place[known] = np.arange(len(known))
    right, left = place[row[1:]], rank[row[:-1]]
    on = (right >= 0) & (left < LEFT)
    return np.bincount(right[on] * LEFT + left[on], minlength=len(known) * LEFT)


def classes(texts: list[np.ndarray], vocabulary: int, seed: int = 3) -> Classes:
    """``arranged`` and ``followed`` by the counts of some texts."""
    row = flat(texts, vocabulary)
    counts = np.bincount(row, minlength=vocabulary + 1)
    c = arranged(counts, neighbours(row, counts), seed)
    return followed(c, sum((pairs(x, c) for x in texts), np.zeros(CELLS, np.int64)))


#: Pairs of an input and a cell (a slot of a class).
CELLS = (INPUT_IDS + CLASSES) * CLASSES * SLOTS
#: So many made-up places after each input follow the overall shares.
SMOOTH = 8.0
#: The logarithm of what can't be.
NEVER = -1e4


def pairs(row: np.ndarray, c: Classes) -> np.ndarray:
    """How often each cell follows each input in a flat row of texts, flat; an end begins the next text, and the row."""
    row = np.append(row, c.end) if not len(row) or row[-1] != c.end else row
    before = c.inputs[np.concatenate([[c.end], row[:-1]])].astype(np.int64)
    return np.bincount((before * CLASSES + c.group[row]) * SLOTS + c.slot[row], minlength=CELLS)


def followed(c: Classes, counts: np.ndarray) -> Classes:
    """``c`` with the logarithms that ``counts`` of ``pairs`` give; cells without an id are never met."""
    n = counts.reshape(c.n_inputs, CLASSES, SLOTS).astype(np.float64)
    used = np.zeros((CLASSES, SLOTS), bool)
    used[c.group, c.slot] = True
    every = n.sum(0) + 0.01 * used
    slots = every / np.maximum(every.sum(1, keepdims=True), 1e-30)
    kinds = every.sum(1) / max(every.sum(), 1e-30)
    by_kind = n.sum(2)
    with np.errstate(divide="ignore"):
        top = np.log((by_kind + SMOOTH * kinds) / (by_kind.sum(1, keepdims=True) + SMOOTH))
        leaf = np.log((n + SMOOTH * slots) / (by_kind[:, :, None] + SMOOTH))
    none = lambda x: np.concatenate([np.maximum(x, NEVER), np.zeros((1, *x.shape[1:]))]).astype(np.float32)
    return replace(c, top=none(top), leaf=none(leaf))


def arranged(counts: np.ndarray, beside: np.ndarray, seed: int = 3) -> Classes:
    """From counts of ids, the end last, and their ``neighbours``: ids whose left neighbours are alike share a class.

    The commonest ids come first and fill the slots of the class that suits them best.
    """
    end = len(counts) - 1
    rank, known = _ranked(counts)
    group, slot = np.arange(end + 1) % CLASSES, np.full(end + 1, SLOTS - 1)
    if len(known) > 2 * CLASSES:
        x = beside.reshape(-1, LEFT).astype(np.float64)
        x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
        random = np.random.default_rng(seed)
        main = x[: CLASSES * SLOTS]
        centres = main[random.choice(len(main), CLASSES, replace=False)]
        for _ in range(10):
            best = (main @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, best, main)
            size = np.bincount(best, minlength=CLASSES)[:, None]
            centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
        liking = np.argsort(-(x @ centres.T - 0.5 * (centres**2).sum(1)), 1)
        used = np.zeros(CLASSES, np.int64)
        for i, likes in zip(known, liking, strict=True):
            room = likes[used[likes] < SLOTS - 1]
            group[i] = room[0] if len(room) else likes[0]
            slot[i] = used[group[i]] if len(room) else SLOTS - 1
            used[group[i]] += len(room) > 0
    smooth = np.where(slot < SLOTS - 1, 1.0, counts + 0.1)
    shared = group * SLOTS + slot
    within = np.log(smooth / np.bincount(shared, smooth, CLASSES * SLOTS)[shared])
    inputs = np.where(rank < INPUT_IDS, rank, INPUT_IDS + group)
    none = np.zeros(0, np.float32)
    return Classes(inputs.astype(np.int32), group.astype(np.int32), slot.astype(np.int32), within.astype(np.float32), end, none, none)


def windows(texts: list[np.ndarray], c: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs (window, WINDOW), ids to be scored (window, STRIDE), text of each window); -1 where there is nothing.

    Each text lies in a flat row of whole strides, so that windows are views of it. A
    text's first input is the end of the one before.
    """
    sizes = np.array([len(x) + 1 for x in texts], np.int64)  # the end is scored, too
    many = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(texts)), many)
    begins = (np.cumsum(many) - many) * STRIDE
    place = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    targets = np.full(len(text) * STRIDE, -1, np.int32)
    targets[place] = np.concatenate([np.append(x, c.end) for x in texts]).astype(np.int32)
    inputs = np.full(len(text) * STRIDE, -1, np.int32)
    inputs[place[1:]] = c.inputs[targets[place[:-1]]]
    inputs[begins] = c.inputs[c.end]
    padded = np.concatenate([np.full(WINDOW - STRIDE, -1, np.int32), inputs])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE].copy()
    out[begins // STRIDE, : WINDOW - STRIDE] = -1  # not the text before
    return out, targets.reshape(-1, STRIDE), text


_ROWS, _COLUMNS = np.arange(STRIDE)[:, None] + WINDOW - STRIDE, np.arange(WINDOW)[None, :]
_DISTANCE = np.clip(_ROWS - _COLUMNS, 0, WINDOW - 1)
_FUTURE = np.where(_COLUMNS > _ROWS, np.float32(-1e9), np.float32(0))
_NAMES = ("embed", "query", "key", "value", "out", "shift", "up", "down", "top", "leaf", "bias")


def _chosen(logits: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """log softmax of ``logits`` at ``choice``; they are bounded, as what the output sees has unit mean square."""
    out = logits[np.arange(len(choice)), choice]
    np.exp(logits, out=logits)
    return out - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def _errors(logits: np.ndarray, choice: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """(gradient at the logits, in their place, loss) of a softmax over rows of some weight; finite, whatever the logits."""
    if len(logits) and logits.max() > 60:
        logits -= logits.max(1, keepdims=True)
    at = np.arange(0, logits.size, logits.shape[1]) + choice
    flat = logits.reshape(-1)
    own = flat[at]
    np.exp(logits, out=logits)
    total = np.maximum(logits @ np.ones(logits.shape[1], logits.dtype), logits.dtype.type(1e-30))
    logits *= (weight / total)[:, None]
    flat[at] -= weight
    return logits, float(((np.log(total) - own) * weight).sum(dtype=np.float64))


def _by_class(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows by class, where each class begins)."""
    order = np.argsort(group.astype(np.int16), kind="stable")  # 16 bits: a radix sort
    return order, np.concatenate([[0], np.cumsum(np.bincount(group, minlength=CLASSES))])


def _crossed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y`` of few columns and many rows, PART rows at a time, which is faster."""
    whole = len(x) // PART * PART
    out = x[whole:].T @ y[whole:]
    out += (x[:whole].reshape(-1, PART, x.shape[1]).transpose(0, 2, 1) @ y[:whole].reshape(-1, PART, y.shape[1])).sum(0)
    return out


def _by_input(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``x`` by their inputs ``at``, below ``n``."""
    order = np.argsort(at.astype(np.int16), kind="stable")  # 16 bits: a radix sort
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out = np.zeros((n, x.shape[1]), x.dtype)
    out[at[first]] = np.add.reduceat(np.take(x, order, axis=0, mode="clip"), first, axis=0)
    return out


class Model:
    """Parameters by name, and the passes through them."""

    def __init__(self, c: Classes, seed: int = 9):
        random = np.random.default_rng(seed)
        draw = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.classes = c
        self.embed = (random.standard_normal((c.n_inputs + 1, WIDTH)) * 0.3).astype(np.float32)  # the last: nothing
        self.query, self.key, self.value, self.out, self.shift = (draw(WIDTH, WIDTH) for _ in range(5))
        self.up, self.down = draw(WIDTH + 1, HIDDEN), draw(HIDDEN, WIDTH)
        self.top = np.zeros((WIDTH + 1, CLASSES), np.float32)  # at first, what follows is all that counts
        self.leaf = np.zeros((CLASSES, WIDTH + 1, SLOTS), np.float32)
        self.bias = (-0.1 * np.arange(WINDOW)).astype(np.float32)

    def forward(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for windows of ``inputs``; ``shown`` (window * STRIDE, WIDTH + 1) is what the output sees."""
        n = len(inputs)
        h = self.embed[inputs]  # -1 is the last row
        last = h[:, WINDOW - STRIDE :]
        flat = np.ascontiguousarray(last).reshape(-1, WIDTH)
        before = np.ascontiguousarray(h[:, WINDOW - STRIDE - 1 : -1]).reshape(-1, WIDTH)
        q = (flat @ (self.query / np.float32(np.sqrt(WIDTH)))).reshape(n, STRIDE, WIDTH)
        all_flat = h.reshape(-1, WIDTH)
        k, v = (all_flat @ self.key).reshape(n, WINDOW, WIDTH), (all_flat @ self.value).reshape(n, WINDOW, WIDTH)
        a = q @ k.transpose(0, 2, 1)
        a += self.bias[_DISTANCE] + _FUTURE
        if (inputs < 0).any():
            a += np.where(inputs < 0, np.float32(-1e9), np.float32(0))[:, None, :]
        np.minimum(a, np.float32(60), out=a)
        np.exp(a, out=a)
        total = (a @ np.ones(WINDOW, a.dtype))[:, :, None]
        z = a @ v
        z /= total
        z = z.reshape(-1, WIDTH)
        mid = np.empty((len(flat), WIDTH + 1), np.float32)
        mixed = z @ self.out
        mixed += before @ self.shift
        np.add(mixed, flat, out=mid[:, :WIDTH])
        mid[:, WIDTH] = 1
        up = mid @ self.up
        np.maximum(up, 0, out=up)
        top = up @ self.down
        top += mid[:, :WIDTH]
        norm = 1 / np.sqrt(np.einsum("ij,ij->i", top, top) / np.float32(WIDTH) + np.float32(1e-5))[:, None]
        shown = np.empty_like(mid)
        np.multiply(top, norm, out=shown[:, :WIDTH])
        shown[:, WIDTH] = 1
        return {"h": h, "flat": flat, "before": before, "q": q, "k": k, "v": v, "a": a, "total": total, "z": z, "mid": mid, "up": up, "norm": norm, "shown": shown}

    def shown(self) -> Callable[[np.ndarray], np.ndarray]:
        """What ``forward`` calls ``shown``, from tables: of each input's products with the layers up to the attention,
        and of the weight that each input gives to each other one, before that of their distance.

        A column of ones beside the values sums up the weights, and then is the bias' input.
        """
        n = len(self.embed)
        wide = lambda x, last: np.concatenate([x, np.full((n, 1), last, np.float32)], 1)
        own, before, value = wide(self.embed, 0), wide(self.embed @ self.shift, 0), wide(self.embed @ self.value @ self.out, 1)
        pair = (self.embed @ (self.query / np.float32(np.sqrt(WIDTH)))) @ (self.embed @ self.key).T
        pair = np.exp(np.clip(pair, np.float32(-60), np.float32(60)))
        pair[:, -1] = 0  # nothing is there
        near = np.exp(np.minimum(self.bias[_DISTANCE] + _FUTURE, np.float32(20)))
        pair, rows = np.ascontiguousarray(pair).ravel(), lambda x, at: np.take(x, at, axis=0, mode="clip")

        def run(inputs: np.ndarray) -> np.ndarray:
            at = np.where(inputs < 0, n - 1, inputs).astype(np.int64)
            last = at[:, WINDOW - STRIDE :]
            a = rows(pair, (last * n)[:, :, None] + at[:, None, :])
            a *= near
            z = a @ rows(value, at)
            z *= 1 / z[:, :, WIDTH:]
            z += rows(own, last)
            z += rows(before, at[:, WINDOW - STRIDE - 1 : -1])
            mid = z.reshape(-1, WIDTH + 1)
            up = mid @ self.up
            np.maximum(up, 0, out=up)
            top = up @ self.down
            top += mid[:, :WIDTH]
            norm = 1 / np.sqrt(np.einsum("ij,ij->i", top, top) / np.float32(WIDTH) + np.float32(1e-5))
            top *= norm[:, None]
            return top

        return run

    def each(self, texts: list[np.ndarray]) -> np.ndarray:
        """log of the probability of each id of each text and of its end, after those before it, in a row."""
        if not texts:
            return np.zeros(0, np.float32)
        run = self.shown()
        c = self.classes
        inputs, targets, _ = windows(texts, c)
        logp = np.empty(targets.size, np.float32)
        top, leaf = c.top + self.top[WIDTH], c.leaf + self.leaf[:, WIDTH]
        leaf = leaf.reshape(-1, SLOTS)
        group, slot = c.group[targets].ravel(), c.slot[targets].ravel()
        rows = lambda x, at: np.take(x, at, axis=0, mode="clip")
        for low in range(0, len(inputs), OUTPUTS * TOGETHER):
            own = inputs[low : low + OUTPUTS * TOGETHER]
            shown = np.concatenate([run(own[k : k + TOGETHER]) for k in range(0, len(own), TOGETHER)])
            order, bounds = _by_class(group[low * STRIDE : low * STRIDE + len(shown)])
            before = rows(own[:, WINDOW - STRIDE :].ravel().astype(np.int64), order)
            before[before < 0] = len(top) - 1
            shown, order = rows(shown, order), order + low * STRIDE  # by class, so that each is a slice
            logits = np.empty((len(shown), SLOTS), np.float32)
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if a < b:
                    np.matmul(shown[a:b], self.leaf[k, :WIDTH], out=logits[a:b])
            classes_, slots = group[order], slot[order]
            logits += rows(leaf, before * CLASSES + classes_)
            tops = shown @ self.top[:WIDTH]
            tops += rows(top, before)
            logp[order] = _chosen(tops, classes_) + _chosen(logits, slots)
        logp += c.within[targets].ravel()
        return logp[targets.ravel() >= 0]

    def log_probabilities(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of each text's probability: its ids, then the end."""
        text = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in texts])
        return np.bincount(text, self.each(texts).astype(np.float64), len(texts)) / np.log(10)

    def numbers(self) -> np.ndarray:
        """All parameters in a row."""
        return np.concatenate([getattr(self, k).ravel() for k in _NAMES]).astype(np.float64)

    def put(self, numbers: np.ndarray) -> None:
        """Sets all parameters to a row of ``numbers``."""
        for k in _NAMES:
            own = getattr(self, k)
            own[...] = numbers[: own.size].reshape(own.shape)
            numbers = numbers[own.size :]

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss, gradient by name) of windows; targets are ids, -1 where there is none.

        As many windows as stay in a core's cache go through the layers at a time, there and back.
        What an input alone decides is a table of all inputs, where places look their rows up.
        """
        c, n, kind = self.classes, len(self.embed), self.embed.dtype
        g = {k: np.zeros_like(getattr(self, k)) for k in _NAMES}
        ids, holes = targets.ravel(), (inputs < 0).any(1)
        at = np.where(inputs < 0, n - 1, inputs).astype(np.int64)
        weight = (ids >= 0).astype(kind) / kind.type(max(int((ids >= 0).sum()), 1))
        root, none = kind.type(1 / np.sqrt(WIDTH)), np.zeros((n, 1), kind)
        query, key, own_wide = self.embed @ (self.query * root), self.embed @ self.key, np.concatenate([self.embed, none], 1)
        mixed = np.concatenate([self.embed @ self.value @ self.out, none + 1], 1)
        before_wide = np.concatenate([self.embed @ self.shift, none], 1)
        near = np.exp(np.minimum(self.bias[_DISTANCE] + _FUTURE, kind.type(20)))
        rows = lambda x, at: np.take(x, at, axis=0, mode="clip")
        turned = lambda x: np.ascontiguousarray(x.transpose(0, 2, 1))  # noqa: E731  # a copy costs less than a product with what isn't
        spans = [(k, slice(k * STRIDE, (k + TOGETHER) * STRIDE)) for k in range(0, len(inputs), TOGETHER)]
        shown, layers = np.ones((len(ids), WIDTH + 1), kind), []
        zeros = np.zeros((TOGETHER * STRIDE, HIDDEN), kind)
        for low, own in spans:
            seen = at[low : low + TOGETHER]
            last = seen[:, WINDOW - STRIDE :]
            q, k, v = rows(query, last), rows(key, seen), rows(mixed, seen)
            a = q @ turned(k)
            if a.max() > 60:
                np.minimum(a, kind.type(60), out=a)
            np.exp(a, out=a)
            a *= near
            for w in np.flatnonzero(holes[low : low + TOGETHER]):
                a[w][:, seen[w] == n - 1] = 0
            z = (a @ v).reshape(-1, WIDTH + 1)
            share = 1 / np.maximum(z[:, WIDTH:], kind.type(1e-30))  # of a weight of one in their sum
            z *= share
            mid = rows(own_wide, last).reshape(-1, WIDTH + 1)
            mid += z
            mid += rows(before_wide, seen[:, WINDOW - STRIDE - 1 : -1]).reshape(-1, WIDTH + 1)
            mid[:, WIDTH] = 1
            up = mid @ self.up
            np.maximum(up, zeros[: len(up)], out=up)  # faster than with a number
            top = up @ self.down
            top += mid[:, :WIDTH]
            norm = 1 / np.sqrt(np.einsum("ij,ij->i", top, top) / kind.type(WIDTH) + kind.type(1e-5))[:, None]
            np.multiply(top, norm, out=shown[own, :WIDTH])
            layers.append((q, k, v, a, share, z, mid, up, norm))

        group, slot = c.group[ids], c.slot[ids]
        order, bounds = _by_class(group)
        given = inputs[:, WINDOW - STRIDE :].ravel()[order].astype(np.int64)
        given[given < 0] = len(c.top) - 1
        group, slot, sorted_, weight = group[order], slot[order], rows(shown, order), weight[order]  # by class, so that each is a slice
        logits = sorted_ @ self.top
        logits += rows(c.top, given)
        p, loss = _errors(logits, group, weight)
        g["top"], d_sorted = _crossed(sorted_, p), p @ self.top.T
        logits = rows(c.leaf.reshape(-1, SLOTS), given * CLASSES + group).astype(kind, copy=False)
        slices = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]
        for k, own in slices:
            logits[own] += sorted_[own] @ self.leaf[k]
        p, more = _errors(logits, slot, weight)
        for k, own in slices:
            g["leaf"][k] = sorted_[own].T @ p[own]
            d_sorted[own] += p[own] @ self.leaf[k].T
        d_shown = np.empty((len(ids), WIDTH), kind)
        d_shown[order] = d_sorted[:, :WIDTH]

        # at each place of a window: as a query, as the one before the next, as a key, as a value
        roles, to_all = np.concatenate([self.query * root, self.shift, self.key, self.value @ self.out], 1), np.zeros((TOGETHER, WINDOW, 4 * WIDTH), kind)
        d_near, d_roles, d_inputs = np.zeros_like(near), np.zeros_like(roles), np.empty((*at.shape, WIDTH), kind)
        for (low, own), (q, k, v, a, share, z, mid, up, norm) in zip(spans, layers, strict=True):
            d_top = shown[own, :WIDTH] * (np.einsum("ij,ij->i", d_shown[own], shown[own, :WIDTH]) / kind.type(WIDTH))[:, None]
            np.subtract(d_shown[own], d_top, out=d_top)
            d_top *= norm
            g["down"] += _crossed(up, d_top)
            d_up = d_top @ self.down.T
            d_up *= up > 0
            g["up"] += _crossed(mid, d_up)
            d_mid = d_up @ self.up[:WIDTH].T
            d_mid += d_top
            d_z = np.empty_like(z)  # beside it what it takes off each weight
            np.multiply(d_mid, share, out=d_z[:, :WIDTH])
            np.negative(np.einsum("ij,ij->i", d_z[:, :WIDTH], z[:, :WIDTH]), out=d_z[:, WIDTH])
            d_z = d_z.reshape(-1, STRIDE, WIDTH + 1)
            d_a = d_z @ turned(v)
            d_a *= a
            d_near += d_a.sum(0)
            d_mid = d_mid.reshape(-1, STRIDE, WIDTH)
            to = to_all[: len(d_mid)]
            np.matmul(d_a, k, out=to[:, WINDOW - STRIDE :, :WIDTH])
            to[:, WINDOW - STRIDE - 1 : -1, WIDTH : 2 * WIDTH] = d_mid
            np.matmul(d_a.transpose(0, 2, 1), q, out=to[:, :, 2 * WIDTH : 3 * WIDTH])
            np.matmul(a.transpose(0, 2, 1), d_z[:, :, :WIDTH], out=to[:, :, 3 * WIDTH :])
            seen, to = at[low : low + TOGETHER], to.reshape(-1, 4 * WIDTH)
            d_roles += _crossed(rows(self.embed, seen).reshape(-1, WIDTH), to)
            d_h = d_inputs[low : low + TOGETHER]
            np.matmul(to, roles.T, out=d_h.reshape(-1, WIDTH))
            d_h[:, WINDOW - STRIDE :] += d_mid
        d_query, g["shift"], g["key"], d_mixed = np.split(d_roles, 4, 1)
        g["query"], g["value"], g["out"] = d_query * root, d_mixed @ self.out.T, self.value.T @ d_mixed
        g["embed"] = _by_input(at.ravel(), d_inputs.reshape(-1, WIDTH), n)
        g["bias"] = np.bincount(_DISTANCE.ravel(), d_near.ravel(), WINDOW).astype(kind)
        return loss + more, g


def _fit(model: Model, inputs: np.ndarray, targets: np.ndarray, batches: list[np.ndarray], rate: float) -> None:
    """Adam on batches of windows, with a rate that falls to nothing."""
    means = {k: np.zeros_like(getattr(model, k)) for k in _NAMES}
    spreads = {k: np.zeros_like(getattr(model, k)) for k in _NAMES}
    for s, rows in enumerate(batches, 1):
        _, g = model.gradients(inputs[rows], targets[rows])
        now = rate * min(1.0, s / 30) * (1 - s / (len(batches) + 1))
        for k in _NAMES:
            means[k] += 0.1 * (g[k] - means[k])
            spreads[k] += 0.01 * (g[k] ** 2 - spreads[k])
            step = now * (means[k] / (1 - 0.9**s)) / (np.sqrt(spreads[k] / (1 - 0.99**s)) + 1e-8)
            getattr(model, k)[...] -= step.astype(np.float32)


def trained(texts: list[np.ndarray], c: Classes, steps: int = 2000, batch: int = 192, rate: float = 0.02, seed: int = 17) -> Model:
    """A model of ``c`` fitted on random windows of ``texts``."""
    model = Model(c)
    if not texts:
        return model
    random = np.random.default_rng(seed)
    inputs, targets, _ = windows(texts, model.classes)
    _fit(model, inputs, targets, [random.integers(0, len(inputs), batch) for _ in range(steps)], rate)
    return model


def passed(model: Model, texts: list[np.ndarray], batch: int = 384, rate: float = 0.02, seed: int = 17) -> None:
    """Fits ``model`` further: one pass over all windows of ``texts``, in a random order."""
    inputs, targets, _ = windows(texts, model.classes)
    order = np.random.default_rng(seed).permutation(len(inputs))
    _fit(model, inputs, targets, [order[k : k + batch] for k in range(0, len(order), batch)], rate)
