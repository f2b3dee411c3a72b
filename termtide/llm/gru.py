"""A gated recurrent network over word ids with a class-factored softmax, in numpy."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN = 16
STEPS = 16
LANES = 256
CLIP = 1.0
# Scores before a softmax are held to this range, where no exponential overflows or vanishes.
RANGE = 60.0


def ordered(values: np.ndarray, n: int) -> np.ndarray:
    """Stable order of numbers below ``n``; numpy sorts short integers by radix."""
    return np.argsort(values.astype(np.uint16) if n <= 1 << 16 else values, kind="stable")


def log_softmax(scores: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of every row's ``own`` place in all of ``scores``, which become exponentials,
    and the reciprocal sums of the rows."""
    np.minimum(scores, RANGE, out=scores)
    np.maximum(scores, -RANGE, out=scores)
    mine = scores.take(own)
    np.exp(scores, out=scores)
    sums = scores @ np.ones(scores.shape[1], scores.dtype)
    return mine - np.log(sums), (1 / sums)[:, None]


def error(scores: np.ndarray, parts: np.ndarray, own: np.ndarray) -> None:
    """Turn exponentials into the gradient of the loss: probabilities, less one at ``own``."""
    scores *= parts
    scores.reshape(-1)[own] -= 1


class Layout:
    """Output classes. The ``words`` most frequent words have ids from 0, by frequency; runs
    of them are classes of about equal summed square root of the count. All other words are in
    ``tails`` further classes, whose ids follow and which predict the class only."""

    def __init__(self, counts: np.ndarray, tails: int, tail_counts: np.ndarray):
        self.words, self.tails = len(counts), tails
        n_classes = max(1, int(np.sqrt(self.words)))
        mass = np.cumsum(np.sqrt(counts + 1.0)) if self.words else np.zeros(0)
        cuts = np.searchsorted(mass, mass[-1] * np.arange(1, n_classes) / n_classes) if len(
            mass) else []
        self.starts = np.unique(np.concatenate([[0], cuts, [self.words]])).astype(np.int64)
        self.word_classes = len(self.starts) - 1
        self.classes = self.word_classes + tails
        self.class_of = np.concatenate([
            np.searchsorted(self.starts, np.arange(self.words), "right") - 1,
            self.word_classes + np.arange(tails)]).astype(np.int64)
        sums = np.add.reduceat(counts + 1.0, self.starts[:-1]) if self.word_classes else np.zeros(0)
        every = np.concatenate([sums, tail_counts + 1.0])
        # Shares, of all and within a class.
        self.log_word = np.log((counts + 1.0) / np.repeat(sums, np.diff(self.starts))).astype(
            np.float32) if self.word_classes else np.zeros(0, np.float32)
        self.log_class = np.log(every / every.sum()).astype(np.float32)


class Model:
    """Parameters; at the start the network predicts the plain frequencies."""

    NAMES = ("inputs", "recurrent", "class_weights", "class_bias", "word_weights", "word_bias")

    def __init__(self, layout: Layout, seed: int = 7):
        random, h = np.random.default_rng(seed), HIDDEN
        ids = layout.words + layout.tails
        self.layout = layout
        self.p = {
            "inputs": random.normal(0, 0.3, (ids, 3 * h)),
            "recurrent": random.normal(0, 0.5 / np.sqrt(h), (h, 3 * h)),
            "class_weights": np.zeros((h, layout.classes)), "class_bias": layout.log_class,
            "word_weights": np.zeros((layout.words, h)), "word_bias": layout.log_word}
        self.p = {k: np.array(v, np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            size = self.p[k].size
            self.p[k] = values[at:at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size

    def step(self, inputs: np.ndarray, h: np.ndarray) -> tuple:
        """New state, gates and the recurrent part of the candidate."""
        size = HIDDEN
        rec = h @ self.p["recurrent"]
        gates = inputs[:, :2 * size] + rec[:, :2 * size]
        gates *= 0.5  # the logistic function by tanh, which cannot overflow
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        r, z = gates[:, :size], gates[:, size:]
        n = np.tanh(inputs[:, 2 * size:] + r * rec[:, 2 * size:])
        return n + z * (h - n), r, z, n, rec[:, 2 * size:]

    def outputs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log probability of every target (for tails: of its class), and with
        ``grads``, into which parameter gradients are added, the gradient of the states."""
        p, layout = self.p, self.layout
        order = ordered(layout.class_of[targets], layout.classes)
        targets, h = targets[order], states.take(order, 0)
        classes = layout.class_of[targets]
        logits = h @ p["class_weights"]
        logits += p["class_bias"]
        rows = np.arange(len(classes))
        own = rows * layout.classes + classes
        found, parts = log_softmax(logits, own)
        d_found = None
        if grads is not None:
            error(logits, parts, own)
            grads["class_weights"] += h.T @ logits
            grads["class_bias"] += logits.sum(axis=0)
            d_found = logits @ p["class_weights"].T
        edges = np.searchsorted(classes, np.arange(layout.word_classes + 1))
        for c in np.flatnonzero(np.diff(edges)):
            at = slice(edges[c], edges[c + 1])
            lo, hi = layout.starts[c], layout.starts[c + 1]
            weights = p["word_weights"][lo:hi]
            own = rows[:edges[c + 1] - edges[c]] * (hi - lo) + (targets[at] - lo)
            scores = h[at] @ weights.T
            scores += p["word_bias"][lo:hi]
            logp, parts = log_softmax(scores, own)
            found[at] += logp
            if grads is not None:
                error(scores, parts, own)
                grads["word_weights"][lo:hi] += scores.T @ h[at]
                grads["word_bias"][lo:hi] += scores.sum(axis=0)
                d_found[at] += scores @ weights
        logp = np.empty_like(found)
        logp[order] = found
        if grads is None:
            return logp, None
        d_states = np.empty_like(d_found)
        d_states[order] = d_found
        return logp, d_states

    def window(self, ids: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray,
               used: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean loss over one window (steps x lanes), truncated at its start, and
        the state after it. ``fresh`` marks lanes where a document starts, ``used`` real tokens."""
        p, size, steps = self.p, HIDDEN, len(ids)
        states, kept = [], []
        for t in range(steps):
            if fresh[t].any():
                h = np.where(fresh[t][:, None], np.float32(0), h)
            new = self.step(p["inputs"].take(ids[t], 0), h)
            kept.append((h, *new[1:]))
            h = new[0]
            states.append(h)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        every = np.concatenate(states)
        flat = used.ravel()
        if flat.all():
            _, d_every = self.outputs(every, targets.ravel(), grads)
        else:
            d_every = np.zeros_like(every)
            d_every[flat] = self.outputs(every[flat], targets.ravel()[flat], grads)[1]
        lanes = ids.shape[1]
        d_inputs = np.empty((steps, lanes, 3 * size), np.float32)
        d_h = np.zeros((lanes, size), np.float32)
        for t in reversed(range(steps)):
            before, r, z, n, rec = kept[t]
            d = d_h + d_every[t * lanes:(t + 1) * lanes]
            d_n = d * (1 - z) * (1 - n * n)
            d_in = d_inputs[t]
            d_in[:, :size] = d_n * rec * r * (1 - r)
            d_in[:, size:2 * size] = d * (before - n) * z * (1 - z)
            d_in[:, 2 * size:] = d_n
            d_rec = d_in.copy()
            d_rec[:, 2 * size:] *= r
            grads["recurrent"] += before.T @ d_rec
            d_h = d * z + d_rec @ p["recurrent"].T
            if fresh[t].any():
                d_h = np.where(fresh[t][:, None], np.float32(0), d_h)
        order = ordered(ids.ravel(), len(p["inputs"]))
        seen = ids.ravel()[order]
        first = np.flatnonzero(np.diff(seen, prepend=-1))
        by_id = np.ascontiguousarray(d_inputs.reshape(-1, 3 * size).take(order, 0).T)
        grads["inputs"][seen[first]] = np.add.reduceat(by_id, first, axis=1).T  # along the memory
        scale = 1 / max(1, int(flat.sum()))
        for g in grads.values():
            g *= scale
        return grads, h


class Adam:
    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def apply(self, grads: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = np.float32(min(1.0, CLIP / (norm + 1e-12)))
        rate = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grads.items():
            g *= scale
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            self.model.p[k] -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-8))


def lanes_of(docs: list[np.ndarray], end: int, lanes: int) -> tuple[np.ndarray, ...]:
    """Documents dealt out to lanes of about equal length, the longest first.

    Returns (inputs, targets, fresh, owner) of all tokens, lane after lane, and (base, filled): where
    every lane begins and how long it is. A document reads the end mark and its words and predicts
    its words and the end mark; owner is its number. The size is that of the documents, however
    long one of them is.
    """
    lengths = np.asarray([len(d) + 1 for d in docs], np.int64)
    lanes = max(1, min(lanes, len(docs)))
    dealt = [(0, lane) for lane in range(lanes)]
    lane_of, start_of = np.empty(len(docs), np.int64), np.empty(len(docs), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, lane = dealt[0]
        lane_of[i], start_of[i] = lane, size
        heapq.heapreplace(dealt, (size + int(lengths[i]), lane))
    filled = np.bincount(lane_of, weights=lengths, minlength=lanes).astype(np.int64)
    base = np.cumsum(filled) - filled
    total = int(filled.sum())
    inputs, targets = np.full(total, end, np.int32), np.full(total, end, np.int32)
    fresh, owner = np.zeros(total, bool), np.empty(total, np.int32)
    for i, doc in enumerate(docs):
        a = base[lane_of[i]] + start_of[i]
        b = a + lengths[i]
        inputs[a + 1:b] = doc
        targets[a:b - 1] = doc
        fresh[a] = True
        owner[a:b] = i
    return inputs, targets, fresh, owner, base, filled


def streams_of(docs: list[np.ndarray], end: int, lanes: int) -> tuple[np.ndarray, ...]:
    """Documents one after another, cut into lanes of equal length: (inputs, targets, fresh,
    used), steps x lanes. A document that runs over a cut goes on with a fresh state; for learning
    only, where full lanes matter more than the state at a few cuts."""
    n = sum(len(d) + 1 for d in docs)
    steps = -(-n // lanes)
    inputs = np.full(steps * lanes, end, np.int32)
    targets = np.full(steps * lanes, end, np.int32)
    fresh = np.zeros(steps * lanes, bool)
    at = 0
    for doc in docs:
        inputs[at + 1:at + 1 + len(doc)] = doc
        targets[at:at + len(doc)] = doc
        fresh[at] = True
        at += len(doc) + 1
    fresh[::steps] = True
    used = np.arange(steps * lanes) < n
    return tuple(np.ascontiguousarray(x.reshape(lanes, steps).T)
                 for x in (inputs, targets, fresh, used))


def train(model: Model, groups: Iterator[list[np.ndarray]], end: int, rate: float) -> int:
    """One pass over groups of documents; the number of tokens learned from."""
    adam, total = Adam(model, rate), 0
    for docs in groups:
        n = sum(len(d) + 1 for d in docs)
        inputs, targets, fresh, used = streams_of(
            docs, end, max(1, min(LANES, n // (4 * STEPS))))
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for t in range(0, len(inputs), STEPS):
            grads, h = model.window(*(x[t:t + STEPS] for x in (inputs, targets, fresh)), h,
                                    used[t:t + STEPS])
            adam.apply(grads)
        total += n
    return total


def score(model: Model, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of every whole document; the state is carried across windows."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    inputs, targets, fresh, owner, base, filled = lanes_of(docs, end, LANES)
    h = np.zeros((len(base), HIDDEN), np.float32)
    span, longest = 4 * STEPS, int(filled.max())
    for t0 in range(0, longest, span):
        live = filled > t0
        if not live.all():
            base, filled, h = base[live], filled[live], h[live]
        steps = t0 + np.arange(min(span, longest - t0))[:, None]
        real = (steps < filled).ravel()
        at = base + np.minimum(steps, filled - 1)  # an ended lane stays on its last token
        ids, begins = inputs[at], fresh[at]
        states = np.empty((*at.shape, HIDDEN), np.float32)
        for k in range(len(states)):
            if begins[k].any():
                h = np.where(begins[k][:, None], np.float32(0), h)
            h = model.step(model.p["inputs"].take(ids[k], 0), h)[0]
            states[k] = h
        used = at.ravel()[real]
        logp, _ = model.outputs(states.reshape(-1, HIDDEN)[real], targets[used])
        total += np.bincount(owner[used], weights=logp, minlength=len(docs))
    return total
