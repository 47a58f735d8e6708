"""A small gated recurrent language model in numpy.

Words are numbered by falling frequency. The first HEAD words stand in classes of equal
size; the output is the probability of the class given the state, times that of the word
among its class given the state. Less frequent words stand in tail classes, inside which
their shares are fixed; the last class is that of all words without a number. Training is
by truncated backpropagation over windows; the state goes on from window to window and
starts anew with each document, and in training with each segment of a very long one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN, EMBED = 16, 16
CLASS, HEAD_CLASSES, TAIL_CLASSES = 48, 48, 16
HEAD = CLASS * HEAD_CLASSES
#: Tokens of a window, and texts that are trained on and scored side by side.
WINDOW, LANES, SIDE = 32, 512, 2_048
#: Training texts beyond so many tokens are dealt to lanes in segments.
SEGMENT = 2_048
#: Tokens whose outputs are worked out at once, and the rows of one block of them.
HELD, CHUNK = 65_536, 4_096
_LOG10 = np.log(10.0)


@dataclass
class Layout:
    """Where the numbered words stand. ``counts``: how often each occurs; ``rest``: how often all others do."""

    counts: np.ndarray
    rest: float

    def __post_init__(self) -> None:
        n = len(self.counts)
        ids = np.arange(n)
        tail = np.clip(np.log2(np.maximum(ids, HEAD) / HEAD) * TAIL_CLASSES / 6, 0, TAIL_CLASSES - 1).astype(np.int64)
        self.word_class = np.append(np.where(ids < HEAD, ids // CLASS, HEAD_CLASSES + tail), HEAD_CLASSES + TAIL_CLASSES)  # -1: all others
        self.classes = HEAD_CLASSES + TAIL_CLASSES + 1
        self.head = min(n, HEAD)
        weight = np.append(self.counts, self.rest).astype(float)
        mass = np.bincount(self.word_class, weight, self.classes)
        self.class_bias = np.where(np.bincount(self.word_class, minlength=self.classes) > 0, np.log((mass + 0.5) / (mass.sum() + 0.5 * self.classes)), -60.0)
        share = np.log(np.maximum(weight, 1e-9) / np.maximum(mass[self.word_class], 1e-9))
        self.inside = np.append(np.where(ids < HEAD, 0.0, share[:-1]), 0.0)  # fixed shares of the tail, by word
        self.word_bias = np.full(HEAD, -60.0)
        self.word_bias[: self.head] = share[: self.head]
        self.input = np.append(np.where(ids < HEAD, ids, HEAD + tail), HEAD + TAIL_CLASSES)  # row of the input table


def start_weights(layout: Layout, seed: int = 7) -> dict[str, np.ndarray]:
    """Biases hold the frequencies of the whole corpus, so an untrained model scores by them."""
    rng = np.random.default_rng(seed)
    w = {
        "emb": rng.normal(0, 0.3, (HEAD + TAIL_CLASSES + 1, EMBED)),
        "w": rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN)),
        "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)),
        "b": np.concatenate([np.full(HIDDEN, 1.0), np.zeros(2 * HIDDEN)]),
        "cw": np.zeros((layout.classes, HIDDEN)),
        "cb": layout.class_bias,
        "ow": np.zeros((HEAD, HIDDEN)),
        "ob": layout.word_bias,
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _next_state(u: np.ndarray, a: np.ndarray, h: np.ndarray) -> None:
    """One step for rows with input ``a`` (already through "w" and "b", used up); ``h`` becomes the new state."""
    n, v = HIDDEN, h @ u
    zr = a[:, : 2 * n]
    zr += v[:, : 2 * n]
    _sigmoid(zr)
    c = v[:, 2 * n :]
    c *= zr[:, n:]
    c += a[:, 2 * n :]
    np.tanh(c, out=c)
    h -= c
    h *= zr[:, :n]
    h += c


def _step(w: dict[str, np.ndarray], a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The new state, and the update gate, reset gate, recurrent input and candidate that it came from."""
    n, v = HIDDEN, h @ w["u"]
    zr = _sigmoid(a[:, : 2 * n] + v[:, : 2 * n])
    z, r, g = zr[:, :n], zr[:, n:], v[:, 2 * n :]
    c = np.tanh(a[:, 2 * n :] + r * g)
    return c + z * (h - c), z, r, g, c


def _by_class(layout: Layout, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The places in ``target`` (ids) that ask for a word of a head class, class by class, and where each class stands there."""
    cls = layout.word_class[target]
    head = np.flatnonzero(cls < HEAD_CLASSES)
    order = head[np.argsort(cls[head].astype(np.uint8), kind="stable")]
    bounds = np.searchsorted(cls[order], np.arange(HEAD_CLASSES + 1))
    return order, [(c, slice(bounds[c], bounds[c + 1])) for c in range(HEAD_CLASSES) if bounds[c] < bounds[c + 1]]


def _picked_log_softmax(x: np.ndarray, place: np.ndarray, small: bool) -> np.ndarray:
    """The log-softmax of rows at one place each; ``x`` is overwritten. ``small``: no entry can overflow exp."""
    if not small:
        x -= x.max(1, keepdims=True)
    picked = x[np.arange(len(x)), place]
    np.exp(x, out=x)
    return picked - np.log(x.sum(1))


def _loss_slope(x: np.ndarray, place: np.ndarray, scale: np.float32) -> float:
    """The summed negative log-softmax of rows at one place each; ``x`` becomes its slope times ``scale``."""
    x -= x.max(1, keepdims=True)
    rows = np.arange(len(x))
    picked = x[rows, place]
    np.exp(x, out=x)
    total = x.sum(1)
    x *= (scale / total)[:, None]
    x[rows, place] -= scale
    return float(np.log(total).sum() - picked.sum())


def output_log10(w: dict[str, np.ndarray], layout: Layout, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 of the probability of each target id (-1: any word without a number) given its state."""
    out, cls = layout.inside[target], layout.word_class[target]
    small = all(np.abs(w[k]).sum(1).max() + w[b].max() < 80 for k, b in (("cw", "cb"), ("ow", "ob")))
    for i in range(0, len(target), CHUNK):
        x = h[i : i + CHUNK] @ w["cw"].T
        x += w["cb"]
        out[i : i + CHUNK] += _picked_log_softmax(x, cls[i : i + CHUNK], small)
    order, classes = _by_class(layout, target)
    states, place, inner = h[order], target[order], np.empty(len(order))
    for c, at in classes:
        own = slice(c * CLASS, (c + 1) * CLASS)
        x = states[at] @ w["ow"][own].T
        x += w["ob"][own]
        inner[at] = _picked_log_softmax(x, place[at] - c * CLASS, small)
    out[order] += inner
    return out / _LOG10


def score(w: dict[str, np.ndarray], layout: Layout, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document (ids with the end last). Documents run side by side, the longest
    first, and leave as they end; their states go on over all windows."""
    total = np.zeros(len(docs))
    every = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    table = (w["emb"] @ w["w"] + w["b"]).astype(np.float32)
    states, targets, owners, held = [], [], [], 0

    def settle() -> None:
        nonlocal held
        if held:
            who = np.concatenate(owners)
            np.add(total, np.bincount(who, output_log10(w, layout, np.concatenate(states), np.concatenate(targets)), len(docs)), out=total)
            for x in (states, targets, owners):
                x.clear()
            held = 0

    for first in range(0, len(every), SIDE):
        order = np.array(every[first : first + SIDE])
        lengths = np.array([len(docs[i]) for i in order])
        begin = np.cumsum(lengths) - lengths
        flat = np.concatenate([docs[i] for i in order])
        if not len(flat):
            continue
        last, h = np.full(len(order), layout.input[flat[lengths[0] - 1]]), np.zeros((len(order), HIDDEN), np.float32)
        for at in range(0, int(lengths[0]), WINDOW):
            live = np.searchsorted(-lengths, -np.arange(at, min(at + WINDOW, int(lengths[0]))), side="left")
            for t, m in enumerate(live.tolist(), at):
                _next_state(w["u"], table[last[:m]], h[:m])
                ids = flat[begin[:m] + t]
                states.append(h[:m].copy())
                targets.append(ids)
                owners.append(order[:m])
                held += m
                last[:m] = layout.input[ids]
            if held >= HELD:
                settle()
    settle()
    return total


class Trainer:
    """Adam on the mean negative log-likelihood of windows."""

    def __init__(self, w: dict[str, np.ndarray], layout: Layout, rate: float):
        self.w, self.layout, self.rate, self.steps = {k: v.copy() for k, v in w.items()}, layout, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}

    def window(self, inputs: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """One step on (lanes, width) arrays: rows of the input table, ids to predict (-2: nothing), and whether a
        document begins. Gradients stop at the window's start; returns the state after it and the mean loss."""
        w, lay, (lanes, width), n = self.w, self.layout, inputs.shape, HIDDEN
        rows = inputs.T.reshape(-1)  # time by time, as all that follows
        x = w["emb"][rows]
        a = (x @ w["w"] + w["b"]).reshape(width, lanes, 3 * n)
        keep = (~fresh.T[:, :, None]).astype(np.float32)
        before, hs = np.empty((width, lanes, n), np.float32), np.empty((width, lanes, n), np.float32)
        kept = []
        for t in range(width):
            np.multiply(h, keep[t], out=before[t])
            h, *gates = _step(w, a[t], before[t])
            kept.append(gates)
            hs[t] = h
        want = target.T.reshape(-1)
        live = np.flatnonzero(want > -2)
        flat, want = hs.reshape(-1, n)[live], want[live]
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        scale = np.float32(1 / max(len(want), 1))
        dflat, loss = np.empty_like(flat), 0.0
        cls = lay.word_class[want]
        for i in range(0, len(want), CHUNK):
            own, part = flat[i : i + CHUNK], slice(i, i + CHUNK)
            d = own @ w["cw"].T
            d += w["cb"]
            loss += _loss_slope(d, cls[part], scale)
            grad["cw"] += d.T @ own
            grad["cb"] += d.sum(0)
            dflat[part] = d @ w["cw"]
        order, classes = _by_class(lay, want)
        states, place, dstates = flat[order], want[order], np.empty((len(order), n), np.float32)
        for c, at in classes:
            own = slice(c * CLASS, (c + 1) * CLASS)
            d = states[at] @ w["ow"][own].T
            d += w["ob"][own]
            loss += _loss_slope(d, place[at] - c * CLASS, scale)
            grad["ow"][own], grad["ob"][own] = d.T @ states[at], d.sum(0)
            dstates[at] = d @ w["ow"][own]
        dflat[order] += dstates
        dh_out = np.zeros((width * lanes, n), np.float32)
        dh_out[live] = dflat
        dh_out = dh_out.reshape(width, lanes, n)
        da, inner = np.empty((width, lanes, 3 * n), np.float32), np.empty((width, lanes, 3 * n), np.float32)
        dh, ut = np.zeros((lanes, n), np.float32), np.ascontiguousarray(w["u"].T)
        for t in range(width - 1, -1, -1):
            z, r, g, c = kept[t]
            dh += dh_out[t]
            dc = dh * (1 - z)
            dc *= 1 - c * c
            now = da[t]
            now[:, :n] = dh * (before[t] - c) * z * (1 - z)
            now[:, n : 2 * n] = dc * g * r * (1 - r)
            now[:, 2 * n :] = dc
            inner[t] = now
            inner[t][:, 2 * n :] *= r
            dh *= z
            dh += inner[t] @ ut
            dh *= keep[t]
        flat_da = da.reshape(-1, 3 * n)
        grad["u"] = before.reshape(-1, n).T @ inner.reshape(-1, 3 * n)
        grad["w"], grad["b"] = x.T @ flat_da, flat_da.sum(0)
        demb = flat_da @ w["w"].T
        by = np.argsort(rows.astype(np.uint16), kind="stable")
        firsts = np.flatnonzero(np.diff(rows[by], prepend=-1))
        grad["emb"][rows[by[firsts]]] = np.add.reduceat(demb[by], firsts)
        self._update(grad)
        return h, loss * float(scale)

    def _update(self, grad: dict[str, np.ndarray]) -> None:
        self.steps += 1
        norm = float(np.sqrt(sum(float(np.square(g).sum()) for g in grad.values())))
        clip = np.float32(min(1.0, 5.0 / max(norm, 1e-12)))
        b1, b2 = np.float32(0.9), np.float32(0.99)
        rate = np.float32(self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
        for k, g in grad.items():
            g = g * clip
            self.m[k] += (1 - b1) * (g - self.m[k])
            self.v[k] += (1 - b2) * (g * g - self.v[k])
            self.w[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-6))

    def epoch(self, docs: list[np.ndarray], end: int, lanes: int = LANES) -> float:
        """Deal whole documents (very long ones in segments) to lanes, the longest first and always to the shortest
        lane, and go over all windows. Memory goes with the tokens of ``docs``."""
        pieces = [(d[i : i + SEGMENT], d[i - 1] if i else end) for d in docs for i in range(0, len(d), SEGMENT)]
        dealt: list[list[tuple[np.ndarray, int]]] = [[] for _ in range(min(lanes, len(pieces)))]
        size = [(0, k) for k in range(len(dealt))]
        for p in sorted(pieces, key=lambda p: len(p[0]), reverse=True):
            n, k = size[0]
            dealt[k].append(p)
            heapq.heapreplace(size, (n + len(p[0]), k))
        width = max(n for n, _ in size) if size else 0
        target = np.full((len(dealt), width), -2, np.int32)
        previous, fresh = np.full((len(dealt), width), end, np.int32), np.zeros((len(dealt), width), bool)
        for k, own in enumerate(dealt):
            at = 0
            for d, first in own[:: 1 if k % 2 else -1]:
                target[k, at : at + len(d)] = d
                previous[k, at] = first
                previous[k, at + 1 : at + len(d)] = d[:-1]
                fresh[k, at] = True
                at += len(d)
        h, losses = np.zeros((len(dealt), HIDDEN), np.float32), []
        for t in range(0, width, WINDOW):
            own = slice(t, t + WINDOW)
            on = np.flatnonzero((target[:, own] > -2).any(1))
            state, loss = self.window(self.layout.input[previous[on, own]], target[on, own], fresh[on, own], h[on])
            h[on] = state
            losses.append(loss)
        return float(np.mean(losses)) if losses else 0.0
