"""A small causal self-attention model over subword types, trained and run in numpy.

A text is a sequence of types of subword ids between closing ones. A window has ``2 * SPAN`` inputs: the first half is context
only (that of the window before), each input of the second half has its follower as target, so windows overlap by half and every token is
scored once, past a text's first window after ``SPAN`` tokens of context or more. Each target has a query of its own (``STEP`` is 1) that looks back over all
inputs up to the target: masked attention, all windows of a batch at once, then a hidden layer. It gives a value u for each class of types.

The probability of a target's class is in proportion to the corpus's frequency of the class after the target's own last type (``prior``) times a positive
link of u (near exp(u)), normalised exactly. So the last type enters each target directly, and what stands before it
through attention. ``lm_score`` has the types, the classes, and the shares of types in their class.
"""

from __future__ import annotations

import numpy as np

WIDTH, HIDDEN, SPAN, STEP, CLASSES = 16, 32, 32, 1, 128
QUERIES, BATCH = SPAN // STEP, 128
#: The link is (1 + u / 2**POWER) ** 2**POWER, close to exp(u) and far cheaper; below FLOOR the base is held.
POWER, FLOOR = 3, 0.05
#: Windows whose arrays are worked on together: few enough for the cache, enough to make good the calls.
FEW = 22
#: The exponents of attention are held at HIGH. Links at FLOOR have a share of a sum below 1e-9 / LEAST, unless the sum is below LEAST.
HIGH, LEAST = 60, 0.1
#: Inputs that each query may see.
_SEEN = np.arange(2 * SPAN)[None] <= SPAN + STEP * np.arange(QUERIES)[:, None]


def init(classes: int = CLASSES, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"query": (classes, WIDTH), "key": (classes, WIDTH), "value": (classes, WIDTH), "last": (classes, WIDTH), "place": (QUERIES, 2 * SPAN), "mix": (WIDTH, WIDTH), "up": (WIDTH, HIDDEN), "down": (HIDDEN, WIDTH), "out": (classes, WIDTH)}
    scale = {"query": 0.3, "key": 0.3, "value": 0.5, "last": 0.1, "place": 0.01, "out": 0.1}
    return {k: (rng.standard_normal(s) * scale.get(k, s[0] ** -0.5)).astype(np.float32) for k, s in shapes.items()}


def windows(types: np.ndarray, counts: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets (both -1 where there is none) and text number of the windows over texts of counts types each."""
    size = counts + 1  # targets: the types and the closing one
    room = size + 1 + 2 * SPAN  # nothing, the closing type, the types, the closing one, nothing
    begin = np.cumsum(room) - room
    flat = np.full(int(room.sum()), -1, np.int32)
    flat[np.arange(len(types)) + np.repeat(begin + SPAN + 1 - (np.cumsum(counts) - counts), counts)] = types
    flat[begin + SPAN] = flat[begin + SPAN + size] = closing
    n = -(-size // SPAN)
    text = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    rows = np.lib.stride_tricks.sliding_window_view(flat, 2 * SPAN + 1)[begin[text] + nth * SPAN] if len(text) else np.zeros((0, 2 * SPAN + 1), np.int32)
    return rows[:, :-1], rows[:, SPAN + 1 :], text


class _Tables:
    """Weights as the steps below take them, for n windows at a time. A last row is that of no input: it weighs nothing."""

    def __init__(self, p: dict, n: int):
        classes, kind = p["out"].shape[0], p["out"].dtype
        none = np.zeros((1, WIDTH), kind)
        self.p, self.classes = p, classes
        self.query = np.concatenate([p["query"] * kind.type(WIDTH**-0.5), none])
        self.key, self.last = np.concatenate([p["key"], none]), np.concatenate([p["last"], none])
        # A last column of values adds up the weights.
        self.value = np.ones((classes + 1, WIDTH + 1), kind)
        self.value[:-1, :-1], self.value[-1] = p["value"], 0
        self.mix = np.concatenate([p["mix"], none])
        self.place = p["place"].T.copy()
        self.held = np.abs(self.place).max() + np.sqrt(np.square(self.query).sum(1).max() * np.square(self.key).sum(1).max()) > HIGH
        if not self.held:
            self.place = np.exp(self.place)
            self.place *= _SEEN.T
        self.out = np.multiply(p["out"].T, kind.type(2.0**-POWER), order="C")
        self.nil, self.floor = np.zeros((n * QUERIES, HIDDEN), kind), np.full((n * QUERIES, classes), FLOOR, kind)
        self.one = np.ones(classes, kind)


def _links(t: _Tables, c: np.ndarray):
    """The links (targets, classes) of windows with inputs of classes c (t.classes: no input), and what the gradient needs."""
    p, last = t.p, c[:, SPAN::STEP]
    q, k, v = t.query.take(last, 0), t.key.take(c, 0), t.value.take(c, 0)
    a = k @ np.ascontiguousarray(q.transpose(0, 2, 1))  # inputs by queries
    if t.held:
        a += t.place
        np.exp(np.clip(a, -HIGH, HIGH), out=a)
        a *= _SEEN.T
    else:
        np.exp(a, out=a)
        a *= t.place
    o = (a.transpose(0, 2, 1) @ v).reshape(-1, WIDTH + 1)
    share = 1 / (o[:, WIDTH:] + 1e-30)
    o *= share
    h1 = t.last.take(last.ravel(), 0)
    h1 += o @ t.mix
    u = h1 @ p["up"]
    np.maximum(u, t.nil[: len(u)], out=u)
    h2 = u @ p["down"]
    h2 += h1
    base = h2 @ t.out
    base += 1
    np.maximum(base, t.floor[: len(base)], out=base)
    link = base * base
    for _ in range(POWER - 1):
        link *= link
    return link, (q, k, v, a, share, o, h1, u, h2, base)


def forward(p: dict, c: np.ndarray, live: np.ndarray):
    """The links (windows, QUERIES, classes) from the classes of inputs, and what the gradient needs. Windows don't touch each other."""
    link, rest = _links(_Tables(p, len(c)), np.where(live, c, len(p["out"])))
    return link.reshape(-1, QUERIES, link.shape[1]), rest


def _inputs(x: np.ndarray, kind: np.ndarray, classes: int) -> np.ndarray:
    """The classes of inputs; of -1, no input, the one past all classes."""
    return np.append(kind, classes).take(x, mode="wrap")


def gradient(p: dict, x: np.ndarray, y: np.ndarray, kind: np.ndarray, prior: np.ndarray):
    """Mean loss a target and its gradient, added up over a few windows at a time, so that arrays stay in the cache.
    kind: the class of each type; prior: a row over classes for each type."""
    t = _Tables(p, FEW)
    c, real = _inputs(x, kind, t.classes), (y >= 0).ravel()
    before, target = np.maximum(x[:, SPAN:], 0).ravel(), kind.take(np.maximum(y, 0).ravel())
    n, dtype = max(1, int(real.sum())), p["out"].dtype
    weight, total, one = np.empty(y.size, dtype), np.empty(y.size, dtype), np.ones(max(FEW, WIDTH + 1), dtype)
    g = {k: np.zeros_like(p[k]) for k in ("out", "down", "up", "mix")}
    place = np.zeros(2 * SPAN * QUERIES, dtype)
    # Keys and values belong to inputs, queries and last inputs to targets, both to classes.
    inputs, targets = (np.empty((len(x), m, 2 * WIDTH), dtype) for m in (2 * SPAN, QUERIES))
    for lo in range(0, len(x), FEW):
        some, rows = slice(lo, lo + FEW), slice(lo * QUERIES, (lo + FEW) * QUERIES)
        z, (q, k, v, a, share, o, h1, u, h2, base) = _links(t, c[some])
        z *= prior.take(before[rows], 0)
        sums = np.matmul(z, t.one, out=total[rows])
        flat, spot = z.reshape(-1), np.arange(0, z.size, t.classes) + target[rows]
        weight[rows] = flat[spot]
        # Of the link's logarithm, times total and n, which the rows of the next products make good.
        z /= base
        at = base.reshape(-1).take(spot)
        flat[spot] = weight[rows] / at - sums / at
        low = np.flatnonzero((at <= FLOOR) | (sums < LEAST))
        if len(low):
            z[low] *= base[low] > FLOOR
        scale = (real[rows] / (sums * n)).astype(dtype)[:, None]
        h2 *= scale
        g["out"] += z.T @ h2
        d2 = z @ p["out"]
        d2 *= scale
        g["down"] += u.T @ d2
        du = d2 @ p["down"].T
        du *= u > 0
        g["up"] += h1.T @ du
        d1 = d2
        d1 += du @ p["up"].T
        g["mix"] += (o.T @ d1)[:WIDTH]
        do = d1 @ t.mix.T
        do *= share
        o *= do
        do[:, WIDTH] -= o @ one[: WIDTH + 1]
        do = do.reshape(len(q), QUERIES, WIDTH + 1)
        da = v @ np.ascontiguousarray(do.transpose(0, 2, 1))
        da *= a
        place += one[: len(da)] @ da.reshape(len(da), -1)
        np.matmul(da, q, out=inputs[some, :, :WIDTH])
        np.matmul(a, do[:, :, :WIDTH], out=inputs[some, :, WIDTH:])
        np.matmul(da.transpose(0, 2, 1), k, out=targets[some, :, :WIDTH])
        targets[some, :, WIDTH:] = d1.reshape(q.shape)
    g["place"] = place.reshape(2 * SPAN, QUERIES).T.copy()
    g["key"], g["value"] = np.split(_by_class(inputs, c, t.classes), 2, axis=1)
    g["query"], g["last"] = np.split(_by_class(targets, c[:, SPAN::STEP], t.classes), 2, axis=1)
    g["query"] *= WIDTH**-0.5
    return -float(np.log(np.maximum(weight / total, 1e-30))[real].sum() / n), g


def _by_class(rows: np.ndarray, c: np.ndarray, classes: int) -> np.ndarray:
    """The sums of rows by class; those of no input are left out."""
    rows, c = rows.reshape(-1, rows.shape[-1]), c.ravel()
    out = np.zeros((classes + 1, rows.shape[1]), rows.dtype)
    order, count = np.argsort(c.astype(np.uint16), kind="stable"), np.bincount(c, minlength=classes + 1)
    have = count > 0
    if have.any():  # two columns are added up as one complex number
        sums = np.add.reduceat(rows.take(order, 0).view(np.result_type(rows, np.complex64)), (np.cumsum(count) - count)[have], axis=0)
        out[have] = sums.view(rows.dtype)
    return out[:-1]


class Adam:
    """Weights that follow the gradients of batches; all of them in one flat array."""

    def __init__(self, weights: dict, rate: float):
        self.names, self.rate, self.step, self.windows = sorted(weights), rate, 0, 0
        self.flat = np.concatenate([weights[k].ravel() for k in self.names])
        self.m, self.s, self.p, at = np.zeros_like(self.flat), np.zeros_like(self.flat), {}, 0
        for k in self.names:
            self.p[k] = self.flat[at : at + weights[k].size].reshape(weights[k].shape)  # a view
            at += weights[k].size

    def learn(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray, prior: np.ndarray) -> float:
        loss, g = gradient(self.p, x, y, kind, prior)
        g = np.concatenate([g[k].ravel() for k in self.names])
        self.step += 1
        self.windows += len(x)
        self.m += 0.1 * (g - self.m)
        self.s += 0.01 * (g * g - self.s)
        self.flat -= (self.rate / (1 - 0.9**self.step)) * self.m / (np.sqrt(self.s / (1 - 0.99**self.step)) + 1e-8)
        return loss


def score(p: dict, x: np.ndarray, y: np.ndarray, kind: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Natural log probability of the targets' classes, a sum for each window."""
    t, out = _Tables(p, FEW), np.zeros(len(x))
    for lo in range(0, len(x), FEW):
        w = slice(lo, lo + FEW)
        link, _ = _links(t, _inputs(x[w], kind, t.classes))
        before, target = np.maximum(x[w, SPAN:], 0).ravel(), kind.take(np.maximum(y[w], 0).ravel())
        rows, spot = prior.take(before, 0), np.arange(0, link.size, t.classes) + target
        weight = rows.reshape(-1)[spot] * link.reshape(-1)[spot]
        out[w] = np.where(y[w] >= 0, np.log(weight / np.vecdot(rows, link)).reshape(-1, QUERIES), 0).sum(1, dtype=np.float64)
    return out
