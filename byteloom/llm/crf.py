"""A linear-chain conditional random field with two labels, for whole batches of sequences in numpy.

Sequences of a batch stand side by side, the longest first, and each step of forward-backward takes one position of all that
reach it. Only the difference of the two labels' scores at a position matters, so unaries are one number a position.
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Where the positions of sequences of the given lengths lie, position by position."""

    def __init__(self, lengths):
        n = np.asarray(lengths, np.int64)
        self.order = np.argsort(-n, kind="stable")
        sorted_n = n[self.order]
        self.steps = int(sorted_n[0]) if len(n) else 0
        #: active[t]: how many sequences have a position t
        self.active = np.searchsorted(-sorted_n, -np.arange(1, self.steps + 1), side="right")
        self.base = np.concatenate([[0], np.cumsum(self.active)])
        starts = np.concatenate([[0], np.cumsum(n)])[:-1]
        rank = np.empty(len(n), np.int64)
        rank[self.order] = np.arange(len(n))
        which = np.repeat(np.arange(len(n)), n)
        within = np.arange(int(n.sum())) - starts[which]
        #: place[i]: where position i of the joined sequences stands by step
        self.place = self.base[within] + rank[which]


def marginals(unary: np.ndarray, layout: Layout, trans: np.ndarray, start: float = 0.0) -> np.ndarray:
    """P(label 1) at each position, in the order of the joined sequences. trans: log weights [from, to]."""
    return _forward_backward(unary, layout, trans, start)[0]


def _forward_backward(unary, layout, trans, start, weight=None):
    """Marginals, and the expected counts of pairs, with each sequence's weight (in the order of the layout); None without weights."""
    a = np.exp(trans - trans.max())
    e = np.empty(len(unary))
    e[layout.place] = np.clip(unary, -30, 30)
    e = np.exp(e)
    fwd, bwd = np.empty(len(e)), np.ones(len(e))
    base, active = layout.base, layout.active
    if layout.steps:
        first = e[: active[0]] * np.exp(start)
        fwd[: active[0]] = first / (1 + first)
    for t in range(1, layout.steps):
        p = fwd[base[t - 1] : base[t - 1] + active[t]]
        one = e[base[t] : base[t + 1]] * (a[0, 1] + p * (a[1, 1] - a[0, 1]))
        fwd[base[t] : base[t + 1]] = one / (one + a[0, 0] + p * (a[1, 0] - a[0, 0]))
    # bwd: ratio of what label 1 and label 0 lead to
    for t in range(layout.steps - 2, -1, -1):
        nxt = slice(base[t + 1], base[t + 2])
        w = e[nxt] * bwd[nxt]
        bwd[base[t] : base[t] + active[t + 1]] = (a[1, 0] + a[1, 1] * w) / (a[0, 0] + a[0, 1] * w)
    one = fwd * bwd
    p = one / (one + 1 - fwd)
    if weight is None:
        return p[layout.place], None
    total = np.zeros((2, 2))
    for t in range(1, layout.steps):
        f = fwd[base[t - 1] : base[t - 1] + active[t]]
        w = e[base[t] : base[t + 1]] * bwd[base[t] : base[t + 1]]
        cells = np.stack([(1 - f) * a[0, 0], (1 - f) * a[0, 1] * w, f * a[1, 0], f * a[1, 1] * w])
        total += (cells / cells.sum(axis=0) @ weight[: active[t]]).reshape(2, 2)
    return p[layout.place], total


class Likelihood:
    """The conditional log-likelihood of labelled sequences, each times its weight, as a function of theta: unary weights, transitions (4), start."""

    def __init__(self, lengths, labels: np.ndarray, scores, gradient, weight=None):
        self.layout, self.labels, self.scores, self.back = Layout(lengths), labels, scores, gradient
        lengths = np.asarray(lengths)
        weight = np.ones(len(lengths)) if weight is None else np.asarray(weight, np.float64)
        self.at, ends = np.repeat(weight, lengths), np.cumsum(lengths)
        self.sorted, self.weight = weight[self.layout.order], weight
        self.firsts = (ends - lengths)[lengths > 0]
        inner = np.ones(len(labels), bool)
        inner[self.firsts] = False
        before = np.flatnonzero(inner) - 1
        self.seen = np.zeros((2, 2))
        np.add.at(self.seen, (labels[before], labels[before + 1]), self.at[before])

    def slope(self, theta: np.ndarray) -> np.ndarray:
        trans, start = theta[-5:-1].reshape(2, 2), theta[-1]
        p, pairs = _forward_backward(self.scores(theta[:-5]), self.layout, trans, start, self.sorted)
        d = (self.labels - p) * self.at
        return np.concatenate([self.back(d), (self.seen - pairs).ravel(), [d[self.firsts].sum()]])


def fit(lengths, labels: np.ndarray, scores, gradient, weights: np.ndarray, rounds: int = 60, rate: float = 0.15, ridge: float = 1e-3, weight=None):
    """Maximises the conditional likelihood by Adam.

    scores(w): unaries of all positions; gradient(d): what d, the derivative by unary, gives for w. weight: of each sequence's likelihood.
    Returns (w, trans, start)."""
    likelihood = Likelihood(lengths, labels, scores, gradient, weight)
    theta = np.concatenate([weights, np.zeros(5)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = max(1, len(labels))
    for k in range(1, rounds + 1):
        g = likelihood.slope(theta) / n - ridge * theta / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-5], theta[-5:-1].reshape(2, 2), float(theta[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights (the last one of a constant) of a logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
