"""A linear-chain conditional random field with two labels, over many chains laid on end.

With two labels a message is one number, the log-odds of label 1, and a step is e + f(message) with a contracting f. Messages
of all places are therefore found together: start from the emissions alone and repeat the step where the message before has
changed, until nothing changes by more than TOLERANCE. That takes as many sweeps as influence reaches, not as chains are long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TOLERANCE = 1e-3
#: Places whose transitions are summed at once.
PLACES = 1 << 18


def _soft(log_a: float, log_b: float, x: np.ndarray) -> np.ndarray:
    return np.logaddexp(np.float32(log_a), np.float32(log_b) + x)


def _messages(e: np.ndarray, first: np.ndarray, start: float, step) -> np.ndarray:
    """m[t] = e[t] + step(m[t-1]) within chains, m = e + start at their first places."""
    m = e + np.float32(start)
    live = np.flatnonzero(~first)
    while len(live):
        new = e[live] + step(m[live - 1])
        moved = np.abs(new - m[live]) > TOLERANCE
        m[live] = new
        live = live[moved] + 1
        live = live[live < len(e)]
        live = live[~first[live]]
    return m


@dataclass
class Chain:
    """Transition scores between labels 0 and 1, and the start's log-odds."""

    t00: float = 0.0
    t01: float = 0.0
    t10: float = 0.0
    t11: float = 0.0
    start: float = 0.0

    def forward(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _messages(e, first, self.start, lambda r: _soft(self.t01, self.t11, r) - _soft(self.t00, self.t10, r))

    def backward(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """e + the message from the places after; of each place."""
        last = np.append(first[1:], True)[::-1]
        return _messages(e[::-1], last, 0.0, lambda s: _soft(self.t10, self.t11, s) - _soft(self.t00, self.t01, s))[::-1]

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 at each place, given its whole chain."""
        return self.forward(e, first) + self.backward(e, first) - e

    def viterbi(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The labels of the best path of each chain."""
        hard = lambda r: np.maximum(self.t01, self.t11 + r) - np.maximum(self.t00, self.t10 + r)
        m = _messages(e, first, self.start, hard)
        # following back: the label before is fixed by the label after, or by neither, so answers spread from where they are sure
        last = np.append(first[1:], True)
        to0, to1 = (self.t10 + m > self.t00), (self.t11 + m > self.t01)
        label = m > 0
        unsure = np.flatnonzero(~last)
        while len(unsure):
            new = np.where(label[unsure + 1], to1[unsure], to0[unsure])
            moved = new != label[unsure]
            label[unsure] = new
            unsure = unsure[moved] - 1
            unsure = unsure[unsure >= 0]
            unsure = unsure[~last[unsure]]
        return label.astype(np.int8)

    def pair_sums(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Expected numbers of the transitions 00, 01, 10, 11."""
        ahead, back = self.forward(e, first), self.backward(e, first)
        out = np.zeros(4)
        for k in range(1, len(e), PLACES):
            here = slice(k, min(k + PLACES, len(e)))
            t = ~first[here]
            a, c = ahead[here.start - 1 : here.stop - 1][t], back[here][t]
            scores = np.stack([np.full(len(a), self.t00, np.float32), self.t01 + c, self.t10 + a, self.t11 + a + c])
            scores -= scores.max(axis=0)
            p = np.exp(scores)
            out += (p / p.sum(axis=0)).sum(axis=1)
        return out


def fit(features: np.ndarray, width: int, labels: np.ndarray, first: np.ndarray, epochs: int = 12, rate: float = 0.5, penalty: float = 1e-6) -> tuple[np.ndarray, Chain]:
    """Weights of `width` features and a chain, by likelihood ascent (AdaGrad on all places at once).

    features: a row of feature numbers for each place (0: none); labels, first: label of each place, start of a chain.
    """
    weight, chain = np.zeros(width, np.float32), Chain()
    bias, y = 0.0, labels.astype(np.float32)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    square, square_t = np.full(width, 1e-6), np.full(6, 1e-6)
    follow = np.flatnonzero(~first)
    seen = np.bincount(labels[follow - 1].astype(int) * 2 + labels[follow], minlength=4).astype(np.float64)
    n = max(1, int(y.sum()))
    for _ in range(epochs):
        e = np.full(len(features), bias, np.float32)
        for k in range(features.shape[1]):
            e += weight[features[:, k]]
        p = 1 / (1 + np.exp(-chain.marginals(e, first)))
        gap = (y - p) / n
        grad = -penalty * weight
        for k in range(features.shape[1]):
            grad = grad + np.bincount(features[:, k], gap, width)
        grad[0] = 0
        pairs = (seen - chain.pair_sums(e, first)) / n
        other = np.array([*pairs, gap[first].sum(), gap.sum()])
        square += grad**2
        square_t += other**2
        weight += (rate * grad / np.sqrt(square)).astype(np.float32)
        move = 0.2 * other / np.sqrt(square_t)
        chain = Chain(chain.t00 + move[0], chain.t01 + move[1], chain.t10 + move[2], chain.t11 + move[3], chain.start + move[4])
        bias += float(move[5])
    weight[0] = 0
    # a chain's level: transitions from 0 to 0 score nothing, so that a long clean text does not drift
    return np.append(weight, np.float32(bias)), chain


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 20, penalty: float = 1e-3, weight: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (the last is the constant) of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    k = np.ones(len(y)) if weight is None else weight
    ridge = penalty * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (k * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-3:
            break
    return w


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic coefficients of which none but the constant is negative: columns that would have such a one are left out."""
    live = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1] + 1)
        w[np.append(live, True)] = logistic(x[:, live], y, penalty=1.0)
        if (w[:-1] >= 0).all():
            return w
        live &= w[:-1] > 0
