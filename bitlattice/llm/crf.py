"""A linear-chain conditional random field with two labels over sets of binary features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _logaddexp(x: np.ndarray) -> np.ndarray:
    m = x.max(axis=-1)
    return m + np.log(np.exp(x - m[..., None]).sum(axis=-1))


@dataclass
class LinearChain:
    """weights[f, y]: of feature f at a line with label y; moves[x, y]: of label y behind x."""

    weights: np.ndarray
    moves: np.ndarray
    known: dict[int, tuple[float, float]] = field(default_factory=dict)

    def scores(self, mask: int) -> tuple[float, float]:
        """Of both labels for a line whose features are the bits of mask."""
        if mask not in self.known:
            on = [f for f in range(len(self.weights)) if mask >> f & 1]
            self.known[mask] = tuple(map(float, self.weights[on].sum(axis=0)))
        return self.known[mask]

    def viterbi(self, masks: list[int]) -> list[int]:
        """The likeliest sequence of labels; of equals, the one with label 1 later."""
        if not masks:
            return []
        (aa, ab), (ba, bb) = self.moves.tolist()
        a, b = self.scores(masks[0])
        back = []
        for mask in masks[1:]:
            sa, sb = self.scores(mask)
            back.append((0 if a + aa >= b + ba else 1, 0 if a + ab >= b + bb else 1))
            a, b = max(a + aa, b + ba) + sa, max(a + ab, b + bb) + sb
        y = [0 if a >= b else 1]
        for step in reversed(back):
            y.append(step[y[-1]])
        return y[::-1]


def fit(sequences: list[list[int]], labels: list[list[int]], n_features: int, steps: int = 120, l2: float = 1.0) -> LinearChain:
    """Maximum likelihood with an L2 penalty by Adam; the forward and backward recursions run over
    all sequences at once, longest first, so that each place only visits those that reach it.
    Empty sequences are passed over; without any other all weights are zero."""
    order = sorted((k for k in range(len(sequences)) if sequences[k]), key=lambda k: -len(sequences[k]))
    if not order:
        return LinearChain(np.zeros((n_features, 2)), np.zeros((2, 2)))
    length = np.array([len(sequences[k]) for k in order])
    n, longest = len(order), int(length[0])
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    masks = np.array([m for k in order for m in sequences[k]], dtype=np.int64)
    y = np.array([v for k in order for v in labels[k]], dtype=np.int64)
    x = ((masks[:, None] >> np.arange(n_features)) & 1).astype(np.float64)
    reach = [int(np.searchsorted(-length, -t, "left")) for t in range(longest)]  # sequences longer than t
    inner = np.ones(len(y), dtype=bool)
    inner[start] = False
    seen = np.zeros((n_features, 2))
    for v in (0, 1):
        seen[:, v] = x[y == v].sum(axis=0)
    moved = np.zeros((2, 2))
    np.add.at(moved, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    p = np.zeros(2 * n_features + 4)
    m, v2 = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, moves = p[: 2 * n_features].reshape(n_features, 2), p[2 * n_features :].reshape(2, 2)
        score = x @ w
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[start] = score[start]
        for t in range(1, longest):
            at = start[: reach[t]] + t
            alpha[at] = score[at] + _logaddexp(alpha[at - 1][:, None, :] + moves.T)
        for t in range(longest - 2, -1, -1):
            at = start[: reach[t + 1]] + t
            beta[at] = _logaddexp(moves + (score[at + 1] + beta[at + 1])[:, None, :])
        whole = np.repeat(_logaddexp(alpha[start + length - 1]), length)
        node = np.exp(alpha + beta - whole[:, None])
        at = np.flatnonzero(inner)
        pair = np.exp(alpha[at - 1][:, :, None] + moves + (score[at] + beta[at])[:, None, :] - whole[at][:, None, None])
        g = np.concatenate([(x.T @ node - seen).ravel(), (pair.sum(axis=0) - moved).ravel()])
        g = (g + l2 * p) / n
        m, v2 = 0.9 * m + 0.1 * g, 0.99 * v2 + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v2 / (1 - 0.99**step)) + 1e-9)
    return LinearChain(p[: 2 * n_features].reshape(n_features, 2), p[2 * n_features :].reshape(2, 2))
