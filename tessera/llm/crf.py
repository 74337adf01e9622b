"""Linear-chain conditional random fields over string features: training and decoding."""

from __future__ import annotations

import numpy as np


def forward_backward(u: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals and summed edge marginals of a chain with unaries u (n x m) and transitions t (m x m)."""
    n, m = u.shape
    f, b = np.zeros((n, m)), np.zeros((n, m))
    f[0] = u[0]
    for k in range(1, n):
        f[k] = u[k] + np.logaddexp.reduce(f[k - 1][:, None] + t, axis=0)
    for k in range(n - 2, -1, -1):
        b[k] = np.logaddexp.reduce(t + (u[k + 1] + b[k + 1])[None, :], axis=1)
    z = np.logaddexp.reduce(f[-1])
    edges = np.zeros((m, m))
    for k in range(n - 1):
        edges += np.exp(f[k][:, None] + t + (u[k + 1] + b[k + 1])[None, :] - z)
    return np.exp(f + b - z), edges


def train(data: list[tuple[list[list[str]], list[int]]], m: int, epochs: int = 4, rate: float = 0.2, decay: float = 1e-4) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(weights by feature, transitions) by stochastic gradient ascent on the log likelihood, in the order of the data."""
    weights: dict[str, np.ndarray] = {}
    chain = np.zeros((m, m))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for feats, labels in data:
            u = np.array([sum((weights[f] for f in fs if f in weights), np.zeros(m)) for fs in feats])
            nodes, edges = forward_backward(u, chain)
            for k, fs in enumerate(feats):
                g = -nodes[k]
                g[labels[k]] += 1
                for f in fs:
                    weights[f] = weights.get(f, np.zeros(m)) * (1 - step * decay) + step * g
            for a, b in zip(labels, labels[1:]):
                edges[a, b] -= 1
            chain -= step * edges
    return weights, chain


def viterbi_two(d: list[float], t: list[list[float]]) -> list[int]:
    """The best labels 0/1 of a chain: d is how much each position favours 1, t the transitions; ties go to 0."""
    s0, s1, back = 0.0, d[0], []
    for x in d[1:]:
        a, b, c, e = s0 + t[0][0], s1 + t[1][0], s0 + t[0][1], s1 + t[1][1]
        back.append((b > a, e > c))
        s0, s1 = max(a, b), max(c, e) + x
    at = int(s1 > s0)
    out = [at]
    for step in reversed(back):
        at = int(step[at])
        out.append(at)
    return out[::-1]
