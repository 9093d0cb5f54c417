"""Small boosted regression trees over a bounded sample of dense rows, in numpy.

A tree is complete: node i has children 2i+1 and 2i+2; a row goes right where x[feature] > threshold.
A node that was not split has threshold +inf, so every row goes left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.leaf)).bit_length() - 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            right = x[np.arange(len(x)), self.feature[at]] > self.threshold[at]
            at = 2 * at + 1 + right
        return at - (len(self.leaf) - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.leaf[self.leaves(x)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_tree(x, bins, edges, grad, hess, depth, l2, least) -> Tree:
    n_inner, n_feat = 2**depth - 1, x.shape[1]
    n_bins = max(len(e) for e in edges) + 1
    feature, threshold = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
    at = np.zeros(len(x), np.int64)
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        local = at - first
        gain_best = np.full(width, 1e-6)
        for f in range(n_feat):
            key = local * n_bins + bins[:, f]
            g = np.bincount(key, grad, width * n_bins).reshape(width, n_bins)
            h = np.bincount(key, hess, width * n_bins).reshape(width, n_bins)
            c = np.bincount(key, minlength=width * n_bins).reshape(width, n_bins)
            gl, hl, cl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1], np.cumsum(c, 1)[:, :-1]
            gt, ht, ct = g.sum(1, keepdims=True), h.sum(1, keepdims=True), c.sum(1, keepdims=True)
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain = np.where((cl >= least) & (ct - cl >= least), gain, 0)[:, : len(edges[f])]
            if not gain.shape[1]:
                continue
            cut = gain.argmax(1)
            top = gain[np.arange(width), cut]
            for node in np.flatnonzero(top > gain_best):
                gain_best[node] = top[node]
                feature[first + node], threshold[first + node] = f, edges[f][cut[node]]
        right = x[np.arange(len(x)), feature[at]] > threshold[at]
        at = 2 * at + 1 + right
    leaf_at = at - n_inner
    g, h = np.bincount(leaf_at, grad, n_inner + 1), np.bincount(leaf_at, hess, n_inner + 1)
    return Tree(feature, threshold, -g / (h + l2))


def boost(
    x: np.ndarray,
    y: np.ndarray,
    n_trees: int,
    depth: int,
    rate: float = 0.2,
    l2: float = 1.0,
    least: int = 10,
    n_bins: int = 48,
) -> tuple[float, list[Tree]]:
    """(base score, trees) of logistic boosting; leaves hold the learning rate. No rows: no trees, base 0."""
    if not len(x):
        return 0.0, []
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return base, []
    edges = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1]))
        low = np.unique(x[:, f])
        edges.append(np.unique(np.concatenate([q, low[:1], (low[:-1] + low[1:])[:4] / 2]))[:n_bins] if len(low) > 1 else np.empty(0))
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    score, trees = np.full(len(x), base), []
    for _ in range(n_trees):
        p = sigmoid(score)
        tree = _fit_tree(x, bins, edges, p - y, p * (1 - p), depth, l2, least)
        tree.leaf *= rate
        score += tree.predict(x)
        trees.append(tree)
    return base, trees


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y by score: pool adjacent violators, then each pooled block's mean at the
    mean of its scores. Between knots the fit is a straight line, so it keeps the order of scores."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, lowest score, highest score, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            v, c, _, hi, total = blocks.pop()
            blocks[-1][0] += v
            blocks[-1][1] += c
            blocks[-1][3] = hi
            blocks[-1][4] += total
    return np.array([b[4] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
