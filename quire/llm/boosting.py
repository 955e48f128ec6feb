"""Histogram gradient-boosted trees for two classes, flattened into arrays for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: node k has children 2k + 1 and 2k + 2.

    feature and threshold are (trees, 2^depth - 1), leaf is (trees, 2^depth). A row goes right where its
    feature is above the threshold; unsplit nodes have an infinite threshold.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row of x."""
        out = np.full(len(x), self.prior)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least_rows: int = 20) -> Forest:
    """Fit on rows x and labels y (0 or 1) by logistic loss; the same input gives the same forest.

    Without rows the forest is empty and every score is 0.5; with one class its prior leans to it.
    """
    n, width = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = (y.sum() + 1.0) / (n + 2.0)
    prior = float(np.log(mean / (1 - mean)))
    if not n or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), prior)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    span = bins + 1
    features, thresholds, values = [], [], []
    margin = np.full(n, prior)
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, span)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(count, 1e-6)
            for j in range(width):
                key = at * span + binned[:, j]
                gs, hs, cs = (np.bincount(key, w, count * span).reshape(count, span).cumsum(1) for w in (g, h, None))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(cs < least_rows) | (ct - cs < least_rows)] = 0
                gain[:, len(edges[j]) :] = 0
                where = gain.argmax(1)
                top = gain[np.arange(count), where]
                for k in np.flatnonzero(top > best):
                    best[k], feature[first + k], cut[first + k] = top[k], j, where[k]
                    threshold[first + k] = edges[j][where[k]]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(values), prior)
