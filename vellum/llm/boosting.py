"""Gradient-boosted trees for binary labels, in numpy: histograms, complete trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # go right when the value is above
    leaf: np.ndarray  # (trees, 2**depth), log-odds
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0) -> Trees:
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    z = np.full(n, base)
    inner = 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best_gain, best_f, best_c = np.zeros(count), np.zeros(count, np.int64), np.full(count, -1)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                slot = local * (len(c) + 1) + binned[:, f]
                gs = np.bincount(slot, g, count * (len(c) + 1)).reshape(count, -1).cumsum(axis=1)
                hs = np.bincount(slot, h, count * (len(c) + 1)).reshape(count, -1).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                at = gain.argmax(axis=1)
                value = gain[np.arange(count), at]
                better = value > best_gain + 1e-9
                best_gain[better], best_f[better], best_c[better] = value[better], f, at[better]
            split = best_c >= 0
            feature[first : first + count] = best_f
            threshold[first : first + count] = [cuts[f][c] if ok else np.inf for f, c, ok in zip(best_f, best_c, split, strict=True)]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        z += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)
