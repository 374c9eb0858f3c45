"""Small boosted trees on whole-number features: logistic loss, exact cuts, deterministic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    base: float
    #: For each tree the features and cuts of its inner nodes, level by level, and its leaves.
    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features, cuts, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(len(leaves).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
            out += leaves[node - len(features)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.25, ridge: float = 1.0) -> Boosted:
    """Fit trees of a fixed depth one after another to the loss's gradient and curvature."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score, trees = np.full(len(y), base), []
    values = [np.unique(x[:, f]) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(v, x[:, f]) for f, v in enumerate(values)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        features, cuts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = node == k
                best = 1e-9
                total_g, total_h = g[own].sum(), h[own].sum()
                for f, v in enumerate(values):
                    if len(v) < 2 or not own.any():
                        continue
                    left_g = np.cumsum(np.bincount(codes[own, f], g[own], len(v)))[:-1]
                    left_h = np.cumsum(np.bincount(codes[own, f], h[own], len(v)))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                    at = int(np.argmax(gain))
                    if gain[at] > best:
                        best, features[k], cuts[k] = gain[at], f, v[at]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[node]] > cuts[node])
        leaf = node - (2**depth - 1)
        leaves = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        score = score + leaves[leaf]
        trees.append((features, cuts, leaves))
    return Boosted(base, tuple(trees))


def calibrated(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut above which every cut of the held-out rows reaches the precision; infinite if none does."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order])
    last = np.append(scores[order][1:] != scores[order][:-1], True)
    good = hits / np.arange(1, len(y) + 1) >= precision
    bad = np.flatnonzero(last & ~good)
    end = int(bad[0]) if len(bad) else len(y)
    fits = np.flatnonzero((last & good)[:end])
    return float(scores[order][fits[-1]]) if len(fits) else float("inf")
