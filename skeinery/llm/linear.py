"""A regularized linear classifier over hashed features, trained on weakly labelled examples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import xxhash

#: Dimensions of the hashed feature space.
DIMENSIONS = 1 << 17


class Features:
    """Maps feature names to dimensions, remembering those of the (bounded) training sample."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.known: dict[str, int] = {}

    def __getitem__(self, name: str) -> int:
        i = self.known.get(name)
        if i is None:
            i = self.known[name] = self.dimension(name, self.dimensions)
        return i

    @staticmethod
    def dimension(name: str, dimensions: int) -> int:
        return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")) % dimensions


def descend(gradient: Callable[[np.ndarray], np.ndarray], l2: float = 1e-5, rounds: int = 60, rate: float = 0.15, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Weights that minimize a regularized loss, given the gradient of the loss at any weights, by full-batch Adam."""
    w, m, v = np.zeros(dimensions), np.zeros(dimensions), np.zeros(dimensions)
    for k in range(1, rounds + 1):
        g = gradient(w) + l2 * w
        m = 0.9 * m + 0.1 * g
        v = 0.98 * v + 0.02 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.98**k)) + 1e-8)
    return w


def fit(rows: Sequence[Sequence[int]], labels: Sequence[float], l2: float = 1e-5, rounds: int = 60, rate: float = 0.15, dimensions: int = DIMENSIONS, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression on binary features, by full-batch Adam; classes count equally unless weighted."""
    y = np.asarray(labels, np.float64)
    if not len(y):
        return np.zeros(dimensions)
    if weights is None:
        pos = max(1.0, y.sum())
        neg = max(1.0, len(y) - y.sum())
        weights = np.where(y > 0.5, 0.5 / pos, 0.5 / neg)
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(rows)), sizes)

    def gradient(w: np.ndarray) -> np.ndarray:
        z = np.bincount(owner, w[flat], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.bincount(flat, ((p - y) * weights)[owner], dimensions)

    return descend(gradient, l2, rounds, rate, dimensions)
