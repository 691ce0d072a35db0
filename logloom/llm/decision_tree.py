"""A small classification tree in numpy, grown by Gini impurity."""

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    below: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 in the leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.value[at]
            node = at[inner]
            at[inner] = np.where(x[inner, f[inner]] <= self.below[node], self.left[node], self.right[node])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """Splits at midpoints; equal gains go to the first feature and the lowest threshold."""
    nodes: list[list] = []

    def node(at: np.ndarray, d: int) -> int:
        k = len(nodes)
        p = float(y[at].mean())
        nodes.append([-1, 0.0, -1, -1, p])
        if d == 0 or p in (0.0, 1.0) or len(at) < 2 * least:
            return k
        best = None
        for f in range(x.shape[1]):
            order = at[np.argsort(x[at, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(at))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(at) - n >= least)
            if not ok.any():
                continue
            a, b = ones[:-1], ones[-1] - ones[:-1]
            m = len(at) - n
            impurity = np.where(ok, 2 * a * (n - a) / n + 2 * b * (m - b) / m, np.inf)
            i = int(impurity.argmin())
            if best is None or impurity[i] < best[0] - 1e-9:
                best = (impurity[i], f, (v[i] + v[i + 1]) / 2)
        if best is None or best[0] >= 2 * p * (1 - p) * len(at) - 1e-9:
            return k
        _, f, t = best
        inside = x[at, f] <= t
        nodes[k][:4] = [f, t, node(at[inside], d - 1), node(at[~inside], d - 1)]
        return k

    node(np.arange(len(x)), depth)
    cols = list(zip(*nodes))
    return Tree(np.array(cols[0]), np.array(cols[1], float), np.array(cols[2]), np.array(cols[3]), np.array(cols[4], float))
