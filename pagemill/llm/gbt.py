"""Gradient-boosted trees over small integer features, one ensemble per class, in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

BINS = 32


class Boosted:
    """Multi-class model: logistic boosting of depth-limited trees, one against the rest."""

    def __init__(self, classes: tuple[str, ...], trees: list[list[list[tuple]]], base: list[float]):
        self.classes, self.trees, self.base = classes, trees, base
        self.cache: dict[tuple[int, ...], str] = {}
        self.flat: dict[int, list[tuple]] = {}

    @classmethod
    def fit(cls, rows: list[tuple[int, ...]], labels: list[str], classes: tuple[str, ...], rounds: int = 30, depth: int = 4, rate: float = 0.3, l2: float = 1.0) -> Boosted:
        x = np.minimum(np.array(rows, dtype=np.int64), BINS - 1)
        trees, base = [], []
        for c in classes:
            y = np.array([label == c for label in labels], dtype=float)
            p = min(max(y.mean(), 1e-3), 1 - 1e-3)
            f = np.full(len(y), np.log(p / (1 - p)))
            base.append(float(f[0]))
            own = []
            for _ in range(rounds):
                q = 1 / (1 + np.exp(-f))
                g, h = y - q, np.maximum(q * (1 - q), 1e-6)
                tree: list[tuple] = []
                _grow(tree, x, g, h, np.arange(len(y)), depth, rate, l2, f)
                own.append(tree)
            trees.append(own)
        return cls(classes, trees, base)

    def scores(self, row: tuple[int, ...]) -> list[float]:
        out = []
        for own, b in zip(self.trees, self.base):
            s = b
            for tree in own:
                at = 0
                while True:
                    node = tree[at]
                    if node[0] < 0:
                        s += node[1]
                        break
                    at = node[2] if row[node[0]] <= node[1] else node[3]
            out.append(s)
        return out

    def learn(self, rows: Iterable[tuple[int, ...]]) -> None:
        """Predict many rows at once and remember them."""
        if len(self.cache) > 200_000:
            self.cache.clear()
        new = [r for r in dict.fromkeys(rows) if r not in self.cache]
        if not new:
            return
        x = np.array(new, dtype=np.int64)
        scores = np.empty((len(new), len(self.classes)))
        each = np.arange(len(new))
        for k, (own, b) in enumerate(zip(self.trees, self.base)):
            s = np.full(len(new), b)
            for (f, bound, left, right), value, depth in self._flat(k, own):
                at = np.zeros(len(new), dtype=np.int64)
                for _ in range(depth):
                    at = np.where(x[each, f[at]] <= bound[at], left[at], right[at])
                s += value[at]
            scores[:, k] = s
        self.cache.update(zip(new, (self.classes[i] for i in scores.argmax(1))))

    def _flat(self, k: int, own: list[list[tuple]]) -> list[tuple]:
        """The trees of a class as arrays of feature, bound, left and right; a leaf leads to itself and holds its value apart."""
        if k not in self.flat:
            self.flat[k] = []
            for tree in own:
                level = [0] * len(tree)
                for i, t in enumerate(tree):  # children stand after their parents
                    if t[0] >= 0:
                        level[t[2]] = level[t[3]] = level[i] + 1
                nodes = np.array([(0, BINS, i, i) if t[0] < 0 else t for i, t in enumerate(tree)], dtype=np.int64)
                self.flat[k].append((tuple(nodes.T.copy()), np.array([t[1] if t[0] < 0 else 0.0 for t in tree]), max(level)))
        return self.flat[k]

    def predict(self, row: tuple[int, ...]) -> str:
        best = self.cache.get(row)
        if best is None:
            s = self.scores(row)
            best = self.classes[int(np.argmax(s))]
            if len(self.cache) < 200_000:
                self.cache[row] = best
        return best


def _grow(tree: list[tuple], x: np.ndarray, g: np.ndarray, h: np.ndarray, ids: np.ndarray, depth: int, rate: float, l2: float, f: np.ndarray) -> int:
    """Grows a subtree for the rows ``ids``, adds its leaves to f and returns its position."""
    at = len(tree)
    tree.append(())
    gs, hs = g[ids].sum(), h[ids].sum()
    best = (1e-6, -1, -1)
    if depth and len(ids) >= 4:
        part = x[ids]
        for k in range(x.shape[1]):
            col = part[:, k]
            gl = np.cumsum(np.bincount(col, weights=g[ids], minlength=BINS))[:-1]
            hl = np.cumsum(np.bincount(col, weights=h[ids], minlength=BINS))[:-1]
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            b = int(np.argmax(gain))
            if gain[b] > best[0]:
                best = (float(gain[b]), k, b)
    if best[1] < 0:
        leaf = float(rate * gs / (hs + l2))
        tree[at] = (-1, leaf)
        f[ids] += leaf
        return at
    mask = x[ids, best[1]] <= best[2]
    left = _grow(tree, x, g, h, ids[mask], depth - 1, rate, l2, f)
    right = _grow(tree, x, g, h, ids[~mask], depth - 1, rate, l2, f)
    tree[at] = (best[1], best[2], left, right)
    return at
