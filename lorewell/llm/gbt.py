"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from lorewell.llm.learning import logit, sigmoid


@dataclass
class Forest:
    """All nodes of all trees in flat arrays; a leaf has left = own index (scoring needs no test for leaves)."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def leaves(self, x: np.ndarray, root: int) -> np.ndarray:
        at, rows = np.full(len(x), root), np.arange(len(x))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return at

    def raw(self, x: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(x), self.base)
        for root in self.roots if roots is None else roots:
            out += self.value[self.leaves(x, root)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def constant(p: float) -> Forest:
    z = np.zeros(0, int)
    return Forest(z, np.zeros(0), z, z, np.zeros(0), z, 0, float(logit(p)))


#: Gradients are summed as whole multiples of 1/SCALE, so that rows in any order, in any number of parts, give the same sums.
SCALE = 1 << 24


def codes_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of each feature's edges below its value (255 edges at most)."""
    return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def level_sums(forest: Forest, nodes: list[int], code: np.ndarray, y: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Gradient, second derivative (both times SCALE) and rows by node of the last tree, feature and code: (nodes, features, bins, 3)."""
    p = sigmoid(forest.raw(code, forest.roots[:-1]))
    slot = np.full(len(forest.value), -1)
    slot[nodes] = np.arange(len(nodes))
    at = slot[forest.leaves(code, forest.roots[-1])]
    on = at >= 0
    parts = [np.rint(SCALE * weight * (y - p))[on], np.rint(SCALE * weight * p * (1 - p))[on], None]
    out = np.zeros((len(nodes), code.shape[1], bins, 3), np.int64)
    for f in range(code.shape[1]):
        key = at[on] * bins + code[on, f]
        for k, part in enumerate(parts):
            out[:, f, :, k] = np.bincount(key, part, len(nodes) * bins).reshape(len(nodes), bins)
    return out


def boost(sums: Callable[[Forest, list[int], int], np.ndarray], edges: list[np.ndarray], base: float, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, min_rows: int = 8, l2: float = 1.0) -> Forest:
    """Logistic loss.  monotone[f]: +1 the score may not fall as feature f rises, -1 may not rise, 0 free.

    sums(forest over codes, open nodes, bins): level_sums() over all rows; it is asked once for each level of each tree.
    A split on a constrained feature must order its children's values, and bounds at their midpoint
    pass down to all descendants, so that the constraint holds for the whole tree, and by addition
    for the forest.
    """
    bins = max(len(e) for e in edges) + 1
    feature: list[int] = []
    cut: list[int] = []
    left: list[int] = []
    right: list[int] = []
    value: list[float] = []
    roots: list[int] = []

    def leaf(v: float) -> int:
        k = len(value)
        feature.append(0), cut.append(0), left.append(k), right.append(k), value.append(rate * v)
        return k

    def forest(cuts: np.ndarray) -> Forest:
        return Forest(np.array(feature), cuts, np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)

    for _ in range(trees):
        roots.append(leaf(0.0))
        level = [(roots[-1], -8.0, 8.0)]
        for _ in range(depth):
            if not level:
                break
            total = sums(forest(np.array(cut)), [k for k, _, _ in level], bins)
            below = []
            for (node, lo, hi), own in zip(level, total, strict=True):
                tg, th, tn = own[0].sum(0) / (SCALE, SCALE, 1)
                v = float(np.clip(tg / (th + l2), lo, hi))
                value[node] = rate * v
                best = None
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    cg, ch, cn = (np.cumsum(own[f], axis=0)[: len(e)] / (SCALE, SCALE, 1)).T
                    vl = np.clip(cg / (ch + l2), lo, hi)
                    vr = np.clip((tg - cg) / (th - ch + l2), lo, hi)
                    gain = _gain(cg, ch, vl, l2) + _gain(tg - cg, th - ch, vr, l2) - _gain(tg, th, v, l2)
                    ok = (cn >= min_rows) & (tn - cn >= min_rows)
                    if monotone[f]:
                        ok &= (vr - vl) * monotone[f] >= 0
                    gain = np.where(ok, gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k, float(vl[k]), float(vr[k]), cn[k])
                if best is None:
                    continue
                _, f, b, vl, vr, n = best
                mid = (vl + vr) / 2
                bounds = ((lo, mid), (mid, hi)) if monotone[f] > 0 else ((mid, hi), (lo, mid)) if monotone[f] < 0 else ((lo, hi), (lo, hi))
                feature[node], cut[node] = f, b
                left[node], right[node] = leaf(np.clip(vl, *bounds[0])), leaf(np.clip(vr, *bounds[1]))
                below += [(k, *bound) for k, bound, rows in ((left[node], bounds[0], n), (right[node], bounds[1], tn - n)) if rows >= 2 * min_rows]
            level = below
    inner = np.array(left) != np.arange(len(left))
    return forest(np.array([edges[f][c] if i else 0.0 for f, c, i in zip(feature, cut, inner, strict=True)]))


def fit_forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, monotone: np.ndarray, bins: int = 48, **how: float) -> Forest:
    """boost() on rows in memory."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = codes_of(x, edges)
    return boost(lambda forest, nodes, size: level_sums(forest, nodes, code, y, weight, size), edges, float(logit(float(np.average(y, weights=weight)))), monotone, **how)  # type: ignore[arg-type]


def _gain(g: np.ndarray, h: np.ndarray, v: np.ndarray, l2: float) -> np.ndarray:
    return g * v - 0.5 * (h + l2) * v * v
