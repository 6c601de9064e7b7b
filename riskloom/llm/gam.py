"""A generalised additive model with pairwise interactions, boosted in cycles.

Each feature has a lookup table over its bins and each chosen pair of features one over
a coarser grid. Fitting goes round the features again and again; every step fits a
shallow tree to the gradient on one feature's (or pair's) bins and adds a small part of it to the
table. A score is the sigmoid of the sum of one table entry per feature and pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class AdditiveModel:
    """Edges of the bins, the tables, and the base score (all bounded by the parameters)."""

    base: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    coarse: tuple[np.ndarray, ...]
    pair_tables: tuple[np.ndarray, ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of table entries of each row."""
        out = np.full(len(x), self.base)
        if not self.edges:
            return out
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        for table, b in zip(self.tables, bins):
            out += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int, least: int, ridge: float) -> np.ndarray:
    """Leaf value per bin of the tree that best fits the gradient sums of ordered bins."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(nl < least) | (nr < least)] = -1.0
    cut = int(np.argmax(gain))
    if gain[cut] <= 1e-12:
        return out
    at = cut + 1
    return np.concatenate([
        _leaves(g[:at], h[:at], n[:at], depth - 1, least, ridge),
        _leaves(g[at:], h[at:], n[at:], depth - 1, least, ridge),
    ])


def _grid_leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, ridge: float) -> tuple[np.ndarray, float]:
    """Cells of the best tree that cuts one side once and each half of it once; and its gain."""
    best, gain_of = np.full(g.shape, g.sum() / (h.sum() + ridge)), 0.0
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for turned in (False, True):
        gg, hh, nn = (a.T if turned else a for a in (g, h, n))
        up = [np.cumsum(np.cumsum(a, 0), 1) for a in (gg, hh, nn)]
        total = [np.cumsum(a.sum(0)) for a in (gg, hh, nn)]
        for r in range(gg.shape[0] - 1):
            parts, gain, ok = [], 0.0, True
            for side in (0, 1):
                sums = [u[r] if side == 0 else t - u[r] for u, t in zip(up, total)]
                gl, hl, nl = (s[:-1] for s in sums)
                gr, hr, nr = (s[-1] - s[:-1] for s in sums)
                value = gl * gl / (hl + ridge) + gr * gr / (hr + ridge)
                value[(nl < least) | (nr < least)] = -1.0
                c = int(np.argmax(value)) if len(value) else 0
                if not len(value) or value[c] < 0:
                    ok = False
                    break
                gain += value[c]
                parts.append((c, gl[c] / (hl[c] + ridge), gr[c] / (hr[c] + ridge)))
            if ok and gain - whole > gain_of:
                gain_of = gain - whole
                table = np.empty(gg.shape)
                for side, (c, left, right) in enumerate(parts):
                    at = slice(0, r + 1) if side == 0 else slice(r + 1, None)
                    table[at, :c + 1], table[at, c + 1:] = left, right
                best = table.T if turned else table
    return best, gain_of


def fit_additive(
    x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 8, rounds: int = 120,
    pair_rounds: int = 30, n_pairs: int = 6, rate: float = 0.1, depth: int = 2, least: int = 5,
    ridge: float = 1.0,
) -> AdditiveModel:
    """Fit to rows ``x`` and labels ``y`` (0 or 1).

    With no rows the score is 0.5; with labels of one kind it is that kind's smoothed share.
    """
    n_rows = len(y)
    share = (y.sum() + 0.5) / (n_rows + 1.0)
    base = float(np.log(share / (1 - share)))
    if n_rows == 0 or y.min() == y.max():
        return AdditiveModel(base, (), (), (), (), ())
    width = x.shape[1]
    edges = tuple(
        np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)
    )
    codes = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    sizes = [len(e) + 1 for e in edges]
    counts = [np.bincount(c, minlength=s) for c, s in zip(codes, sizes)]
    tables = [np.zeros(s) for s in sizes]
    raw = np.full(n_rows, base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            g, h = gradients()
            step = rate * _leaves(
                np.bincount(codes[j], g, sizes[j]), np.bincount(codes[j], h, sizes[j]), counts[j], depth, least, ridge
            )
            tables[j] += step
            raw += step[codes[j]]
    coarse = tuple(
        np.minimum(np.cumsum(c) * coarse_bins // max(1, n_rows + 1), coarse_bins - 1).astype(np.int64) for c in counts
    )
    small = [c[k] for c, k in zip(coarse, codes)]
    cells = coarse_bins * coarse_bins

    def grid(i: int, j: int, values: np.ndarray | None) -> np.ndarray:
        return np.bincount(small[i] * coarse_bins + small[j], values, cells).reshape(coarse_bins, coarse_bins)

    g, h = gradients()
    gains = sorted(
        ((_grid_leaves(grid(i, j, g), grid(i, j, h), grid(i, j, None), least, ridge)[1], i, j)
         for i in range(width) for j in range(i + 1, width)),
        key=lambda item: (-item[0], item[1], item[2]),
    )
    pairs = tuple((i, j) for gain, i, j in gains[:n_pairs] if gain > 0)
    pair_tables = [np.zeros((coarse_bins, coarse_bins)) for _ in pairs]
    for _ in range(pair_rounds):
        for table, (i, j) in zip(pair_tables, pairs):
            g, h = gradients()
            leaves, _ = _grid_leaves(grid(i, j, g), grid(i, j, h), grid(i, j, None), least, ridge)
            table += rate * leaves
            raw += rate * leaves[small[i], small[j]]
    # Tables are centred, so that an entry says how far a bin departs from the average row.
    for k, table in enumerate(tables):
        middle = float((table * counts[k]).sum() / n_rows)
        table -= middle
        base += middle
    return AdditiveModel(base, edges, tuple(tables), pairs, coarse, tuple(pair_tables))
