"""Sums of a kernel over all pairs of one point set, in time proportional to their number: what is far goes through cells of a grid.

Each level halves the cells of the one above. A cell's weights act through Chebyshev nodes; those of cells that are no neighbours, but whose
parents are, go from nodes to nodes by a matrix that all pairs of the same offset share; neighbours at the last level meet point by point.
The sums are approximate and meant for the steps of a solver, whose residual is worked out by exact sums.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np

from .summation import lagrange, products

PAIR, FLOP = 9e-9, 1e-10  # seconds for a pair of points that meet, and for a multiplication in a product of matrices
DEEPEST = 8


def _matches(have: np.ndarray, cells: np.ndarray, offset: tuple[int, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of cells: which have another at this offset, and its place among the sorted keys."""
    there = cells + np.array(offset)
    ok = np.flatnonzero(((there >= 0) & (there < n)).all(1))
    key = np.ravel_multi_index(there[ok].T, (n,) * cells.shape[1])
    at = np.minimum(np.searchsorted(have, key), len(have) - 1)
    hit = have[at] == key
    return ok[hit], at[hit]


class _Level:
    def __init__(self, at: np.ndarray, n: int):
        key = np.ravel_multi_index(at.T, (n,) * at.shape[1])
        self.n, (self.keys, self.of) = n, np.unique(key, return_inverse=True)
        self.cells = np.stack(np.unravel_index(self.keys, (n,) * at.shape[1]), 1)
        self.count = np.bincount(self.of, minlength=len(self.keys))


class GridSum:
    """Values at the points themselves of the sum of f of the distance over all of them. parts: the work is dealt out by leaf cells."""

    def __init__(self, f: Callable, x: np.ndarray, order: int = 7):
        d = x.shape[1]
        self.f, self.order, self.many = f, order, order**d
        self.low, self.side = x.min(0), max(float(np.ptp(x, axis=0).max()) * (1 + 1e-9), 1e-300)
        unit, best = (x - self.low) / self.side, None
        near_by, apart, levels, far = list(product((-1, 0, 1), repeat=d)), 6**d - 3**d, [], 0.0
        for k in range(DEEPEST + 1):
            n = 2**k
            level = _Level(np.minimum((unit * n).astype(np.int64), n - 1), n)
            levels.append(level)
            pairs = np.zeros(len(level.keys))
            for o in near_by:
                i, j = _matches(level.keys, level.cells, o, n)
                pairs[i] += level.count[i] * level.count[j]
            far += len(level.keys) * apart * self.many**2 * FLOP if k > 1 else 0.0
            cost = float(pairs.sum()) * PAIR + far
            if best is None or cost < best:
                best, self.depth, self.work = cost, k, pairs * PAIR + (apart * self.many**2 * FLOP if k > 1 else 0.0)
            elif len(level.keys) > len(x) // 2:
                break
        self.levels, self.seconds = levels[: self.depth + 1], best
        leaf = self.levels[-1]
        self.rows = np.argsort(leaf.of, kind="stable")
        self.ends = np.cumsum(leaf.count)
        self.x = x[self.rows]
        t = np.cos((2 * np.arange(order) + 1) * np.pi / (2 * order))
        self.nodes = np.stack(np.meshgrid(*[t] * d, indexing="ij"), -1).reshape(-1, d)
        inside = (unit[self.rows] * leaf.n - leaf.cells[leaf.of[self.rows]]) * 2 - 1
        self.shapes = [lagrange(inside[:, k], order) for k in range(d)]
        self.halves = []  # from the nodes of a part to those of its cell, by the part's place
        for o in product((0, 1), repeat=d):
            m = np.ones((1, 1))
            for k in range(d):
                m = np.kron(m, lagrange((t + 2 * o[k] - 1) / 2, order))
            self.halves.append(m)
        for low, high in zip(self.levels[1:], self.levels):
            low.parent = np.searchsorted(high.keys, np.ravel_multi_index((low.cells // 2).T, (high.n,) * d))
            low.place = np.ravel_multi_index((low.cells % 2).T, (2,) * d)
        self._tables: dict[int, dict] = {}
        self._lists: dict[tuple[int, int], tuple] = {}

    def full(self, a: int, b: int) -> np.ndarray:
        """The nodes' shapes at points a to b (in the order of cells)."""
        out = self.shapes[0][a:b]
        for s in self.shapes[1:]:
            out = (out[:, :, None] * s[a:b, None, :]).reshape(b - a, -1)
        return out

    def table(self, k: int) -> dict[tuple[int, ...], np.ndarray]:
        """The matrices of a level, by offset; that of the opposite offset is the transposed one."""
        if k not in self._tables:
            half, d, got = self.side / self.levels[k].n / 2, self.x.shape[1], {}
            for o in product(range(-3, 4), repeat=d):
                if max(map(abs, o)) > 1:
                    back = got.get(tuple(-c for c in o))
                    got[o] = self.f(np.sqrt((((self.nodes + 2 * np.array(o))[:, None] - self.nodes) ** 2).sum(-1)) * half).astype(np.float32) if back is None else back.T
            self._tables[k] = got
        return self._tables[k]

    def moments(self, w: np.ndarray) -> list[np.ndarray]:
        """Weights at the nodes of all cells, by level."""
        w, leaf = w[self.rows], self.levels[-1]
        out = [np.zeros((len(v.keys), self.many)) for v in self.levels]
        a = i = 0
        while i < len(self.ends):  # whole cells, some 20,000 points at once
            j = max(i + 1, int(np.searchsorted(self.ends, a + 20_000, "right")))
            b = int(self.ends[j - 1])
            out[-1][i:j] = np.add.reduceat(self.full(a, b) * w[a:b, None], np.append(a, self.ends[i : j - 1]) - a)
            a, i = b, j
        for k in range(self.depth, 2, -1):
            v = self.levels[k]
            for p, m in enumerate(self.halves):
                here = np.flatnonzero(v.place == p)
                out[k - 1][v.parent[here]] += out[k][here] @ m
        return out

    def lists(self, part: int, parts: int) -> tuple:
        """The leaf cells of a part, their cells above, and for each level and offset who gets from whom."""
        if (part, parts) not in self._lists:
            share = np.cumsum(self.work) / self.work.sum() * parts
            mine = np.flatnonzero(np.minimum(np.ceil(share).astype(int) - 1, parts - 1) == part)
            use, pairs = {self.depth: mine}, {}
            for k in range(self.depth, 2, -1):
                use[k - 1] = np.unique(self.levels[k].parent[use[k]])
            for k in range(2, self.depth + 1):
                v, pairs[k] = self.levels[k], []
                for o in self.table(k):
                    i, j = _matches(v.keys, v.cells[use[k]], o, v.n)
                    ok = (np.abs(v.cells[use[k][i]] // 2 - v.cells[j] // 2) <= 1).all(1)
                    if ok.any():
                        pairs[k].append((o, i[ok], j[ok]))
            v = self.levels[-1]
            near = [[] for _ in mine]
            for o in product((-1, 0, 1), repeat=self.x.shape[1]):
                for i, j in zip(*_matches(v.keys, v.cells[mine], o, v.n)):
                    near[i].append(int(j))
            self._lists[part, parts] = use, pairs, near
        return self._lists[part, parts]

    def values(self, w: np.ndarray, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a part and their sums."""
        use, pairs, near = self.lists(part, parts)
        mine = use[self.depth]
        if not len(mine):
            return np.zeros(0, int), np.zeros(0)
        local = None
        if self.depth > 1:
            below = [m.astype(np.float32) for m in self.moments(w)]
            for k in range(2, self.depth + 1):
                table, got = self.table(k), np.zeros((len(use[k]), self.many), np.float32)
                for o, i, j in pairs[k]:
                    got[i] += below[k][j] @ table[o]
                if local is not None:
                    v = self.levels[k]
                    up, place = np.searchsorted(use[k - 1], v.parent[use[k]]), v.place[use[k]]
                    for p, m in enumerate(self.halves):
                        here = np.flatnonzero(place == p)
                        got[here] += local[up[here]] @ m.T.astype(np.float32)
                local = got
        starts, w = np.append(0, self.ends[:-1]), w[self.rows]
        rows, out = [], []
        for i, c in enumerate(mine):
            a, b = int(starts[c]), int(self.ends[c])
            there = np.concatenate([np.arange(starts[j], self.ends[j]) for j in near[i]])
            v = products(self.f, self.x[a:b], self.x[there], w[there])
            if local is not None:
                v += self.full(a, b) @ local[i].astype(float)
            rows.append(self.rows[a:b])
            out.append(v)
        return np.concatenate(rows), np.concatenate(out)

