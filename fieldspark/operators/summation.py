"""Sums of kernels over many centres without all pairs.

Kernels that end at their range are summed over the pairs within it: as an equi-join on grid cells where the centres are a table of any
size (compact_sum), by skipping far boxes where they are a fitted model (ClusterSum). Kernels without an end are summed over boxes
of centres: a box that is small, seen from the targets, acts through weights at its Chebyshev nodes. Spheroidal kernels are the sum of
a part of each kind.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import polynomial as P
from ..functions.kernels import Rbf, on_arrays, spheroidal_edge, split_spheroidal
from ..geometry import axes, transform
from ..model import Model
from .neighbors import range_join

TILE = 2_000_000  # kernel values at once
ROUNDING = 8  # units in the last place
SEPARATION = 0.5  # largest radius of a box over its distance from the targets


def compact_sum(model: Model, centers: DataFrame, points: DataFrame, weight: str = "w", tail: list[float] | None = None, name: str = "value", on: list[str] | None = None) -> DataFrame:
    """points with the weighted sum of a model of kernels that end (sph, cub) over a table of centres, and the polynomial of tail.

    Both sides have an id, unique in each. Only pairs within the support radius meet, by range_join; nothing is broadcast and sums are
    combined before the shuffle by id. A point beyond all centres gets the polynomial alone; one with a null coordinate gets null.
    """
    on = on or axes(points)
    if not all(r.kernel.compact for r in model.rbfs):
        raise ValueError("only kernels with a finite support can be summed by distance")
    parts = []
    for r in model.rbfs:
        a = r.matrix(len(on))
        here = transform(points.select("id", *(F.col(c).cast("double").alias(c) for c in on)), a, on).withColumn("w", F.lit(0.0))
        there = transform(centers.select("id", *(F.col(c).cast("double").alias(c) for c in on), F.col(weight).cast("double").alias("w")), a, on)
        near = range_join(here, there, r.support_radius, on, ["w"])
        parts.append(near.select("id", (F.col("bw") * Rbf(r.name, r.params).column(F.col("distance"))).alias("_part")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("_part").alias("_sum"))
    known = reduce(lambda p, q: p & q, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in on))
    flat = P.evaluate([F.col(c) for c in on], model.degree, tail) if tail else F.lit(0.0)
    return points.join(sums, "id", "left").withColumn(name, F.when(known, F.coalesce("_sum", F.lit(0.0)) + flat)).drop("_sum")


def terms(rbf: Rbf) -> list[tuple[Callable, float]]:
    """The kernel as functions of the distance, each with the radius beyond which it is zero."""
    if rbf.name.startswith("sp") and rbf.name != "sph":
        direct, smooth = split_spheroidal(rbf)
        return [(direct, spheroidal_edge(rbf)), (smooth, np.inf)]
    return [(on_arrays(rbf), rbf.support_radius)]


def lagrange(t: np.ndarray, order: int) -> np.ndarray:
    """Values at t in [-1, 1] of the polynomials that are 1 at one Chebyshev node each."""
    angle = (2 * np.arange(order) + 1) * np.pi / (2 * order)
    m = np.arange(order)
    c = np.cos(np.outer(angle, m)) * np.where(m == 0, 1.0, 2.0) / order
    return np.cos(np.arccos(np.clip(t, -1, 1))[:, None] * m) @ c.T


def _halves(x: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = int(np.ptp(x[i], axis=0).argmax())
    i = i[np.argpartition(x[i, a], len(i) // 2)]
    return i[: len(i) // 2], i[len(i) // 2 :]


class _Box:
    def __init__(self, x: np.ndarray, rows: np.ndarray):
        low, high = x[rows].min(0), x[rows].max(0)
        self.rows, self.centre, self.half = rows, (low + high) / 2, np.maximum((high - low) / 2, 1e-300)
        self.radius, self.parts, self.weights, self.nodes = float(np.linalg.norm(self.half)), [], None, None


def _meet(f: Callable, y: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    out, step = np.zeros(len(y)), max(1, TILE // max(1, len(y)))
    for at in range(0, len(x), step):
        r2 = np.zeros((len(y), len(x[at : at + step])))
        for k in range(y.shape[1]):
            e = y[:, k, None] - x[None, at : at + step, k]
            r2 += e * e
        out += f(np.sqrt(r2)) @ w[at : at + step]
    return out


def products(f: Callable, y: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of f of the distance over weighted centres, in tiles that stay in a core's cache."""
    out, rows, cols = np.zeros(len(y)), 32, 1024
    far = np.ascontiguousarray(x.T)
    for a in range(0, len(y), rows):
        near = y[a : a + rows]
        for b in range(0, len(x), cols):
            r2 = near[:, :1] - far[0, b : b + cols]
            r2 *= r2
            for k in range(1, y.shape[1]):
                e = near[:, k : k + 1] - far[k, b : b + cols]
                e *= e
                r2 += e
            out[a : a + rows] += f(np.sqrt(r2, out=r2)) @ w[b : b + cols]
    return out


class ClusterSum:
    """The sum of one kernel over weighted centres, for targets near or far. order: Chebyshev nodes along each axis of a box."""

    def __init__(self, rbf: Rbf, x: np.ndarray, w: np.ndarray, order: int):
        self.rbf, self.order, self.map = rbf, order, rbf.matrix(x.shape[1])
        self.x, self.w, self.many = x @ self.map.T, w, order ** x.shape[1]
        self.far = any(np.isinf(end) for _, end in terms(rbf))
        self.root = self._grow(np.arange(len(x))) if len(x) else None

    def _grow(self, rows: np.ndarray) -> _Box:
        box = _Box(self.x, rows)
        if len(rows) > max(2 * self.many, 64):
            box.parts = [self._grow(i) for i in _halves(self.x, rows)]
        if self.far and len(rows) > self.many:
            t = np.cos((2 * np.arange(self.order) + 1) * np.pi / (2 * self.order))
            d = len(box.centre)
            box.nodes = box.centre + box.half * np.stack(np.meshgrid(*[t] * d, indexing="ij"), -1).reshape(-1, d)
            box.weights = np.zeros(self.many)
            # the nodes of a part carry all that polynomials of this order see of its centres
            parts = [(p.nodes, p.weights) if p.nodes is not None else (self.x[p.rows], self.w[p.rows]) for p in box.parts]
            for x, w in parts or [(self.x[rows], self.w[rows])]:
                for at in range(0, len(x), max(1, TILE // self.many)):
                    u = (x[at : at + TILE // self.many] - box.centre) / box.half
                    full = w[at : at + TILE // self.many, None]
                    for k in range(d):
                        full = (full[:, :, None] * lagrange(u[:, k], self.order)[:, None, :]).reshape(len(u), -1)
                    box.weights += full.sum(0)
        return box

    def values(self, y: np.ndarray, group: int = 32) -> np.ndarray:
        y, out = y @ self.map.T, np.zeros(len(y))
        if self.root is None or not len(y):
            return out
        todo = [np.arange(len(y))]
        while todo:
            rows = todo.pop()
            if len(rows) > group:
                todo += _halves(y, rows)
                continue
            here = _Box(y, rows)
            for f, end in terms(self.rbf):
                boxes, near, far = [self.root], [], []
                while boxes:
                    b = boxes.pop()
                    away = float(np.linalg.norm(b.centre - here.centre)) - here.radius
                    if away - b.radius > end:
                        continue
                    if np.isinf(end) and b.nodes is not None and b.radius <= SEPARATION * away:
                        far.append(b)
                    elif b.parts:
                        boxes += b.parts
                    else:
                        near.append(b.rows)
                if near:
                    i = np.concatenate(near)
                    out[rows] += _meet(f, y[rows], self.x[i], self.w[i])
                if far:
                    out[rows] += _meet(f, y[rows], np.concatenate([b.nodes for b in far]), np.concatenate([b.weights for b in far]))
        return out


def cluster_sums(model: Model, x: np.ndarray, w: np.ndarray, accuracy: float, sample: int = 256, seed: int = 0) -> list[ClusterSum] | None:
    """One sum for each kernel, of the lowest order whose largest error is within the accuracy; None if no order reaches it.

    The error is measured against exact sums, at up to `sample` centres and as many places around them, each a group by itself: so the
    most boxes are far, more than for the larger groups of an evaluation. It is no bound elsewhere. An accuracy that rounding alone uses up
    (ROUNDING units in the last place of the sums of magnitudes) isn't tried, as no order can be seen to reach it.
    """
    r = np.random.default_rng(seed)
    at = x[r.choice(len(x), min(sample, len(x)), replace=False)]
    at = np.concatenate((at, at + r.normal(size=at.shape) * np.ptp(x, axis=0) / 20))
    moved = [(b, at @ b.matrix(x.shape[1]).T, x @ b.matrix(x.shape[1]).T) for b in model.rbfs]
    size = sum(_meet(lambda r, b=b: np.abs(on_arrays(b)(r)), y[:16], c, np.abs(w)) for b, y, c in moved)
    if accuracy < ROUNDING * np.spacing(size.max(initial=0)):
        return None
    exact = sum(_meet(on_arrays(b), y, c, w) for b, y, c in moved)
    for order in (4, 6, 8, 10, 12) if x.shape[1] == 3 else (4, 8, 12, 16):
        got = [ClusterSum(b, x, w, order) for b in model.rbfs]
        if np.abs(sum(g.values(at, 1) for g in got) - exact).max() <= accuracy:
            return got
    return None
