"""Radial-basis-function and dual kriging interpolants: fits with values, gradients and inequalities, and evaluation over DataFrames.

The centres of a fit are on the driver (a model is a bounded object); what is evaluated or tested is a DataFrame of any size, which meets the
broadcast centres in Arrow batches, in tiles of bounded size. On a line, models of one exponential or linear kernel are solved and summed
directly at any size (line.py). Other small systems are solved densely; larger ones by flexible GMRES, whose matrix-vector products are distributed over row blocks, with a two-level overlapping Schwarz preconditioner.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import polynomial as P
from ..functions.kernels import on_arrays
from ..geometry import Bbox, axes
from ..model import Model
from . import line
from .krylov import fgmres
from .multilevel import PAIR, GridSum
from .summation import cluster_sums, products, terms

DENSE = 6000  # rows of a system that is solved densely
TILE = 2_000_000  # kernel values at once
ROUND = 5e-4  # of its residual is left by a round of steps with approximate sums
CLUSTERS = 1000  # centres from which a wanted accuracy is met by sums over clusters
_GRIDS: dict[str, list[GridSum]] = {}  # of a worker


def _tiles(n: int, m: int) -> Iterator[slice]:
    step = max(1, TILE // max(m, 1))
    for k in range(0, n, step):
        yield slice(k, min(n, k + step))


def kernel_rows(model: Model, x: np.ndarray, gx: np.ndarray, y: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """The matrix from weights at (y, gy) to values at x and gradients at gx, without nugget and polynomial."""
    d = x.shape[1]
    out = np.zeros((len(x) + d * len(gx), len(y) + d * len(gy)))
    for r in model.rbfs:
        if len(x) and len(y):
            out[: len(x), : len(y)] += r.evaluate(x[:, None] - y)
        if len(x) and len(gy):
            out[: len(x), len(y) :] -= r.gradient(x[:, None] - gy).reshape(len(x), -1)
        if len(gx) and len(y):
            out[len(x) :, : len(y)] += r.gradient(gx[:, None] - y).transpose(0, 2, 1).reshape(d * len(gx), -1)
        if len(gx) and len(gy):
            out[len(x) :, len(y) :] -= r.hessian(gx[:, None] - gy).transpose(0, 2, 1, 3).reshape(d * len(gx), -1)
    return out


def basis_rows(model: Model, x: np.ndarray, gx: np.ndarray) -> np.ndarray:
    return np.concatenate((P.design(x, model.degree), P.gradient_design(gx, model.degree)))


def _check(model: Model, points: np.ndarray, grads: np.ndarray, values: np.ndarray) -> None:
    mu, sigma, d = len(points), len(grads), points.shape[1]
    need = model.basis_size(d)
    if mu < need and not (model.degree == 1 and mu == 1 and sigma >= 1):
        raise ValueError(f"at least {need} value points are needed")
    if len(values) != mu + d * sigma:
        raise ValueError("one value for each point and one for each gradient component are needed")
    if sigma and any(r.name in ("exp", "sph", "cub") or r.name.startswith("sp") for r in model.rbfs):
        raise ValueError("a kernel of this model has no gradient at its centre")


@dataclass
class Interpolant:
    model: Model
    centers: np.ndarray | None = None
    grad_centers: np.ndarray | None = None
    weights: np.ndarray | None = None

    # ---- fits -------------------------------------------------------------------------------
    def fit(self, points: np.ndarray, values: np.ndarray, tolerance: float = 1e-6, grad_points: np.ndarray | None = None, grad_tolerance: float | None = None, max_iter: int = 100, accuracy: float = np.inf, initial: Interpolant | None = None, spark: SparkSession | None = None) -> Interpolant:
        """All points become centres. values: point values, then the gradient components point by point."""
        x = np.atleast_2d(np.asarray(points, float))
        g = np.zeros((0, x.shape[1])) if grad_points is None else np.asarray(grad_points, float)
        v = np.asarray(values, float)
        grad_tolerance = tolerance if grad_tolerance is None else grad_tolerance
        _check(self.model, x, g, v)
        if not tolerance > 0 or not grad_tolerance > 0 or max_iter < 0 or not accuracy > 0:
            raise ValueError("tolerances and accuracy must be positive, max_iter not negative")
        w = line.solve(self.model, x, v) if line.serves(self.model, x, g) else None
        start = None if initial is None or w is not None else build_initial_weights(initial, self.model, x, g)
        if w is not None:
            pass
        elif len(v) <= DENSE and start is None:
            w = dense_solve(self.model, x, g, v)
        else:
            w = iterative_solve(self.model, x, g, v, tolerance, grad_tolerance, max_iter, start, spark)
        self.centers, self.grad_centers, self.weights = x, g, w
        return self

    def fit_incrementally(self, points: np.ndarray, values: np.ndarray, tolerance: float, grad_points: np.ndarray | None = None, grad_tolerance: float | None = None) -> Interpolant:
        """Fewer centres: start from a spread few, add those with the largest residuals that lie apart, halving the distance each time."""
        from .neighbors import greedy_filter

        x = np.asarray(points, float)
        d = x.shape[1]
        g = np.zeros((0, d)) if grad_points is None else np.asarray(grad_points, float)
        v = np.asarray(values, float)
        grad_tolerance = grad_tolerance or tolerance
        _check(self.model, x, g, v)
        near = float(np.linalg.norm(np.ptp(np.concatenate((x, g)), axis=0)))
        first = P.unisolvent(x, self.model.degree) if self.model.degree >= 0 else np.array([int(np.abs(v[: len(x)]).argmax())])
        use, gu = np.zeros(len(x), bool), np.zeros(len(g), bool)
        use[first] = True
        while True:
            rhs = np.concatenate((v[: len(x)][use], v[len(x) :].reshape(-1, d)[gu].ravel()))
            self.fit(x[use], rhs, tolerance, g[gu], grad_tolerance)
            got = self.values(x, g)
            res = np.abs(got[: len(x)] - v[: len(x)])
            gres = np.abs(got[len(x) :] - v[len(x) :]).reshape(-1, d).max(1) if len(g) else np.zeros(0)
            res[use], gres[gu] = 0, 0
            if not (res >= tolerance).any() and not (gres >= grad_tolerance).any():
                return self
            near /= 2
            for r, tol, mask, at in ((res, tolerance, use, x), (gres, grad_tolerance, gu, g)):
                order = np.lexsort((np.arange(len(r)), -r))
                order = order[r[order] >= tol]
                if len(order):
                    mask[order[greedy_filter(at[order], near)]] = True

    def fit_inequality(self, points: np.ndarray, values: np.ndarray, lower: np.ndarray, upper: np.ndarray, tolerance: float = 1e-6, max_iter: int = 100) -> Interpolant:
        """Active set: NaN (or null) stands for no value or bound. Violated bounds become centres, worst first; those whose weight pulls away leave."""
        if self.model.nugget:
            raise ValueError("inequalities need a nugget of 0")
        x = np.asarray(points, float)
        v, lo, hi = (np.array([np.nan if t is None else t for t in a], float) for a in (values, lower, upper))
        side = np.zeros(len(x), int)  # -1 at the lower bound, 1 at the upper
        eq = ~np.isnan(v)
        seen: set[bytes] = set()
        for _ in range(max_iter * 4):
            use = eq | (side != 0)
            if use.sum() >= max(1, self.model.basis_size(x.shape[1])):
                target = np.where(eq, v, np.where(side < 0, lo, hi))
                self.fit(x[use], target[use], tolerance)
                w = np.zeros(len(x))
                w[use] = self.weights[: use.sum()]
                got = self.values(x, x[:0])
            else:
                w, got = np.zeros(len(x)), np.zeros(len(x))
            drop = ~eq & (((side < 0) & (w <= 0)) | ((side > 0) & (w >= 0)))
            under, over = ~eq & (side == 0) & (lo - got > tolerance), ~eq & (side == 0) & (got - hi > tolerance)
            if not (drop.any() or under.any() or over.any()):
                return self
            side[drop] = 0
            worst = np.where(under, lo - got, np.where(over, got - hi, 0))
            state = side.tobytes()
            add = np.flatnonzero(under | over)
            if state in seen and len(add):  # a cycle: one bound at a time
                add = add[[int(worst[add].argmax())]]
            seen.add(state)
            side[add] = np.where(under[add], -1, 1)
        raise RuntimeError("the active set did not settle")

    # ---- evaluation ------------------------------------------------------------------------
    def _fitted(self) -> None:
        if self.weights is None:
            raise RuntimeError("not fitted yet")

    @property
    def bbox(self) -> Bbox:
        self._fitted()
        return Bbox.from_points(np.concatenate((self.centers, self.grad_centers)))

    def values(self, x: np.ndarray, gx: np.ndarray | None = None) -> np.ndarray:
        """Values at x, then gradients at gx, point by point."""
        self._fitted()
        gx = x[:0] if gx is None else gx
        d = x.shape[1]
        n = len(self.centers) + d * len(self.grad_centers)
        w, c, out = self.weights[:n], self.weights[n:], []
        if line.serves(self.model, self.centers, self.grad_centers):
            s = line.LineSum(self.model, self.centers, w)
            return np.concatenate((s.values(x[:, 0]) + P.design(x, self.model.degree) @ c, s.slopes(gx[:, 0]) + P.gradient_design(gx, self.model.degree) @ c))
        if not len(self.grad_centers):
            used = w != 0  # a coarse correction and a polynomial have few others
            moved = [(on_arrays(r), x @ r.matrix(d).T, self.centers[used] @ r.matrix(d).T) for r in self.model.rbfs]
            for s in _tiles(len(x), 2000):
                out.append(sum(products(f, y[s], z, w[used]) for f, y, z in moved) + P.design(x[s], self.model.degree) @ c)
        for s in _tiles(len(x) * bool(len(self.grad_centers)), n):
            out.append(kernel_rows(self.model, x[s], x[:0], self.centers, self.grad_centers) @ w + P.design(x[s], self.model.degree) @ c)
        for s in _tiles(len(gx), n * d):
            out.append(kernel_rows(self.model, x[:0], gx[s], self.centers, self.grad_centers) @ w + P.gradient_design(gx[s], self.model.degree) @ c)
        return np.concatenate(out) if out else np.zeros(0)

    def evaluate(self, points: DataFrame, gradients: bool = False, name: str = "value", on: list[str] | None = None, accuracy: float = 0.0) -> DataFrame:
        """points with a value column, and with gradients columns dx[, dy[, dz]]. A null or NaN coordinate gives null.

        accuracy: 0 for exact sums; above, values come from sums over clusters of centres where these reach it (cluster_sums) and the
        fit has no gradient centres. Gradients, and kernels with an end or few centres, are exact.
        """
        self._fitted()
        if accuracy < 0:
            raise ValueError("the accuracy must not be negative")
        on = on or axes(points)
        mu = len(self.centers)
        sums = cluster_sums(self.model, self.centers, self.weights[:mu], accuracy) if accuracy and mu > CLUSTERS and not len(self.grad_centers) else None
        shared = points.sparkSession.sparkContext.broadcast(((self.model, self.centers, self.grad_centers, self.weights), sums))
        extra = [name, *(["d" + a for a in on] if gradients else [])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, sums = shared.value
            f = Interpolant(*parts)
            for b in batches:
                x = np.stack([b.column(a).cast(pa.float64()).to_numpy(zero_copy_only=False) for a in on], 1)
                ok = np.isfinite(x).all(1)
                v = np.full((len(x), len(extra)), np.nan)
                v[ok, 0] = f.values(x[ok]) if sums is None else sum(c.values(x[ok]) for c in sums) + P.design(x[ok], f.model.degree) @ f.weights[len(f.centers) :]
                if gradients:
                    v[ok, 1:] = f.values(x[:0], x[ok]).reshape(-1, len(on))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v[:, k], mask=~ok) for k in range(len(extra)))], names=[*b.schema.names, *extra])

        kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema), *(f"`{e}` double" for e in extra)])
        if mu + len(self.grad_centers) > DENSE and not points.isStreaming and not line.serves(self.model, self.centers, self.grad_centers):
            points = points.repartition(max(8, 4 * points.sparkSession.sparkContext.defaultParallelism))  # a small file would be one task
        return points.mapInArrow(run, kinds)

    # ---- persistence -----------------------------------------------------------------------
    def save(self, spark: SparkSession, path: str) -> None:
        """JSON metadata with the polynomial tail, and two Parquet tables of centres and weights."""
        self._fitted()
        d, mu = self.centers.shape[1], len(self.centers)
        names = ["x", "y", "z"][:d]
        n = mu + d * len(self.grad_centers)
        spark.createDataFrame([(json.dumps({"model": json.loads(self.model.to_json()), "dim": d, "tail": self.weights[n:].tolist()}),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
        rows = [(i, *map(float, p), float(w)) for i, (p, w) in enumerate(zip(self.centers, self.weights[:mu], strict=True))]
        spark.createDataFrame(rows, "id long, " + ", ".join(f"{a} double" for a in names) + ", w double").write.mode("overwrite").parquet(f"{path}/centers")
        rows = [(i, *map(float, p), *map(float, w)) for i, (p, w) in enumerate(zip(self.grad_centers, self.weights[mu:n].reshape(-1, d), strict=True))]
        spark.createDataFrame(rows, "id long, " + ", ".join(f"{a} double" for a in names) + ", " + ", ".join(f"w{a} double" for a in names)).write.mode("overwrite").parquet(f"{path}/grad_centers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Interpolant:
        meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first().meta)
        d = meta["dim"]
        c = np.array(spark.read.parquet(f"{path}/centers").orderBy("id").drop("id").collect(), float).reshape(-1, d + 1)
        g = np.array(spark.read.parquet(f"{path}/grad_centers").orderBy("id").drop("id").collect(), float).reshape(-1, 2 * d)
        return cls(Model.from_json(json.dumps(meta["model"])), c[:, :d], g[:, :d], np.concatenate((c[:, d], g[:, d:].ravel(), meta["tail"])))


def dense_solve(model: Model, x: np.ndarray, g: np.ndarray, v: np.ndarray) -> np.ndarray:
    """On the null space of the polynomials, where the kernel matrix is definite; then the polynomial part."""
    a = kernel_rows(model, x, g, x, g)
    a[np.arange(len(x)), np.arange(len(x))] += model.nugget
    p = basis_rows(model, x, g)
    n, l = p.shape  # noqa: E741
    if not l:
        return _solve(a, v)
    scale = np.maximum(np.abs(p).max(0), 1e-300)
    q, r = np.linalg.qr(p / scale, mode="complete")
    q1, q2 = q[:, :l], q[:, l:]
    w = q2 @ _solve(q2.T @ a @ q2, q2.T @ v) if n > l else np.zeros(n)
    c, *_ = np.linalg.lstsq(r[:l], q1.T @ (v - a @ w), rcond=None)
    return np.concatenate((w, c / scale))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        x = np.linalg.solve(a, b)
        return x + np.linalg.solve(a, b - a @ x)  # one step of refinement
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def build_initial_weights(old: Interpolant, model: Model, x: np.ndarray, g: np.ndarray) -> np.ndarray | None:
    """Weights of centres that the old fit has too (exact coordinates), 0 for new ones, and its polynomial; None if the models differ."""
    if old.model != model:
        return None
    d, mu = x.shape[1], len(old.centers)
    n = mu + d * len(old.grad_centers)
    have = dict(zip(map(bytes, old.centers), old.weights[:mu], strict=True))
    ghave = dict(zip(map(bytes, old.grad_centers), old.weights[mu:n].reshape(-1, d), strict=True))
    w = [have.get(bytes(p), 0.0) for p in x]
    gw = [ghave.get(bytes(p), np.zeros(d)) for p in g]
    return np.concatenate((w, np.concatenate(gw) if gw else np.zeros(0), old.weights[n:]))


def saddle_map(model: Model, x: np.ndarray, g: np.ndarray, spark: SparkSession | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """The saddle-point matrix as a map; with a session its rows are worked out by executors."""
    d, mu, p = x.shape[1], len(x), basis_rows(model, x, g)
    n, l = p.shape  # noqa: E741

    def block(rows: np.ndarray, w: np.ndarray, c: np.ndarray, pts: np.ndarray, gpts: np.ndarray) -> np.ndarray:
        val, grd = rows[rows < len(pts)], rows[rows >= len(pts)] - len(pts)
        f = Interpolant(model, pts, gpts, np.concatenate((w, c)))
        return f.values(pts[val], gpts[grd])

    if spark is None:
        def apply(w: np.ndarray) -> np.ndarray:
            out = block(np.arange(mu + len(g)), w[:n], w[n:], x, g)
            out[:mu] += model.nugget * w[:mu]
            return np.concatenate((out, p.T @ w[:n]))

        return apply
    points = spark.sparkContext.broadcast((x, g))  # sent once for all steps
    blocks = spark.range(0, mu + len(g), 1, max(8, 4 * spark.sparkContext.defaultParallelism))

    def apply_far(w: np.ndarray) -> np.ndarray:
        weights = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pts, gpts = points.value
            for b in batches:
                rows = b.column("id").to_numpy()
                part = block(rows, weights.value[:n], weights.value[n:], pts, gpts)
                val = rows[rows < len(pts)]
                at = np.concatenate((val, (len(pts) + d * (rows[rows >= len(pts)] - len(pts))[:, None] + np.arange(d)).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part)], names=["at", "v"])

        got = blocks.mapInArrow(run, "at long, v double").toArrow()
        out = np.empty(n)
        out[got.column("at").to_numpy()] = got.column("v").to_numpy()
        out[:mu] += model.nugget * w[:mu]
        weights.destroy()
        return np.concatenate((out, p.T @ w[:n]))

    return apply_far


def far_map(model: Model, x: np.ndarray, g: np.ndarray, spark: SparkSession | None = None) -> Callable[[np.ndarray], np.ndarray] | None:
    """saddle_map with approximate sums (GridSum); None where a kernel isn't smooth away from 0, or exact sums take little longer."""
    n, p = len(x), basis_rows(model, x, g)
    if len(g) or any(len(t := terms(r)) > 1 or np.isfinite(t[0][1]) for r in model.rbfs):
        return None
    grids = _grids(model, x)
    if sum(s.seconds for s in grids) > n * n * PAIR * len(grids) / 2:
        return None
    if spark is not None:
        parts, key = max(1, spark.sparkContext.defaultParallelism), uuid.uuid4().hex
        points, blocks, grids = spark.sparkContext.broadcast(x), spark.range(0, parts, 1, parts), []

    def sums(w: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if spark is None:
            for s in grids:
                rows, part = s.values(w)
                out[rows] += part
            return out
        weights = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = _kept_grids(key, model, points.value)
            for b in batches:
                for k in b.column("id").to_pylist():
                    for s in kept:
                        rows, part = s.values(weights.value, k, parts)
                        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(part)], names=["at", "v"])

        got = blocks.mapInArrow(run, "at long, v double").toArrow()
        weights.destroy()
        return np.bincount(got.column("at").to_numpy(), got.column("v").to_numpy(), n)

    def apply(w: np.ndarray) -> np.ndarray:
        out = p @ w[n:] + model.nugget * w[:n]
        return np.concatenate((out + sums(w[:n]) if w[:n].any() else out, p.T @ w[:n]))

    return apply


def _grids(model: Model, x: np.ndarray) -> list[GridSum]:
    return [GridSum(on_arrays(r), x @ r.matrix(x.shape[1]).T) for r in model.rbfs]


def _kept_grids(key: str, model: Model, x: np.ndarray) -> list[GridSum]:
    """Those of one fit stay in a worker from step to step. (A closure would travel with a copy of the empty dictionary.)"""
    if key not in _GRIDS:
        _GRIDS.clear()
        _GRIDS[key] = _grids(model, x)
    return _GRIDS[key]


def divide(x: np.ndarray, leaf: int = 512, overlap: float = 0.5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Domains by halving the longest axis: (indices with overlap, which of them are inner). Inner sets partition the points."""
    parts, todo = [], [np.arange(len(x))]
    while todo:
        i = todo.pop()
        if len(i) <= leaf:
            parts.append(i)
            continue
        a = int(np.ptp(x[i], axis=0).argmax())
        i = i[np.lexsort((i, x[i, a]))]
        todo += [i[len(i) // 2 :], i[: len(i) // 2]]
    out = []
    for i in parts:
        centre, half = (x[i].max(0) + x[i].min(0)) / 2, np.ptp(x[i], axis=0) / 2
        away = np.maximum(np.abs(x - centre) - half, 0).max(1)
        away[i] = -1
        more = np.argsort(away, kind="stable")[len(i) : len(i) + int(overlap * len(i))]
        out.append((np.concatenate((i, more)), np.arange(len(i) + len(more)) < len(i)))
    return out


def coarse_points(x: np.ndarray, count: int) -> np.ndarray:
    """Points spread over the set: the one nearest to the centre of each cell of a halving."""
    cells, out = [np.arange(len(x))], []
    while len(cells) < count and max(map(len, cells)) > 1:
        cells.sort(key=len)
        i = cells.pop()
        a = int(np.ptp(x[i], axis=0).argmax())
        i = i[np.lexsort((i, x[i, a]))]
        cells += [i[: len(i) // 2], i[len(i) // 2 :]]
    for i in cells:
        out.append(i[((x[i] - x[i].mean(0)) ** 2).sum(1).argmin()])
    return np.array(sorted(out))


def schwarz(model: Model, x: np.ndarray, g: np.ndarray, leaf: int = 256, coarse: int = 3000, overlap: float = 1.0) -> Callable[[np.ndarray, Callable, Callable], tuple[np.ndarray, np.ndarray]]:
    """Restricted additive Schwarz over overlapping domains of points and gradients, then a coarse solve, which takes the polynomial too.

    Of a residual and two maps, for many weights and for the few of the coarse solve: weights, and what these give.
    """
    d, mu, sigma = x.shape[1], len(x), len(g)
    allp = np.concatenate((x, g))
    l = model.basis_size(d)  # noqa: E741
    n = mu + d * sigma

    def rows(i: np.ndarray) -> np.ndarray:
        return np.concatenate((i[i < mu], (mu + d * (i[i >= mu] - mu)[:, None] + np.arange(d)).ravel())).astype(int)

    def factor(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        px, pg = x[i[i < mu]], g[i[i >= mu] - mu]
        at = rows(i)
        big = np.zeros((len(at) + l, len(at) + l))
        for s in _tiles(len(px), 8 * d * len(at)) if not len(pg) else ():
            big[s, : len(at)] = kernel_rows(model, px[s], pg, px, pg)
        if len(pg):
            big[: len(at), : len(at)] = kernel_rows(model, px, pg, px, pg)
        big[np.arange(len(px)), np.arange(len(px))] += model.nugget
        big[: len(at), len(at) :] = basis_rows(model, px, pg)
        big[len(at) :, : len(at)] = big[: len(at), len(at) :].T
        try:
            inv = np.linalg.inv(big)
            if not np.linalg.norm(big, 1) * np.linalg.norm(inv, 1) <= 1e13:  # an SVD of each domain would cost more than all else
                raise np.linalg.LinAlgError
        except np.linalg.LinAlgError:
            inv = np.linalg.pinv(big, hermitian=True)
        return at, inv

    top_i = coarse_points(allp, min(coarse, max(4 * l, len(allp) // 4)))
    top, top_inv = factor(top_i[np.argsort(top_i >= mu, kind="stable")])
    fine = []
    for i, inner in divide(allp, leaf, overlap):
        order = np.argsort(i >= mu, kind="stable")
        i, inner = i[order], inner[order]
        at, inv = factor(i)
        own = np.flatnonzero(np.isin(at, rows(i[inner])))
        fine.append((at, at[own], inv[own, : len(at)].astype(np.float32)))  # a quarter of the driver's memory; a preconditioner needn't be exact

    def run(r: np.ndarray, many: Callable, few: Callable) -> tuple[np.ndarray, np.ndarray]:
        w = np.zeros(n + l)
        for at, own, inv in fine:
            size = max(float(np.abs(r[at]).max(initial=0)), 1e-300)
            w[own] += (inv @ (r[at] / size).astype(np.float32)).astype(float) * size
        out = many(w)
        rest = r - out
        got, more = top_inv @ np.concatenate((rest[top], rest[n:])), np.zeros(n + l)
        more[top], more[n:] = got[: len(top)], got[len(top) :]
        return w + more, out + few(more)

    return run


def iterative_solve(model: Model, x: np.ndarray, g: np.ndarray, v: np.ndarray, tolerance: float, grad_tolerance: float, max_iter: int, start: np.ndarray | None, spark: SparkSession | None) -> np.ndarray:
    apply = saddle_map(model, x, g, spark)
    b = np.concatenate((v, np.zeros(model.basis_size(x.shape[1]))))
    p = basis_rows(model, x, g)

    def within(r: np.ndarray) -> bool:
        res = np.abs(r[: len(v)])
        return bool(res[: len(x)].max(initial=0) <= tolerance and res[len(x) :].max(initial=0) <= grad_tolerance)

    if start is None and p.shape[1]:  # the least-squares polynomial; where it is all there is, no kernel acts
        c = np.linalg.lstsq(p, v, rcond=None)[0]
        start = np.concatenate((np.zeros(len(v)), c))
        if within(p @ c - v):
            return start
    elif p.shape[1]:
        q = np.linalg.qr(p)[0]
        start[: len(v)] -= q @ (q.T @ start[: len(v)])
    goal, right, fast = np.sqrt(len(b)) * max(tolerance, grad_tolerance), schwarz(model, x, g), far_map(model, x, g, spark)
    start, steps = np.zeros(len(b)) if start is None else start, 0
    if fast is not None:  # rounds of steps with approximate sums, each on the exact residual of the round before
        r = b - apply(start)
        while not within(r) and steps < max_iter:
            before = float(np.linalg.norm(r))
            for k, (more, left) in enumerate(fgmres(fast, r, max_iter - steps, None, both=lambda q: right(q, fast, apply))):
                if left <= max(ROUND * before, min(goal / 40, before / 10)):  # the largest residual is many times their root mean square
                    break
            steps += k
            after = b - apply(start + more)
            if not np.linalg.norm(after) <= before / 2:
                break  # too coarse: exact sums take over
            start, r = start + more, after
        if within(r):
            return start
    for w, norm in fgmres(apply, b, max_iter - steps, start, both=lambda q: right(q, apply, apply)):
        if norm > goal * 1.01:
            continue  # some residual is too large
        if within(b - apply(w)):
            return w
    raise RuntimeError(f"no convergence in {max_iter} steps")


def training(points: DataFrame, value: str = "v", on: list[str] | None = None, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The training rows of a fit on the driver, by id; their number is checked."""
    on = on or axes(points)
    if points.count() > most:
        raise ValueError(f"a fit takes at most {most} rows")
    rows = points.orderBy("id").select(*(F.col(a).cast("double") for a in on), F.col(value).cast("double")).toArrow()
    return np.stack([rows.column(k).to_numpy() for k in range(len(on))], 1), rows.column(len(on)).to_numpy()


def cross_validate(model: Model, points: DataFrame, value: str = "v", fold: str = "fold", tolerance: float = 1e-6, name: str = "prediction") -> DataFrame:
    """points with a prediction for each row by a fit on the rows of the other folds. Folds run in parallel."""
    on = axes(points)
    x, v = training(points, value, on)
    folds = np.array([r[0] for r in points.orderBy("id").select(fold).collect()])
    shared = points.sparkSession.sparkContext.broadcast((x, v, folds))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, v, folds = shared.value
        rest = folds != key[0].as_py()
        f = Interpolant(model).fit(x[rest], v[rest], tolerance)
        at = np.stack([table.column(a).cast(pa.float64()).to_numpy() for a in on], 1)
        return table.append_column(name, pa.array(f.values(at)))

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema), f"`{name}` double"])
    return points.groupBy(fold).applyInArrow(run, kinds)
