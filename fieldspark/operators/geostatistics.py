"""Experimental variograms, detrending, normal scores, weights and variogram model fitting."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polynomial as P
from ..functions.scalar import inv_normal_cdf
from ..geometry import axes
from ..model import Model
from .neighbors import range_join

ISOTROPIC = "isotropic"


def directions(dim: int, kind: str = ISOTROPIC) -> list[tuple[float, ...]]:
    """Isotropic: the first axis, for all pairs. Anisotropic: 1, 8 (every 22.5 degrees) or 46 directions."""
    if kind == ISOTROPIC or dim == 1:
        return [(1.0, *[0.0] * (dim - 1))]
    if dim == 2:
        return [(float(np.cos(k * np.pi / 8)), float(np.sin(k * np.pi / 8))) for k in range(8)]
    return [tuple(map(float, d)) for d in _half_icosphere()]


def _half_icosphere() -> np.ndarray:
    """One of each two opposite vertices of an icosahedron (a vertex at each pole) whose edges are cut in three: 46 of 92."""
    t = np.arange(5) * 0.4 * np.pi
    ring = np.stack((2 * np.cos(t), 2 * np.sin(t), np.ones(5)), 1) / np.sqrt(5)
    corners = np.concatenate(([[0.0, 0.0, 1.0]], ring, [[0.0, 0.0, -1.0]], -ring))
    near = corners @ corners.T > 0.4  # neighbours: cosine 1 / sqrt(5)
    edges = [(i, j) for i in range(12) for j in range(12) if i != j and near[i, j]]
    centres = [(i, j, k) for i, j in edges for k in range(12) if i < j < k and near[i, k] and near[j, k]]
    x = np.concatenate((corners, [2 * corners[i] + corners[j] for i, j in edges], [corners[list(f)].sum(0) for f in centres]))
    x = np.round(x / np.linalg.norm(x, axis=1)[:, None], 15) + 0.0
    up = [v for v in x if tuple(v[::-1]) > (0.0, 0.0, 0.0)]
    return np.array(sorted(up, key=lambda v: (-v[2], np.arctan2(v[1], v[0]))))


def variogram(points: DataFrame, lag: float, lags: int, value: str = "v", lag_tolerance: float | None = None, angle_tolerance: float | None = None, along: list[tuple[float, ...]] | None = None, on: list[str] | None = None) -> DataFrame:
    """direction, dx[, dy[, dz]], bin, bin_distance, bin_gamma, num_pairs.

    A pair falls in each bin k with |distance - k lag| <= lag_tolerance. Directions: each pair to the one with the largest squared
    cosine, or with angle_tolerance (radians) to each within it; signs don't matter. Pairs beyond the last bin never meet: the
    join is on grid cells of that reach.
    """
    on = on or axes(points)
    tol = lag / 2 if lag_tolerance is None else lag_tolerance
    along = along or directions(len(on))
    along = [tuple(float(c) for c in np.array(d, float) / np.linalg.norm(d)) for d in along]
    coords = points.select("id", *(F.col(c).cast("double").alias(c) for c in on), F.col(value).cast("double").alias("v")).dropna()
    p = range_join(coords, coords, (lags - 1) * lag + tol, on, [*on, "v"]).where("id < other")
    dots = [sum((F.lit(d[i]) * (F.col(f"b{c}") - F.col(f"a{c}")) for i, c in enumerate(on)), F.lit(0.0)) for d in along]
    sq = F.array(*(d * d for d in dots))
    if len(along) == 1 and angle_tolerance is None:
        p = p.withColumn("direction", F.lit(0))
    elif angle_tolerance is None:
        p = p.withColumn("direction", (F.array_position(sq, F.array_max(sq)) - 1).cast("int"))
    else:
        least = F.col("distance") * F.col("distance") * float(np.cos(angle_tolerance) ** 2)
        p = p.withColumn("direction", F.explode(F.filter(F.transform(sq, lambda s, i: F.when(s >= least, i)), lambda i: i.isNotNull())))
    lo = F.greatest(F.ceil((F.col("distance") - tol) / lag), F.lit(0)).cast("int")
    hi = F.least(F.floor((F.col("distance") + tol) / lag), F.lit(lags - 1)).cast("int")
    p = p.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("bin", F.explode(F.sequence("lo", "hi")))
    half = (F.col("av") - F.col("bv")) * (F.col("av") - F.col("bv")) / 2
    out = p.groupBy("direction", "bin").agg(F.avg("distance").alias("bin_distance"), F.avg(half).alias("bin_gamma"), F.count(F.lit(1)).alias("num_pairs"))
    unit = F.array(*(F.array(*map(F.lit, d)) for d in along))
    return out.select("direction", *(F.element_at(F.element_at(unit, F.col("direction") + 1), i + 1).alias("d" + c) for i, c in enumerate(on)), "bin", "bin_distance", "bin_gamma", "num_pairs")


def merge_variograms(parts: DataFrame) -> DataFrame:
    """Variograms of disjoint pair sets, added up bin by bin (means weighted by pairs)."""
    keys = [c for c in parts.columns if c not in ("bin_distance", "bin_gamma", "num_pairs")]
    n = F.sum("num_pairs")
    return parts.groupBy(*keys).agg((F.sum(F.col("bin_distance") * F.col("num_pairs")) / n).alias("bin_distance"), (F.sum(F.col("bin_gamma") * F.col("num_pairs")) / n).alias("bin_gamma"), n.alias("num_pairs"))


def counts(variograms: DataFrame) -> DataFrame:
    return variograms.agg(F.countDistinct("direction").alias("num_variograms"), F.count(F.lit(1)).alias("num_bins"), F.coalesce(F.sum("num_pairs"), F.lit(0)).alias("num_pairs"))


def detrend(points: DataFrame, degree: int, value: str = "v", name: str = "residual", on: list[str] | None = None) -> DataFrame:
    """points with the residual of a least-squares polynomial: one aggregate of moments, a small solve, a projection."""
    on = on or axes(points)
    r = points.agg(*(F.avg(c) for c in on), *(F.greatest(F.stddev_pop(c), F.lit(1e-300)) for c in on)).first()
    d = len(on)
    if r[0] is None:
        return points.withColumn(name, F.lit(None).cast("double"))
    scaled = [(F.col(c).cast("double") - float(r[i])) / float(r[d + i] if r[d + i] > 1e-200 else 1.0) for i, c in enumerate(on)]
    b = P.columns(scaled, degree)
    n = len(b)
    m = points.agg(*(F.sum(b[i] * b[j]) for i in range(n) for j in range(i, n)), *(F.sum(c * F.col(value)) for c in b)).first()
    a, k = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = m[k]
            k += 1
    w = np.linalg.lstsq(a, np.array(m[k:], float), rcond=None)[0]
    return points.withColumn(name, F.col(value) - P.evaluate(scaled, degree, list(w)))


@dataclass(frozen=True)
class NormalScore:
    """Hermite coefficients of the transform from normal scores to values."""

    coefficients: tuple[float, ...]

    @staticmethod
    def _hermite(y, order: int) -> list:
        h = [F.lit(1.0), -y]
        for p in range(2, order + 1):
            h.append(-y * h[-1] / float(np.sqrt(p)) - h[-2] * float(np.sqrt((p - 1) / p)))
        return h[: order + 1]

    def back_transform(self, y):
        """A column of values for a column of scores: the recurrence unrolled as a fold, so that the expression stays linear in the order."""
        order = len(self.coefficients) - 1
        zero = F.struct(F.lit(float(self.coefficients[0])).alias("s"), F.lit(1.0).alias("h"), F.lit(0.0).alias("g"))
        terms = F.array(*(F.struct(F.lit(float(p)).alias("p"), F.lit(float(self.coefficients[p])).alias("c")) for p in range(1, order + 1)))

        def step(a, t):
            nxt = -y * a["h"] / F.sqrt(t["p"]) - a["g"] * F.sqrt((t["p"] - 1.0) / t["p"])
            return F.struct((a["s"] + t["c"] * nxt).alias("s"), nxt.alias("h"), a["h"].alias("g"))

        return F.aggregate(terms, zero, step, lambda a: a["s"]) if order else F.lit(float(self.coefficients[0]))

    def back_transform_gamma(self, gamma):
        return sum((float(c * c) * (1.0 - F.pow(1.0 - gamma, F.lit(float(p)))) for p, c in enumerate(self.coefficients) if p), F.lit(0.0))


def score_steps(points: DataFrame, value: str = "v", order: str = "id") -> DataFrame:
    """points with score and weight = half the difference of the neighbouring values (one-sided at the ends).

    The rank is global, but no task sorts all rows: rows are range-partitioned and numbered with the partitions' sizes.
    """
    from ..plans.tables import written

    spark = points.sparkSession
    parts = points.where(F.col(value).isNotNull()).repartitionByRange(value, order).withColumn("_part", F.spark_partition_id())
    parts = written(parts, spark)
    sizes = sorted((r._part, r.n) for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(s for _, s in sizes)
    if n < 2:
        raise ValueError("normal scores need two values at least")
    before, at = {}, 0
    for p, s in sizes:
        before[p], at = at, at + s
    w = Window.partitionBy("_part").orderBy(value, order)
    rank = F.row_number().over(w) + F.element_at(F.create_map(*(F.lit(int(x)) for kv in before.items() for x in kv)), F.col("_part"))
    ranked = parts.withColumn("_rank", rank)
    ranked = ranked.withColumn("_low", F.lag(value).over(w)).withColumn("_high", F.lead(value).over(w))
    # values across the edges of partitions: a row or two for each
    edge = {r._part: (r.lo, r.hi) for r in parts.groupBy("_part").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).collect()}
    keys = [p for p, _ in sizes]
    low = {p: edge[keys[i - 1]][1] for i, p in enumerate(keys) if i}
    high = {p: edge[keys[i + 1]][0] for i, p in enumerate(keys) if i + 1 < len(keys)}
    look = lambda m: F.try_element_at(F.create_map(*(F.lit(x) for k, v in m.items() for x in (int(k), float(v)))), F.col("_part")) if m else F.lit(None).cast("double")
    ranked = ranked.withColumn("_low", F.coalesce("_low", look(low))).withColumn("_high", F.coalesce("_high", look(high)))
    z = F.col(value)
    step = F.when(F.col("_low").isNull(), (z - F.col("_high")) / 2).when(F.col("_high").isNull(), (F.col("_low") - z) / 2).otherwise((F.col("_low") - F.col("_high")) / 2)
    score = inv_normal_cdf((2.0 * F.col("_rank") - 1.0) / (2.0 * n))
    return ranked.withColumn("score", score).withColumn("step", step).drop("_part", "_low", "_high")


def normal_score(points: DataFrame, value: str = "v", order: str = "id", hermite: int = 30) -> tuple[DataFrame, NormalScore]:
    """points with their normal score (ties by the order column), and the transform back."""
    steps = score_steps(points, value, order)

    def sums(batch_iter):
        for b in batch_iter:
            yv = b.column("score").to_numpy()
            g = b.column("step").to_numpy() * np.exp(-yv * yv / 2) / np.sqrt(2 * np.pi)
            h0, h1, out = np.ones_like(yv), -yv, []
            for p in range(1, hermite + 1):
                out.append(float((h0 * g).sum() / np.sqrt(p)))
                h0, h1 = h1, -yv * h1 / np.sqrt(p + 1) - h0 * np.sqrt(p / (p + 1))
            yield pa.RecordBatch.from_arrays([pa.array(range(1, hermite + 1), pa.int32()), pa.array(out)], names=["p", "c"])

    rows = steps.select("score", "step").mapInArrow(sums, "p int, c double").groupBy("p").agg(F.sum("c").alias("c")).orderBy("p").collect()
    mean = points.agg(F.avg(value)).first()[0]
    return steps.drop("_rank", "step"), NormalScore((float(mean), *(float(r.c) for r in rows)))


@dataclass(frozen=True)
class Weight:
    """distance^(a/2) gamma^(b/2) pairs^(c/2), as the weight of a squared residual is its square."""

    distance: float
    gamma: float
    pairs: float

    def column(self):
        return F.pow("bin_distance", F.lit(self.distance / 2)) * F.pow("model_gamma", F.lit(self.gamma / 2)) * F.pow("num_pairs", F.lit(self.pairs / 2))

    def array(self, d: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        return d ** (self.distance / 2) * g ** (self.gamma / 2) * n ** (self.pairs / 2)


#: Exponents of the six presets.
WEIGHTS = {
    "num_pairs": Weight(0, 0, 1), "num_pairs_over_distance_squared": Weight(-2, 0, 1), "num_pairs_over_model_gamma_squared": Weight(0, -2, 1),
    "one": Weight(0, 0, 0), "one_over_distance_squared": Weight(-2, 0, 0), "one_over_model_gamma_squared": Weight(0, -2, 0),
}


def model_variogram(variograms: DataFrame, model: Model) -> DataFrame:
    """With model_gamma: the nugget and what the kernels lose between 0 and the bin's distance along its direction."""
    if any(r.params[1] == 0 for r in model.rbfs):
        raise ValueError("a range must not be 0")
    on = [c for c in ("dx", "dy", "dz") if c in variograms.columns]
    g = F.lit(float(model.nugget))
    for r in model.rbfs:
        g = g + r.column(*(F.lit(0.0) for _ in on)) - r.column(*(F.col(c) * F.col("bin_distance") for c in on))
    return variograms.withColumn("model_gamma", g)


def residuals(variograms: DataFrame, model: Model, weight: Weight) -> DataFrame:
    return model_variogram(variograms, model).withColumn("residual", weight.column() * (F.col("bin_gamma") - F.col("model_gamma")))


def least_squares(f, x0: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 100) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt within bounds, with numeric derivatives; returns the point and half the sum of squares."""
    x = np.clip(x0, low, high)
    r = f(x)
    cost, damp = 0.5 * float(r @ r), 1e-3
    for _ in range(steps):
        h = np.maximum(np.abs(x), 1e-3) * 1e-6
        h = np.where(x + h > high, -h, h)
        j = np.stack([(f(x + h[i] * np.eye(len(x))[i]) - r) / h[i] for i in range(len(x))], 1)
        g = j.T @ r
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-12 * max(cost, 1e-300):
            break
        better = False
        for _ in range(12):
            a = j[:, free].T @ j[:, free]
            s = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g[free], rcond=None)[0]
            new = x.copy()
            new[free] = np.clip(x[free] + s, low[free], high[free])
            rn = f(new)
            c = 0.5 * float(rn @ rn)
            if np.isfinite(c) and c < cost:
                better = cost - c > 1e-12 * cost
                x, r, cost, damp = new, rn, c, max(damp / 5, 1e-12)
                break
            damp *= 5
        if not better:
            break
    return x, cost


def _rotation(dim: int, q: np.ndarray) -> np.ndarray:
    if dim == 2:
        c, s = np.cos(q[0]), np.sin(q[0])
        return np.array([[c, -s], [s, c]])
    w, x, y, z = q / max(np.linalg.norm(q), 1e-12)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def _fit_once(model: Model, bins: np.ndarray, dim: int, weight: Weight, aniso: bool, seed: int) -> tuple[Model, float]:
    rng = np.random.default_rng(seed)
    unit, d, g, n = bins[:, :dim], bins[:, dim], bins[:, dim + 1], bins[:, dim + 2]
    base = model.with_anisotropy(None)
    k, m = len(base.parameters), len(base.rbfs)
    turn = (1 if dim == 2 else 4) if aniso else 0
    low = np.concatenate((np.zeros(k), np.full(turn, -np.inf)))
    high = np.full(k + turn, np.inf)
    x0 = np.concatenate((base.parameters, rng.uniform(0, np.pi, 1) if dim == 2 else rng.normal(size=4)))[: k + turn] if aniso else np.array(base.parameters)
    if aniso:
        per = (1.0, 100.0, 1.0)
        extra = [per] * m if dim == 2 else [(0.01, 1.0, 1.0), per] * m
        low, high, x0 = (np.concatenate((a, [e[i] for e in extra])) for a, i in ((low, 0), (high, 1), (x0, 2)))
    low[2:k:2] = np.maximum(low[2:k:2], 1e-9 * max(d.max(initial=1.0), 1e-300))

    def build(x: np.ndarray) -> Model:
        out = base.with_parameters(np.maximum(x[:k], 0))
        if not aniso:
            return out
        rot = _rotation(dim, x[k : k + turn])
        rbfs = []
        for i, r in enumerate(out.rbfs):
            s = x[k + turn + i * (dim - 1) : k + turn + (i + 1) * (dim - 1)]
            scale = np.diag([1.0, s[0]] if dim == 2 else [s[0], 1.0, s[1]])
            rbfs.append(type(r)(r.name, r.params, tuple(map(tuple, scale @ rot.T))))
        return Model(tuple(rbfs), out.degree, out.nugget)

    def f(x: np.ndarray) -> np.ndarray:
        mod = build(x)
        mg = mod.nugget + mod.evaluate(np.zeros((1, dim)))[0] - mod.evaluate(unit * d[:, None])
        return weight.array(d, np.maximum(mg, 1e-300), n) * (g - mg)

    x, cost = least_squares(f, x0, low, high)
    return build(x), cost


def fit_variogram(variograms: DataFrame, model: Model, weight: Weight = WEIGHTS["num_pairs"], trials: int = 30, seed: int = 0) -> tuple[Model, float]:
    """The best of several seeded bounded least-squares fits, which run in parallel. With two (2D) or three (3D) directions and more, rotation and axes are fitted too."""
    on = [c for c in ("dx", "dy", "dz") if c in variograms.columns]
    dim = len(on)
    bins = np.array(variograms.select(*on, "bin_distance", "bin_gamma", "num_pairs").orderBy("direction", "bin").collect() if "direction" in variograms.columns else variograms.select(*on, "bin_distance", "bin_gamma", "num_pairs").collect(), float)
    if not len(bins):
        raise ValueError("no bins to fit")
    aniso = dim > 1 and len(np.unique(bins[:, :dim], axis=0)) >= dim
    spark = variograms.sparkSession

    def run(batches):
        for b in batches:
            for t in b.column("id").to_pylist():
                m, c = _fit_once(model, bins, dim, weight, aniso, seed + t)
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([m.to_json()]), pa.array([c])], names=["trial", "model", "cost"])

    n = trials if aniso else 1
    best = spark.range(0, n, 1, min(n, 16)).mapInArrow(run, "trial long, model string, cost double").orderBy("cost", "trial").first()
    return Model.from_json(best.model), best.cost
