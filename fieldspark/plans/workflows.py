"""Whole workflows as compositions of operators: what a command line runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..geometry import Bbox
from ..model import Model
from ..operators import geostatistics as S
from ..operators import isosurface as I
from ..operators import pointcloud as C
from ..operators.interpolation import Interpolant, training


def experimental_variogram(points: DataFrame, lag: float, lags: int, trend: int | None = None, scores: bool = False, **options) -> DataFrame:
    """Detrend, normal scores, variogram, gammas back to data units, in that order."""
    df = points
    if trend is not None:
        df = S.detrend(df, trend).drop("v").withColumnRenamed("residual", "v")
    back = None
    if scores:
        df, back = S.normal_score(df)
        df = df.drop("v").withColumnRenamed("score", "v")
    out = S.variogram(df, lag, lags, **options)
    return out if back is None else out.withColumn("bin_gamma", back.back_transform_gamma(F.col("bin_gamma")))


def normals(points: DataFrame, ks: list[int] | None = None, radii: list[float] | None = None, threshold: float = 1.8, closed: int | None = None, toward: tuple | None = None, direction: tuple | None = None) -> DataFrame:
    out = C.normals_radius(points, radii) if radii else C.normals_knn(points, ks or [10, 30, 100, 300])
    out = C.filter_by_plane_factor(out, threshold)
    if closed:
        return C.orient_closed_surface(out, closed)
    if toward:
        return C.orient_toward_point(out, toward)
    return C.orient_toward_direction(out, direction) if direction else out


def offset_surface(spark: SparkSession, mesh: I.Mesh, sides: np.ndarray, offset: float, bbox: Bbox, resolution: float, model: Model) -> I.Mesh:
    """A surface at a distance from a mesh that keeps given points (x, y, z, side) on, below or above it."""
    a, b, c = (mesh.vertices[mesh.faces[:, k]] for k in range(3))
    near = np.array([(lambda q: q[((q - p) ** 2).sum(1).argmin()])(I.closest_on_triangles(p, a, b, c)) for p in sides[:, :3]])
    gap = np.linalg.norm(sides[:, :3] - near, axis=1) - offset
    side = sides[:, 3]
    nan = np.full(len(side), np.nan)
    f = Interpolant(model).fit_inequality(near, np.where(side == 0, gap, nan), np.where(side < 0, gap, nan), np.where(side > 0, gap, nan))

    def value(x: np.ndarray) -> np.ndarray:
        q = np.array([(lambda q: q[((q - p) ** 2).sum(1).argmin()])(I.closest_on_triangles(p, a, b, c)) for p in x])
        return np.linalg.norm(x - q, axis=1) - offset - f.values(q)

    def field(df: DataFrame) -> DataFrame:
        kinds = ", ".join([*(f"`{s.name}` {s.dataType.simpleString()}" for s in df.schema), "value double"])

        def run(batches):
            for t in batches:
                t = t.copy()
                t["value"] = value(t[["x", "y", "z"]].to_numpy()) if len(t) else []
                yield t

        return df.mapInPandas(run, kinds)

    return I.generate(spark, bbox, resolution, field, 0.0, local=value)


def fit_table(points: DataFrame, model: Model, tolerance: float, reduce: bool = False, spark: SparkSession | None = None) -> Interpolant:
    x, v = training(points)
    f = Interpolant(model)
    return f.fit_incrementally(x, v, tolerance) if reduce else f.fit(x, v, tolerance, spark=spark)
