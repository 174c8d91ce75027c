"""Boxes, linear maps and anisotropy over coordinate columns and small matrices."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def axes(df: DataFrame) -> list[str]:
    """Coordinate columns of a point table."""
    return [a for a in AXES if a in df.columns]


@dataclass(frozen=True)
class Bbox:
    low: tuple[float, ...]
    high: tuple[float, ...]

    @classmethod
    def of(cls, points: DataFrame, on: list[str] | None = None) -> Bbox:
        on = on or axes(points)
        r = points.agg(*(F.min(a) for a in on), *(F.max(a) for a in on)).first()
        n = len(on)
        return cls.empty(n) if r[0] is None else cls(tuple(map(float, r[:n])), tuple(map(float, r[n:])))

    @classmethod
    def empty(cls, dim: int) -> Bbox:
        return cls((np.inf,) * dim, (-np.inf,) * dim)

    @classmethod
    def from_points(cls, x: np.ndarray) -> Bbox:
        return cls(tuple(x.min(0)), tuple(x.max(0))) if len(x) else cls.empty(x.shape[1])

    def is_empty(self) -> bool:
        return any(a > b for a, b in zip(self.low, self.high, strict=True))

    def center(self) -> np.ndarray:
        return (np.array(self.low) + self.high) / 2

    def width(self) -> np.ndarray:
        return np.array(self.high) - self.low

    def convex_hull(self, other: Bbox) -> Bbox:
        return Bbox(tuple(np.minimum(self.low, other.low)), tuple(np.maximum(self.high, other.high)))

    def corners(self) -> np.ndarray:
        return np.array(list(product(*zip(self.low, self.high, strict=True))))

    def transform(self, t: np.ndarray) -> Bbox:
        return Bbox.from_points(self.corners() @ np.asarray(t).T)

    def contains(self, x: np.ndarray) -> np.ndarray:
        return ((x >= self.low) & (x <= self.high)).all(-1)

    def inside(self, on: list[str]) -> Column:
        c = F.lit(True)
        for a, lo, hi in zip(on, self.low, self.high, strict=True):
            c = c & F.col(a).between(lo, hi)
        return c


def transform(df: DataFrame, t: np.ndarray, on: list[str] | None = None) -> DataFrame:
    """Points (or vectors) as rows times the transposed matrix."""
    on = on or axes(df)
    t = np.asarray(t, float)
    new = [sum((float(t[i, j]) * F.col(on[j]) for j in range(len(on))), F.lit(0.0)) for i in range(len(on))]
    return df.withColumns(dict(zip(on, new, strict=True)))


def decompose_inverse_anisotropy(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and scales of the inverse of a, from the eigenvectors of its square; scales descend, the rotation is proper."""
    a = np.asarray(a, float)
    if np.linalg.det(a) <= 0:
        raise ValueError("an anisotropy must have a positive determinant")
    w, v = np.linalg.eigh(a.T @ a)
    if np.linalg.det(v) < 0:
        v[:, -1] *= -1
    return v, 1 / np.sqrt(w)


def orthonormalize(m: np.ndarray) -> np.ndarray:
    """Columns as by Gram-Schmidt: the QR factor with a positive diagonal."""
    q, r = np.linalg.qr(m)
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def stack_columns(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.join(b, key)


def stack_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def gather(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def complement(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def where(df: DataFrame, test: Column, key: str = "id") -> DataFrame:
    """Ids of the rows that pass; null and NaN don't."""
    return df.where(F.coalesce(test, F.lit(False))).select(key)


def zip_sort(keys: Column | str, values: Column | str) -> tuple[Column, Column]:
    """Two array columns of one length in the order of the first; equal keys by value."""
    both = F.array_sort(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))))
    return both["k"], both["v"]
