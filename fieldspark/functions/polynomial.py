"""Monomial and Lagrange bases of degree -1 to 2 in one to three dimensions."""

from __future__ import annotations

from itertools import combinations_with_replacement
from math import comb

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def size(dim: int, degree: int) -> int:
    return 0 if degree < 0 else comb(degree + dim, dim)


def terms(dim: int, degree: int) -> list[tuple[int, ...]]:
    """Index tuples in order: (), (0,), (1,), ..., (0, 0), (0, 1), ..."""
    if not -1 <= degree <= 2:
        raise ValueError("degree must be -1, 0, 1 or 2")
    return [t for k in range(degree + 1) for t in combinations_with_replacement(range(dim), k)]


def design(x: np.ndarray, degree: int) -> np.ndarray:
    return np.stack([np.prod([x[:, i] for i in t], axis=0) if t else np.ones(len(x)) for t in terms(x.shape[1], degree)], 1) if degree >= 0 else np.zeros((len(x), 0))


def gradient_design(x: np.ndarray, degree: int) -> np.ndarray:
    """Rows point by point, d rows each."""
    n, d = x.shape
    out = np.zeros((n, d, size(d, degree)))
    for b, t in enumerate(terms(d, degree)):
        for k, i in enumerate(t):
            rest = [x[:, j] for m, j in enumerate(t) if m != k]
            out[:, i, b] += np.prod(rest, axis=0) if rest else 1.0
    return out.reshape(n * d, size(d, degree))


def columns(coordinates: list[Column], degree: int) -> list[Column]:
    out = []
    for t in terms(len(coordinates), degree):
        c = F.lit(1.0)
        for i in t:
            c = c * coordinates[i]
        out.append(c)
    return out


def evaluate(coordinates: list[Column], degree: int, weights: list[float]) -> Column:
    return sum((float(w) * c for w, c in zip(weights, columns(coordinates, degree), strict=True)), F.lit(0.0))


class Lagrange:
    """The basis that is 1 at one point of a unisolvent set and 0 at the others."""

    def __init__(self, points: np.ndarray, degree: int):
        m = design(points, degree)
        if m.shape[0] != m.shape[1] or np.linalg.matrix_rank(m) < len(m):
            raise ValueError("the points are not unisolvent")
        self.degree, self.coefficients, self.rcond = degree, np.linalg.inv(m), 1 / np.linalg.cond(m) if len(m) else 1.0

    def evaluate(self, x: np.ndarray) -> np.ndarray:
        return design(x, self.degree) @ self.coefficients

    def columns(self, coordinates: list[Column]) -> list[Column]:
        return [evaluate(coordinates, self.degree, c) for c in self.coefficients.T]


def unisolvent(points: np.ndarray, degree: int) -> np.ndarray:
    """Indices of a well-conditioned unisolvent subset: pivoted Gram-Schmidt on the rows of the design matrix."""
    centre = points - points.mean(0)
    m = design(centre / max(np.abs(centre).max(), 1e-300), degree)
    chosen = []
    for _ in range(m.shape[1]):
        norms = (m * m).sum(1)
        i = int(norms.argmax())
        if norms[i] < 1e-24:
            raise ValueError("no unisolvent subset")
        q = m[i] / np.sqrt(norms[i])
        m = m - np.outer(m @ q, q)
        chosen.append(i)
    return np.array(sorted(chosen), int)
