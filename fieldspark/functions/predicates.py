"""Geometric predicates as plain arithmetic, for numbers, NumPy arrays and Spark columns; angles of triangles in arrays.

Determinants are not exact: near zero their sign is that of rounding, so callers compare them with a tolerance.
"""

from __future__ import annotations

import numpy as np


def orient2d(a: tuple, b: tuple, c: tuple):
    """Twice the signed area of a triangle: positive if it runs counter-clockwise."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def orient3d(a: tuple, b: tuple, c: tuple, d: tuple):
    """Six times the signed volume of a tetrahedron: positive if a, b, c run counter-clockwise seen from d."""
    u, v, w = ([p[k] - a[k] for k in range(3)] for p in (b, c, d))
    return w[0] * (u[1] * v[2] - u[2] * v[1]) + w[1] * (u[2] * v[0] - u[0] * v[2]) + w[2] * (u[0] * v[1] - u[1] * v[0])


def incircle(a: tuple, b: tuple, c: tuple, d: tuple):
    """Positive if d lies inside the circle through the counter-clockwise a, b, c."""
    u, v, w = ((p[0] - d[0], p[1] - d[1]) for p in (a, b, c))
    lift = [p[0] * p[0] + p[1] * p[1] for p in (u, v, w)]
    return lift[0] * (v[0] * w[1] - v[1] * w[0]) + lift[1] * (w[0] * u[1] - w[1] * u[0]) + lift[2] * (u[0] * v[1] - u[1] * v[0])


def min_angle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The smallest angle of each triangle, in radians; 0 where two corners coincide."""
    found = []
    for p, q, r in ((a, b, c), (b, c, a), (c, a, b)):
        u, v = q - p, r - p
        size = np.linalg.norm(u, axis=-1) * np.linalg.norm(v, axis=-1)
        cos = (u * v).sum(-1) / np.where(size > 0, size, 1.0)
        found.append(np.where(size > 0, np.arccos(np.clip(cos, -1, 1)), 0.0))
    return np.min(found, axis=0)
