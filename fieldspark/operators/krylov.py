"""Krylov solvers over any linear map: GMRES, flexible GMRES (right preconditioner) and MINRES, without restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

Map = Callable[[np.ndarray], np.ndarray]


def _arnoldi(apply: Map, b: np.ndarray, steps: int, x0: np.ndarray | None, left: Map | None, right: Map | None, both: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, float]]:
    x0 = np.zeros_like(b) if x0 is None else x0
    r = b - apply(x0)
    if left:
        r = left(r)
    beta = float(np.linalg.norm(r))
    yield x0, beta
    if beta == 0:
        return
    v, z, h = [r / beta], [], np.zeros((steps + 1, steps))
    for k in range(steps):
        q, w = both(v[k]) if both else (right(v[k]) if right else v[k], None)
        z.append(q)
        w = apply(q) if w is None else w
        if left:
            w = left(w)
        for _ in range(2):  # Gram-Schmidt twice
            for i in range(k + 1):
                c = float(v[i] @ w)
                h[i, k] += c
                w = w - c * v[i]
        h[k + 1, k] = np.linalg.norm(w)
        e = np.zeros(k + 2)
        e[0] = beta
        y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], e, rcond=None)
        yield x0 + sum(c * q for c, q in zip(y, z, strict=True)), float(np.linalg.norm(e - h[: k + 2, : k + 1] @ y))
        if h[k + 1, k] < 1e-14 * beta:
            return
        v.append(w / h[k + 1, k])


def gmres(apply: Map, b: np.ndarray, steps: int = 100, x0: np.ndarray | None = None, left: Map | None = None) -> Iterator[tuple[np.ndarray, float]]:
    """(solution, residual norm) after each step, the start included."""
    return _arnoldi(apply, b, steps, x0, left, None)


def fgmres(apply: Map, b: np.ndarray, steps: int = 100, x0: np.ndarray | None = None, right: Map | None = None, both: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, float]]:
    """The preconditioner may differ from step to step. both: what it gives, and that after the map, where the two share their work."""
    return _arnoldi(apply, b, steps, x0, None, right, both)


def minres(apply: Map, b: np.ndarray, steps: int = 100, x0: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, float]]:
    """For symmetric maps: short recurrences (Lanczos and Givens rotations)."""
    x = np.zeros_like(b) if x0 is None else x0.copy()
    v = b - apply(x)
    beta = float(np.linalg.norm(v))
    yield x, beta
    if beta == 0:
        return
    eta, old, v = beta, np.zeros_like(b), v / beta
    c0 = c1 = 1.0
    s0 = s1 = beta_k = 0.0
    w0 = w1 = np.zeros_like(b)
    for _ in range(steps):
        p = apply(v)
        alpha = float(v @ p)
        p = p - alpha * v - beta_k * old
        nxt = float(np.linalg.norm(p))
        d = c1 * alpha - c0 * s1 * beta_k
        r1, r2, r3 = float(np.hypot(d, nxt)), s1 * alpha + c0 * c1 * beta_k, s0 * beta_k
        if r1 == 0:
            return
        c, s = d / r1, nxt / r1
        w = (v - r3 * w0 - r2 * w1) / r1
        x = x + c * eta * w
        eta = -s * eta
        yield x, abs(eta)
        if nxt < 1e-14:
            return
        old, v, beta_k, c0, c1, s0, s1, w0, w1 = v, p / nxt, nxt, c1, c, s1, s, w1, w
