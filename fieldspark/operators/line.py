"""Exact fits and sums on a line in time proportional to n log n, for one exponential or one linear (bh3 with c = 0) kernel.

Both kernels are Markov in one dimension: the inverse of the matrix over sorted centres (for the linear kernel, of weights that add up to
zero) is tridiagonal, and the sums from the left and from the right are carried from centre to centre. Nothing is approximated.
"""

from __future__ import annotations

import numpy as np

from ..functions import polynomial as P
from ..model import Model


def serves(model: Model, x: np.ndarray, g: np.ndarray) -> bool:
    """Whether sums over these centres can be carried along the line."""
    if x.shape[1] != 1 or len(g) or len(model.rbfs) != 1 or not len(x) or not np.isfinite(x).all():
        return False
    r = model.rbfs[0]
    return _rate(model) > 0 and (r.name == "exp" or (r.name == "bh3" and r.params[1] == 0)) and r.params[0] > 0


def _rate(model: Model) -> float:
    """The decay of the exponential kernel over a unit of length, the scale of the linear one."""
    r = model.rbfs[0]
    a = abs(float(r.matrix(1)[0, 0]))
    if r.name == "exp":
        return 3.0 * a / r.params[1] if r.params[1] > 0 else 0.0
    return a * r.params[0]


def _carried(start: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """s[i] = factor[i] s[i - 1] + start[i], by doubling; factor[0] is not used."""
    s, f, step = start.copy(), factor.copy(), 1
    f[0] = 0.0
    while step < len(s) and f.any():
        s[step:] += f[step:] * s[:-step]
        f[step:] *= f[:-step].copy()
        f[:step] = 0.0
        step *= 2
    return s


class LineSum:
    """The sum of the model's kernel over weighted centres, and its slope."""

    def __init__(self, model: Model, x: np.ndarray, w: np.ndarray):
        order = np.argsort(x[:, 0], kind="stable")
        self.x, w, self.rate, self.name = x[order, 0], w[order], _rate(model), model.rbfs[0].name
        gap = np.diff(self.x, prepend=self.x[:1])
        back = np.append(gap[1:], 0.0)[::-1]
        if self.name == "exp":
            self.sill = model.rbfs[0].params[0]
            self.left = _carried(w, np.exp(-self.rate * gap))
            self.right = _carried(w[::-1], np.exp(-self.rate * back))[::-1]
        else:  # weights so far, and their distances
            w = w.astype(np.longdouble)  # sums of sums
            self.left_w, self.right_w = np.cumsum(w), np.cumsum(w[::-1])[::-1]
            self.left = np.cumsum(gap * np.append(0.0, self.left_w[:-1]))
            self.right = np.cumsum(back * np.append(0.0, self.right_w[::-1][:-1]))[::-1]

    def _at(self, a: np.ndarray, i: np.ndarray) -> np.ndarray:
        ok = (i >= 0) & (i < len(a))
        return np.where(ok, a[np.clip(i, 0, len(a) - 1)], 0.0)

    def _near(self, t: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The last centre before t (or at it, by side right) and the first after it, with their distances."""
        i, j = np.searchsorted(self.x, t, side) - 1, np.searchsorted(self.x, t, "right")
        return i, j, np.where(i >= 0, t - self._at(self.x, i), 0.0), np.where(j < len(self.x), self._at(self.x, j) - t, 0.0)

    def values(self, t: np.ndarray) -> np.ndarray:
        i, j, p, q = self._near(t, "right")
        if self.name == "exp":
            return self.sill * (self._at(self.left, i) * np.exp(-self.rate * p) + self._at(self.right, j) * np.exp(-self.rate * q))
        return (-self.rate * (self._at(self.left, i) + p * self._at(self.left_w, i) + self._at(self.right, j) + q * self._at(self.right_w, j))).astype(float)

    def slopes(self, t: np.ndarray) -> np.ndarray:
        """A centre has no slope at itself."""
        i, j, p, q = self._near(t, "left")
        if self.name == "exp":
            return self.rate * self.sill * (self._at(self.right, j) * np.exp(-self.rate * q) - self._at(self.left, i) * np.exp(-self.rate * p))
        return (self.rate * (self._at(self.right_w, j) - self._at(self.left_w, i))).astype(float)


def _inverse(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the tridiagonal inverse over sorted, distinct places."""
    h, rate = np.diff(x), _rate(model)
    if model.rbfs[0].name == "exp":
        less = -np.expm1(-2.0 * rate * h)
        side = -np.exp(-rate * h) / less
        more = np.exp(-2.0 * rate * h) / less
        diag = np.ones(len(x))
        diag[:-1] += more
        diag[1:] += more
        return diag / model.rbfs[0].params[0], side / model.rbfs[0].params[0]
    side = -0.5 / (rate * h)
    diag = np.zeros(len(x))
    diag[:-1] -= side
    diag[1:] -= side
    return diag, side


def _times(diag: np.ndarray, side: np.ndarray, v: np.ndarray) -> np.ndarray:
    """By differences of neighbours, so that equal values far from zero don't cancel."""
    out = v * (diag + np.append(side, 0.0) + np.append(0.0, side))[:, None]
    step = side[:, None] * np.diff(v, axis=0)
    out[:-1] += step
    out[1:] -= step
    return out


def _bends(x: np.ndarray, f: np.ndarray, rate: float) -> np.ndarray:
    """Weights of the linear kernel for the values f, but for a constant; each makes up for what rounding did to those before it."""
    want, gap = f.astype(np.longdouble), np.diff(x)
    want = (want[0] - want) / (2 * rate)  # sums from the left
    out, total, at = np.empty(len(x)), np.longdouble(0), np.longdouble(0)
    for i, h in enumerate(gap):
        out[i] = (want[i + 1] - at) / h - total
        total += out[i]
        at += h * total
    out[-1] = -total
    return out


def _tridiagonal(diag: np.ndarray, side: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The solution for a symmetric, definite, tridiagonal matrix."""
    d, s, out = diag.tolist(), side.tolist(), [np.array(r) for r in v]
    for i in range(1, len(d)):
        m = s[i - 1] / d[i - 1]
        d[i] -= m * s[i - 1]
        out[i] = out[i] - m * out[i - 1]
    out[-1] = out[-1] / d[-1]
    for i in range(len(d) - 2, -1, -1):
        out[i] = (out[i] - s[i] * out[i + 1]) / d[i]
    return np.stack(out)


def solve(model: Model, x: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """Weights and polynomial of the fit to v at x; None if places repeat."""
    order = np.argsort(x[:, 0], kind="stable")
    t = x[order, 0]
    if (np.diff(t) <= 0).any():
        return None
    diag, side = _inverse(model, t)
    p = P.design(x[order], model.degree)
    linear = model.rbfs[0].name == "bh3"  # its inverse takes no notice of a constant
    scale = np.maximum(np.abs(p).max(0, initial=0), 1e-300)
    free = (p / scale)[:, 1:] if linear else p / scale
    both = np.concatenate((v[order, None], free), 1)
    if model.nugget:
        both = _tridiagonal(1.0 + model.nugget * diag, model.nugget * side, both)
    got = _times(diag, side, both)
    if free.shape[1]:
        c = np.linalg.lstsq(free.T @ got[:, 1:], free.T @ got[:, 0], rcond=None)[0]
        w = got[:, 0] - got[:, 1:] @ c
    else:
        c, w = np.zeros(0), got[:, 0]
    if linear:
        w = _bends(t, both[:, 0] - both[:, 1:] @ c, _rate(model))
        rest = v[order] - LineSum(model, t[:, None], w).values(t) - model.nugget * w - free @ c
        c = np.append(rest.mean(), c)
    out = np.empty(len(x))
    out[order] = w
    return np.concatenate((out, c / scale))
