"""Radial basis functions, written once for NumPy arrays and for Spark columns.

For each kernel: value f(r), slope g(r) = f'(r) / r and bend h(r) = g'(r) / r of the distance r after anisotropy, so that the gradient at a
difference d is g d and the Hessian is g I + h d d^T. Exponential, spherical and spheroidal slopes have no limit at r = 0 and give 0 there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Numpy:
    exp, log, sqrt, where = staticmethod(np.exp), staticmethod(np.log), staticmethod(np.sqrt), staticmethod(np.where)

    @staticmethod
    def pow(a, b):
        return a if b == 1 else a * a if b == 2 else a * a * a if b == 3 else np.power(a, b)


class _Spark:
    exp, log, sqrt, pow = staticmethod(F.exp), staticmethod(F.ln), staticmethod(F.sqrt), staticmethod(F.pow)

    @staticmethod
    def where(test: Column, a, b) -> Column:
        return F.when(test, a).otherwise(b)


@dataclass(frozen=True)
class Kernel:
    name: str
    order: int  # of conditional positive definiteness
    parameters: tuple[str, str]
    defaults: tuple[float | None, float | None]
    value: Callable
    slope: Callable
    bend: Callable | None
    compact: bool = False

    @property
    def covariance(self) -> bool:
        return self.order == 0


def _exponential() -> Kernel:
    def slope(o, r, s, a):
        q = o.where(r > 0, r, 1.0)
        return o.where(r > 0, -3.0 * s / (a * q) * o.exp(-3.0 * q / a), 0.0)

    def bend(o, r, s, a):
        q = o.where(r > 0, r, 1.0)
        return o.where(r > 0, o.exp(-3.0 * q / a) * (3.0 * s / (a * q * q * q) + 9.0 * s / (a * a * q * q)), 0.0)

    return Kernel("exp", 0, ("psill", "range"), (None, None), lambda o, r, s, a: s * o.exp(-3.0 * r / a), slope, bend)


def _gaussian() -> Kernel:
    e = lambda o, r, a: o.exp(-3.0 * r * r / (a * a))
    return Kernel("gau", 0, ("psill", "range"), (None, None), lambda o, r, s, a: s * e(o, r, a), lambda o, r, s, a: -6.0 * s / a**2 * e(o, r, a), lambda o, r, s, a: 36.0 * s / a**4 * e(o, r, a))


def _spherical() -> Kernel:
    def slope(o, r, s, a):
        q = o.where(r > 0, r, 1.0)
        return o.where((r > 0) & (r < a), s * (-1.5 + 1.5 * q * q / a**2) / (a * q), 0.0)

    return Kernel("sph", 0, ("psill", "range"), (None, None), lambda o, r, s, a: o.where(r < a, s * (1.0 - 1.5 * r / a + 0.5 * r * r * r / a**3), 0.0), slope, None, True)


def _cubic() -> Kernel:
    def value(o, r, s, a):
        q = r / a
        return o.where(r < a, s * (1.0 + q * q * (-7.0 + q * (8.75 + q * q * (-3.5 + 0.75 * q * q)))), 0.0)

    def slope(o, r, s, a):
        q = r / a
        return o.where(r < a, s / a**2 * (-14.0 + q * (26.25 + q * q * (-17.5 + 5.25 * q * q))), 0.0)

    return Kernel("cub", 0, ("psill", "range"), (None, None), value, slope, None, True)


def _tail(b: float, c: float, p: float):
    """b (1 + c q^2)^-p of q = r / range, with slope and bend."""
    base = lambda r, a: 1.0 + c * r * r / a**2
    return (
        lambda o, r, s, a: s * b * o.pow(base(r, a), -p),
        lambda o, r, s, a: -2.0 * p * c * b * s / a**2 * o.pow(base(r, a), -p - 1.0),
        lambda o, r, s, a: 4.0 * p * (p + 1.0) * c * c * b * s / a**4 * o.pow(base(r, a), -p - 2.0),
    )


def _cauchy(n: int, c: float) -> Kernel:
    return Kernel(f"gc{n}", 0, ("psill", "range"), (None, None), *_tail(1.0, c, n / 2))


def _spheroidal(n: int, edge: float, a0: float, b: float, c: float) -> Kernel:
    f, g, h = _tail(b, c, n / 2)

    def slope(o, r, s, a):
        q = o.where(r > 0, r, 1.0)
        return o.where(r < edge * a, o.where(r > 0, -s * a0 / (a * q), 0.0), g(o, r, s, a))

    def bend(o, r, s, a):
        q = o.where(r > 0, r, 1.0)
        return o.where(r < edge * a, o.where(r > 0, s * a0 / (a * q * q * q), 0.0), h(o, r, s, a))

    return Kernel(f"sp{n}", 0, ("psill", "range"), (None, None), lambda o, r, s, a: o.where(r < edge * a, s * (1.0 - a0 * r / a), f(o, r, s, a)), slope, bend)


def _even(name: str, k: int, order: int) -> Kernel:
    sign = 1.0 if k == 2 else -1.0

    def parts(o, r, c):
        p = o.sqrt(r * r + c * c)
        return p, o.where(p > 0, p, 1.0)

    def value(o, r, s, c):
        p, q = parts(o, r, c)
        return o.where(p > 0, sign * s * o.pow(q, float(k)) * o.log(q), 0.0)

    def slope(o, r, s, c):
        p, q = parts(o, r, c)
        return o.where(p > 0, sign * s * o.pow(q, k - 2.0) * (k * o.log(q) + 1.0), 0.0)

    def bend(o, r, s, c):
        p, q = parts(o, r, c)
        return o.where(p > 0, sign * s * o.pow(q, k - 4.0) * ((k - 2.0) * (k * o.log(q) + 1.0) + k), 0.0)

    return Kernel(name, order, ("scale", "c"), (1.0, 0.0), value, slope, bend)


def _odd(name: str, k: int, order: int) -> Kernel:
    sign = -1.0 if k == 1 else 1.0

    def value(o, r, s, c):
        return sign * s * o.pow(o.sqrt(r * r + c * c) if c else r, float(k))

    def power(o, r, c, e):
        p = o.sqrt(r * r + c * c)
        q = o.where(p > 0, p, 1.0)
        return o.where(p > 0, o.pow(q, e), 0.0)

    return Kernel(name, order, ("scale", "c"), (1.0, 0.0), value, lambda o, r, s, c: sign * s * k * power(o, r, c, k - 2.0), lambda o, r, s, c: sign * s * k * (k - 2.0) * power(o, r, c, k - 4.0))


#: Coefficients of the Cauchy kernels, and edge, slope and tail coefficients of the spheroidal ones.
KERNELS: dict[str, Kernel] = {
    k.name: k
    for k in (
        _even("bh2", 2, 2), _even("th2", 4, 3), _odd("bh3", 1, 1), _odd("th3", 3, 2), _exponential(), _gaussian(), _spherical(), _cubic(),
        _cauchy(3, 7.0), _cauchy(5, 2.4822022531844965), _cauchy(7, 1.438027308408951), _cauchy(9, 1.0),
        _spheroidal(3, 0.18657871684006438, 2.009875543958482, 0.8734640537108553, 7.181510581693163),
        _spheroidal(5, 0.2580127411803573, 1.6149073288415876, 0.8575980168032007, 2.5036086535164204),
        _spheroidal(7, 0.2944149476843637, 1.4859979204216045, 0.8494862533016855, 1.44208314742683),
        _spheroidal(9, 0.31622776601683794, 1.4230249470757708, 0.8445585690332554, 1.0),
    )
}


@dataclass(frozen=True)
class Rbf:
    """A kernel with its two parameters and an anisotropy matrix (identity by default)."""

    name: str
    params: tuple[float, ...] = ()
    aniso: tuple[tuple[float, ...], ...] | None = field(default=None)

    def __post_init__(self):
        if self.name not in KERNELS:
            raise ValueError(f"no kernel {self.name!r}")
        k = self.kernel
        p = tuple(self.params[i] if i < len(self.params) else k.defaults[i] for i in range(2))
        if None in p or len(self.params) > 2 or p[0] < 0 or p[1] < 0:
            raise ValueError(f"{self.name} takes {k.parameters} >= 0, not {self.params}")
        object.__setattr__(self, "params", tuple(map(float, p)))

    @property
    def kernel(self) -> Kernel:
        return KERNELS[self.name]

    @property
    def support_radius(self) -> float:
        return self.params[1] if self.kernel.compact else float("inf")

    def matrix(self, d: int) -> np.ndarray:
        return np.eye(d) if self.aniso is None else np.array(self.aniso, float)

    # NumPy: differences (..., d) ------------------------------------------------------------
    def evaluate(self, diff: np.ndarray) -> np.ndarray:
        x = diff @ self.matrix(diff.shape[-1]).T
        return self.kernel.value(_Numpy, np.sqrt((x * x).sum(-1)), *self.params)

    def gradient(self, diff: np.ndarray) -> np.ndarray:
        a = self.matrix(diff.shape[-1])
        x = diff @ a.T
        return (self.kernel.slope(_Numpy, np.sqrt((x * x).sum(-1)), *self.params)[..., None] * x) @ a

    def hessian(self, diff: np.ndarray) -> np.ndarray:
        if self.kernel.bend is None:
            raise ValueError(f"{self.name} has no Hessian")
        a = self.matrix(diff.shape[-1])
        x = diff @ a.T
        r = np.sqrt((x * x).sum(-1))
        iso = self.kernel.slope(_Numpy, r, *self.params)[..., None, None] * np.eye(x.shape[-1]) + self.kernel.bend(_Numpy, r, *self.params)[..., None, None] * x[..., :, None] * x[..., None, :]
        return a.T @ iso @ a

    # Spark columns --------------------------------------------------------------------------
    def _moved(self, diff: list[Column]) -> tuple[list[Column], Column]:
        a = self.matrix(len(diff))
        x = diff if self.aniso is None else [sum((float(a[i, j]) * diff[j] for j in range(len(diff))), F.lit(0.0)) for i in range(len(diff))]
        return x, F.sqrt(sum((c * c for c in x), F.lit(0.0)))

    def column(self, *diff: Column) -> Column:
        return self.kernel.value(_Spark, self._moved(list(diff))[1], *self.params)

    def gradient_columns(self, *diff: Column) -> list[Column]:
        x, r = self._moved(list(diff))
        g, a = self.kernel.slope(_Spark, r, *self.params), self.matrix(len(diff))
        return [sum((g * x[i] * float(a[i, j]) for i in range(len(x))), F.lit(0.0)) for j in range(len(x))]

    def hessian_columns(self, *diff: Column) -> list[list[Column]]:
        if self.kernel.bend is None:
            raise ValueError(f"{self.name} has no Hessian")
        x, r = self._moved(list(diff))
        g, h, a, d = self.kernel.slope(_Spark, r, *self.params), self.kernel.bend(_Spark, r, *self.params), self.matrix(len(diff)), range(len(diff))
        own = [[h * x[k] * x[m] + (g if k == m else F.lit(0.0)) for m in d] for k in d]
        return [[sum((float(a[k, i] * a[m, j]) * own[k][m] for k in d for m in d if a[k, i] * a[m, j]), F.lit(0.0)) for j in d] for i in d]


def on_arrays(rbf: Rbf) -> Callable:
    """The kernel as a function of an array of distances, after anisotropy."""
    return lambda r: rbf.kernel.value(_Numpy, r, *rbf.params)


def spheroidal_edge(rbf: Rbf) -> float:
    """Where the direct part ends."""
    return _SPHEROIDAL[rbf.name][0] * rbf.params[1]


def split_spheroidal(rbf: Rbf) -> tuple[Callable, Callable]:
    """The direct part (zero beyond the edge) and the smooth part, whose sum is the kernel; both of r."""
    k, (s, a) = rbf.kernel, rbf.params
    edge, _, b, c = _SPHEROIDAL[rbf.name]
    smooth = _tail(b, c, int(rbf.name[2:]) / 2)[0]
    return (lambda r: np.where(r < edge * a, k.value(_Numpy, r, s, a) - smooth(_Numpy, r, s, a), 0.0)), (lambda r: smooth(_Numpy, r, s, a))


#: Edge, slope and tail coefficients by kernel, as above.
_SPHEROIDAL = {
    "sp3": (0.18657871684006438, 2.009875543958482, 0.8734640537108553, 7.181510581693163),
    "sp5": (0.2580127411803573, 1.6149073288415876, 0.8575980168032007, 2.5036086535164204),
    "sp7": (0.2944149476843637, 1.4859979204216045, 0.8494862533016855, 1.44208314742683),
    "sp9": (0.31622776601683794, 1.4230249470757708, 0.8445585690332554, 1.0),
}
