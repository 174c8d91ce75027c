"""Scalar functions over columns: the inverse normal distribution function, number parsing and printing, bits, error norms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rational coefficients of Wichura's algorithm AS 241 (PPND16).
A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
G = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _poly(c: tuple, x):
    out = F.lit(c[-1])
    for k in c[-2::-1]:
        out = out * x + F.lit(k)
    return out


def inv_normal_cdf(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1)."""
    q = p - 0.5
    r = 0.180625 - q * q
    t = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    s = F.when(t <= 5, _poly(C, t - 1.6) / _poly(D, t - 1.6)).otherwise(_poly(E, t - 5) / _poly(G, t - 5))
    return F.when(F.abs(q) <= 0.425, q * _poly(A, r) / _poly(B, r)).otherwise(F.when(q < 0, -s).otherwise(s))


def inv_normal_cdf_sql(p: str) -> str:
    def poly(c, x):
        out = repr(c[-1])
        for k in c[-2::-1]:
            out = f"({out} * {x} + {k!r})"
        return out

    q, r, t = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))", f"sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    s = f"(CASE WHEN {t} <= 5 THEN {poly(C, f'({t} - 1.6)')} / {poly(D, f'({t} - 1.6)')} ELSE {poly(E, f'({t} - 5)')} / {poly(G, f'({t} - 5)')} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {poly(A, r)} / {poly(B, r)} WHEN {q} < 0 THEN -{s} ELSE {s} END)"


def to_double(text: Column) -> Column:
    """A number, or NaN where the text is none."""
    return F.coalesce(text.try_cast("double"), F.lit(float("nan")))


def to_string(value: Column) -> Column:
    return value.cast("string")


def bit_peek(bits: Column) -> Column:
    """The place of the lowest bit that is set, from 0; null without any."""
    return F.when(bits != 0, F.bit_count(bits.bitwiseXOR(bits - 1)) - 1)


def bit_pop(bits: Column) -> Column:
    """bits without the lowest that is set."""
    return bits.bitwiseAND(bits - 1)


def absolute_error(a: np.ndarray, b: np.ndarray, p: float = np.inf) -> float:
    return float(np.linalg.norm(np.asarray(a) - b, p)) if len(a) else 0.0


def relative_error(a: np.ndarray, b: np.ndarray, p: float = np.inf) -> float:
    return absolute_error(a, b, p) / float(np.linalg.norm(b, p))


def error_columns(a: Column, b: Column) -> tuple[Column, Column]:
    """Aggregates: largest absolute error, and root of the sum of squares."""
    return F.max(F.abs(a - b)), F.sqrt(F.sum((a - b) * (a - b)))
