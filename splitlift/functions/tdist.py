"""Student-t tail probability, for the Welch test.

Two-sided p = I_x(nu/2, 1/2) with x = nu / (nu + t^2), the regularized
incomplete beta function, evaluated by its continued fraction (modified Lentz).
Only the final few rows of the test (one per segment) reach this code, so a
small Arrow UDF is the right tool; the moments come from Spark aggregates.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_EPS = 3e-16
_MAX_TERMS = 10_000


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of I_x(a, b) (converges fast for x < (a+1)/(a+b+2))."""
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    frac = d
    for m in range(1, _MAX_TERMS + 1):
        two_m = 2 * m
        # even step
        num = m * (b - m) * x / ((a + two_m - 1.0) * (a + two_m))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + num / c
        c = c if abs(c) > _TINY else _TINY
        frac *= d * c
        # odd step
        num = -(a + m) * (a + b + m) * x / ((a + two_m) * (a + two_m + 1.0))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + num / c
        c = c if abs(c) > _TINY else _TINY
        step = d * c
        frac *= step
        if abs(step - 1.0) < _EPS:
            return frac
    raise ArithmeticError(f"the continued fraction does not converge for a={a}, b={b}, x={x}")


def _log_gamma_step(a: float) -> float:
    """lgamma(a + 1/2) - lgamma(a), by a series where the difference would cancel."""
    if a < 100.0:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)


def t_two_sided_p(t: float | None, nu: float | None) -> float | None:
    """P(|T| >= |t|) for Student's t with ``nu`` degrees of freedom."""
    if t is None or nu is None or math.isnan(t) or math.isnan(nu) or nu <= 0:
        return None
    if math.isinf(t):
        return 0.0
    if t == 0.0:
        return 1.0
    # I_x(nu/2, 1/2) with x = 1/(1+r), 1-x = r/(1+r); neither is formed by subtraction.
    a, r = nu / 2.0, t * t / nu
    x, y = 1 / (1 + r), r / (1 + r)
    front = math.exp(_log_gamma_step(a) - math.lgamma(0.5) - a * math.log1p(r) + 0.5 * math.log(y))
    if x < (a + 1.0) / (a + 2.5):
        return front * _beta_fraction(a, 0.5, x) / a
    return 1.0 - front * _beta_fraction(0.5, a, y) / 0.5


@F.pandas_udf(T.DoubleType())
def t_two_sided_p_udf(t: pd.Series, nu: pd.Series) -> pd.Series:
    out = [t_two_sided_p(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b))
           for a, b in zip(t, nu)]
    return pd.Series(out, dtype="float64")
