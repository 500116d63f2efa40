"""Tail probabilities of the F, chi-square and t distributions.

Each is evaluated directly in its complementary form, so small p-values do not
cancel to zero.  The columns built here run on one row per tested feature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_EPS = 1e-15


def _lentz(first: float, terms) -> float:
    """Evaluate the continued fraction first + a1/(b1 + a2/(b2 + ...))."""
    value = first if first else _TINY
    c, d = value, 0.0
    for a, b in terms:
        d = b + a * d
        d = 1.0 / (d if d else _TINY)
        c = b + a / c
        c = c if c else _TINY
        value *= c * d
        if abs(c * d - 1.0) < _EPS:
            return value
    raise ArithmeticError("a continued fraction did not converge")


def beta_regularised(x: float, a: float, b: float) -> float:
    """I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_regularised(1.0 - x, b, a)

    def terms():
        yield 1.0, 1.0
        for m in range(1, 100_000):
            k = (m - 1) // 2 if m % 2 else m // 2
            if m % 2:
                yield -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)), 1.0
            else:
                yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), 1.0

    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    return front / a * _lentz(0.0, terms())


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x), the regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * _EPS:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total

    def terms():
        yield 1.0, x + 1.0 - a
        for i in range(1, 100_000):
            yield -i * (i - a), x + 2 * i + 1.0 - a

    return front * _lentz(0.0, terms())


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_regularised(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def chi2_sf(x: float, dof: float) -> float:
    return gamma_upper(dof / 2.0, x / 2.0) if dof > 0 else 1.0


def t_sf_two_sided(t: float, dof: float) -> float:
    return beta_regularised(dof / (dof + t * t), dof / 2.0, 0.5)


def tail(test: str, stat: float, dof1: float, dof2: float) -> float:
    """p-value of a named test; NaN when the statistic is undefined."""
    if stat is None or math.isnan(stat):
        return math.nan
    if math.isinf(stat):
        return 0.0
    if test == "anova":
        return f_sf(stat, dof1, dof2)
    if test == "chi2":
        return chi2_sf(stat, dof1)
    return t_sf_two_sided(stat, dof2)


def p_value(test: Column, stat: Column, dof1: Column, dof2: Column) -> Column:
    """Arrow UDF over a table of test statistics."""

    @F.pandas_udf("double")
    def evaluate(test: pd.Series, stat: pd.Series, dof1: pd.Series, dof2: pd.Series) -> pd.Series:
        rows = zip(test, stat.astype(float), dof1.astype(float), dof2.astype(float))
        return pd.Series([tail(*r) for r in rows], dtype=np.float64)

    p = evaluate(test, stat.cast("double"), dof1.cast("double"), dof2.cast("double"))
    return F.when(F.isnan(p), None).otherwise(p)
