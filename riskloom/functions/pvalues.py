"""Tail probabilities for small tables of test results (one row per feature)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kolmogorov_p(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample KS statistic."""
    lam = F.sqrt(n1.cast("double") * n2 / (n1 + n2)) * d
    term = lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * lam * lam)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + term(k))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)))


def chi2_tail(x: float, dof: int) -> float:
    """P(chi² > x): the regularised upper incomplete gamma function, its front factor in log space.

    A series below the mean, a continued fraction above it; both run until they converge."""
    if dof <= 0 or x <= 0:
        return 1.0
    a, h = dof / 2, x / 2
    front = a * math.log(h) - h - math.lgamma(a)
    if h < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= h / k
            total += term
        return min(1.0, max(0.0, 1 - math.exp(front + math.log(total))))
    tiny = 1e-300
    b = h + 1 - a
    c, d = 1 / tiny, 1 / b
    value, i = d, 0
    while True:
        i += 1
        step = -i * (i - a)
        b += 2
        d = step * d + b
        c = b + step / c
        d = 1 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            return min(1.0, math.exp(front + math.log(value)))


def chi2_p(x: Column, dof: Column) -> Column:
    """P(chi² > x) for whole degrees of freedom."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(float(a), int(b)) for a, b in zip(x, dof)])

    return run(x, dof)


def t_p(t: Column, dof: Column) -> Column:
    """Two-sided tail of Student's t, by integrating the density with a fine Simpson rule."""

    def tail(t: float, dof: float) -> float:
        if dof <= 0 or math.isnan(t):
            return float("nan")
        t = abs(t)
        if math.isinf(t):
            return 0.0
        # Substituting x = sqrt(dof) * tan(a) makes the integrand cos(a)^(dof - 1).
        top = math.atan(t / math.sqrt(dof))
        n = 2000
        step = top / n
        vals = [math.cos(i * step) ** (dof - 1) for i in range(n + 1)]
        area = step / 3 * (vals[0] + vals[-1] + 4 * sum(vals[1:-1:2]) + 2 * sum(vals[2:-1:2]))
        norm = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
        return max(0.0, min(1.0, 1 - 2 * norm * area))

    @F.pandas_udf(T.DoubleType())
    def run(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([tail(float(a), float(b)) for a, b in zip(t, dof)])

    return run(t, dof)
