"""Tail probabilities of Student's t and Fisher's F, as Arrow functions over numpy."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, n: float) -> float:
    return incomplete_beta(n / 2, 0.5, n / (n + t * t))


def f_upper(f: float, n: float, m: float) -> float:
    return incomplete_beta(m / 2, n / 2, m / (m + n * f)) if f > 0 else 1.0


def chi2_upper(x: float, n: float) -> float:
    """Upper tail of chi-square with n degrees of freedom: a series below the mean, a continued fraction above."""
    if x <= 0:
        return 1.0
    a, x = n / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        num = -i * (i - a)
        b += 2
        d = num * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + num / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic with n degrees of freedom; null in, null out."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_two_sided(float(a), float(b)) for a, b in zip(t, n, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Upper p of an F statistic with n and m degrees of freedom; null in, null out."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) or pd.isna(c) else f_upper(float(a), float(b), float(c)) for a, b, c in zip(f, n, m, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, n: pd.Series) -> pd.Series:
    """Upper p of a chi-square statistic with n degrees of freedom; null in, null out."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else chi2_upper(float(a), float(b)) for a, b in zip(x, n, strict=True)], dtype="float64")
