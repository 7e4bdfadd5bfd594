"""Tail probabilities for test statistics, as small pandas UDFs over one row per feature."""

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship this module's code with the UDFs, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
_TINY = 1e-300


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or _TINY)
        c = b + step / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_ratio(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or _TINY)
            c = 1 + step / c or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def chi_square_tail(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([_upper_gamma(k / 2, h / 2) if pd.notna(h) and k > 0 else None
                      for h, k in zip(statistic, freedom)], dtype="float64")


@F.pandas_udf(DoubleType())
def student_two_sided(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([_beta_ratio(k / 2, 0.5, k / (k + t * t)) if pd.notna(t) and k > 0 else None
                      for t, k in zip(statistic, freedom)], dtype="float64")
