"""Two-sided p-value of a correlation coefficient (Student t through the incomplete beta function)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def _p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    def one(r_: float, n_: float) -> float | None:
        if r_ is None or n_ is None or math.isnan(r_) or n_ < 3:
            return None
        return incomplete_beta((n_ - 2) / 2, 0.5, 1.0 - min(1.0, r_ * r_))

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


def correlation_p_value(r: Column, n: Column) -> Column:
    """Applied to aggregated results only: one row per key."""
    return _p_value(r.cast("double"), n.cast("double"))
