"""Small statistics on final rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_STEPS = 10_000_000  # of the continued fraction; it needs about the root of the larger parameter


def _beta_fraction(a: float, b: float, x: float) -> float | None:
    """Continued fraction of the incomplete beta function (modified Lentz); None if it does not settle."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, MOST_STEPS):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    return None


def _log_beta(a: float, b: float) -> float:
    """ln B(a, b). For a large parameter the difference of two lgamma values would cancel; Stirling's
    series gives the difference itself."""
    a, b = max(a, b), min(a, b)
    if a < 1e4:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    rest = 1 / (12 * a) - 1 / (12 * (a + b)) - 1 / (360 * a**3) + 1 / (360 * (a + b) ** 3)
    tail = -(a - 0.5) * math.log1p(b / a) - b * math.log(a + b) + b + rest
    return math.lgamma(b) + tail


def beta_share(a: float, b: float, x: float, y: float | None = None) -> float | None:
    """Regularised incomplete beta function I_x(a, b); ``y`` is 1 - x where it is known more exactly."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    front = math.exp(a * log_x + b * log_y - _log_beta(a, b))
    swap = x >= (a + 1.0) / (a + b + 2.0)
    part = _beta_fraction(b, a, y) if swap else _beta_fraction(a, b, x)
    if part is None:
        return None
    return 1.0 - front * part / b if swap else front * part / a


def f_tail(f: float, d1: float, d2: float) -> float | None:
    """P(F > f) for the F distribution; None when it is not defined."""
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return None
    if math.isinf(f):
        return 0.0
    whole = d2 + d1 * f
    return beta_share(d2 / 2.0, d1 / 2.0, d2 / whole, d1 * f / whole) if f > 0 else 1.0


@F.pandas_udf(T.DoubleType())
def f_tail_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """``f_tail`` on the few rows a test leaves (one per system and field)."""
    return pd.Series([f_tail(*row) for row in zip(f, d1, d2)], dtype="float64")
