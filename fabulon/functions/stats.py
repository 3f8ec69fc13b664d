"""Array statistics without shuffles, and significance levels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: lambdas would evaluate an expression for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    return F.try_divide(array_sum(a), F.size(a).cast("double"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of equal length; null if either is constant or they are empty."""

    def centred(v: Column) -> Column:
        return let(mean(v), lambda m: F.transform(v, lambda x: x - m))

    def ratio(da: Column, db: Column) -> Column:
        norm = lambda d: F.sqrt(array_sum(F.transform(d, lambda x: x * x)))
        r = F.try_divide(array_sum(F.zip_with(da, db, lambda x, y: x * y)), norm(da) * norm(db))
        return F.when(r > 1.0, 1.0).when(r < -1.0, -1.0).otherwise(r)

    flat = (F.array_min(a) == F.array_max(a)) | (F.array_min(b) == F.array_max(b))
    return F.when(~flat & (F.size(a) > 1), let(centred(a), lambda da: let(centred(b), lambda db: ratio(da, db))))


def ranks(a: Column) -> Column:
    """Average ranks from 1."""
    n = F.size(a)
    return let(F.array_sort(a), lambda up: let(F.reverse(up), lambda down: F.transform(
        a, lambda x: (F.array_position(up, x) + n + 1 - F.array_position(down, x)) / 2.0)))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mean_abs_diff(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either norm is 0, null for empty arrays."""
    dot = array_sum(F.zip_with(a, b, lambda x, y: x * y))
    na, nb = (F.sqrt(array_sum(F.transform(v, lambda x: x * x))) for v in (a, b))
    return F.when(F.size(a) > 0, F.when((na == 0) | (nb == 0), 0.0).otherwise(dot / (na * nb)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return out


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided significance of a correlation of n points: I_(1-r^2)((n-2)/2, 1/2).  n = 2 gives 1; fewer give null."""
    if r is None or r != r or n < 2:
        return None
    if n == 2:
        return 1.0
    x, a, b = 1.0 - r * r, (n - 2) / 2.0, 0.5
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(None if pd.isna(x) else float(x), int(k)) for x, k in zip(r, n)], dtype=object).astype(float)


def dtw_distance(a, b) -> float | None:
    """Dynamic time warping with cost |a-b|, divided by the length of the path (ties: diagonal, up, left).

    The table is filled along its antidiagonals, which are independent of each other within; cost and path length are
    carried forward together.  Memory is linear in the shorter arc's diagonal.
    """
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    n, m = len(a), len(b)
    if not n or not m:
        return None
    back = b[::-1]
    # place i + 1 of an antidiagonal d holds cell (i, d - i); cells outside the table stay at infinity
    cost1, cost2 = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    len1, len2 = np.zeros(n + 1), np.zeros(n + 1)
    cost1[1], len1[1] = abs(a[0] - b[0]), 1.0
    for d in range(1, n + m - 1):
        lo, hi = max(0, d - m + 1), min(n, d + 1)
        up, left, diag = cost1[lo:hi], cost1[lo + 1 : hi + 1], cost2[lo:hi]
        use_diag = (diag <= up) & (diag <= left)
        use_up = up <= left
        cost, length = np.full(n + 1, np.inf), np.zeros(n + 1)
        best = np.minimum(np.minimum(up, left), diag)
        cost[lo + 1 : hi + 1] = best + np.abs(a[lo:hi] - back[m - 1 - d + lo : m - 1 - d + hi])
        length[lo + 1 : hi + 1] = 1.0 + np.where(use_diag, len2[lo:hi], np.where(use_up, len1[lo:hi], len1[lo + 1 : hi + 1]))
        cost2, len2, cost1, len1 = cost1, len1, cost, length
    return float(cost1[n] / len1[n])


@F.pandas_udf(DoubleType())
def dtw(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else dtw_distance(x, y) for x, y in zip(a, b)], dtype=object).astype(float)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
