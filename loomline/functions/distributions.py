"""Beta, t and normal distributions, exact intervals and power: for figures on the driver and, over distinct values, as Arrow functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction evaluated from the front."""
    if not 0 <= x <= 1:
        raise ValueError("x must be within 0 and 1")
    if x in (0, 1):
        return float(x)
    if x > (a + 1) / (a + b + 2):  # where the fraction converges slowly, the other tail's does fast
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    value = 1.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= d * c
        if abs(1 - d * c) < 1e-15:
            break
    return front * (value - 1)


def t_cdf(t: float, df: float) -> float:
    tail = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


def _root(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    """The normal quantile for over 2000 degrees of freedom."""
    return NormalDist().inv_cdf(p) if df > 2000 else _root(lambda t: t_cdf(t, df) - p, -1e4, 1e4)


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """The exact interval of a share; (0, 1) without trials."""
    if n == 0:
        return 0.0, 1.0
    lo = 0.0 if k == 0 else _root(lambda x: beta_cdf(x, k, n - k + 1) - alpha / 2, 0, 1)
    hi = 1.0 if k == n else _root(lambda x: beta_cdf(x, k + 1, n - k) - (1 - alpha / 2), 0, 1)
    return lo, hi


def mde_paired(sd: float, n: int, power: float = 0.8, alpha: float = 0.05, comparisons: int = 1, two_sided: bool = True) -> float:
    """The least difference that n pairs detect with some power (alpha shared over comparisons)."""
    if n < 2 or sd < 0:
        raise ValueError("needs two pairs and no negative deviation")
    tail = alpha / comparisons / (2 if two_sided else 1)
    return (t_quantile(1 - tail, n - 1) + t_quantile(power, n - 1)) * sd / math.sqrt(n)


def power_paired(effect: float, sd: float, n: int, alpha: float = 0.05) -> float:
    if sd <= 0:
        return 1.0
    return 1 - t_cdf(t_quantile(1 - alpha / 2, n - 1) - abs(effect) / (sd / math.sqrt(n)), n - 1)


def clopper_pearson_column(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """struct(lo, hi). Meant for few rows, such as counts per class."""
    @F.arrow_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
    def interval(k: pa.Array, n: pa.Array) -> pa.Array:
        found = [clopper_pearson(a, b, alpha) for a, b in zip(k.to_pylist(), n.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.float64()) for i in (0, 1)], ["lo", "hi"])

    return interval(k, n)


def mde_column(sd: Column, n: Column, power: float = 0.8, alpha: float = 0.05) -> Column:
    """``mde_paired`` of few rows."""
    @F.arrow_udf(T.DoubleType())
    def least(sd: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if s is None or k is None else mde_paired(s, k, power, alpha) for s, k in zip(sd.to_pylist(), n.to_pylist())], pa.float64())

    return least(sd, n)
