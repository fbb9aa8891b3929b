"""Distribution functions Spark SQL lacks, vectorised over Arrow batches."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER_GAMMA = 0.5772156649
_NORMAL = NormalDist()


def normal_cdf_array(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) if v == v else np.nan for v in np.asarray(x, dtype="float64")])


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-squared distribution: the regularised upper incomplete gamma at (k/2, x/2)."""
    a, z = k / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:  # series of the lower tail
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= z / n
            total += term
        return 1.0 - front * total
    tiny = 1e-300  # continued fraction of the upper tail
    b, c = z + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf_array(x.to_numpy()))


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(lambda v: _NORMAL.inv_cdf(v) if v is not None and 0 < v < 1 else None).astype("float64")


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(v, int(n)) if v == v and n == n else np.nan for v, n in zip(x.astype("float64"), k.astype("float64"))])


def sharpe_variance(n: Column, sharpe: Column, skew: Column, kurt: Column) -> Column:
    """Variance of a Sharpe estimate from n returns with given skewness and Pearson kurtosis; null under three or if not positive."""
    v = (1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / (n - 1)
    return F.when((n >= 3) & (v > 0), v)


def expected_best_sharpe(trials: int) -> float:
    """Expected maximum of ``trials`` standard normal Sharpe ratios."""
    if trials <= 1:
        return 0.0
    return (1 - EULER_GAMMA) * _NORMAL.inv_cdf(1 - 1 / trials) + EULER_GAMMA * _NORMAL.inv_cdf(1 - 1 / (trials * math.e))
