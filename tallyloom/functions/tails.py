"""Tail probabilities of the t, F and chi-squared distributions.

Spark has no distribution functions. These are evaluated on one row per test, as
Arrow-batched columns, from the regularised incomplete beta and gamma functions.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these helpers with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = 500
TINY = 1e-300
PRECISION = 1e-15


def beta_fraction(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b), modified Lentz continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_fraction(1.0 - x, b, a)
    scale = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    value, c, d = 1.0, 1.0, 0.0
    for step in range(STEPS):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + term * d or TINY)
        c = 1.0 + term / c or TINY
        value *= c * d
        if abs(c * d - 1.0) < PRECISION:
            break
    return scale * (value - 1.0) / a


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for k in range(1, 10 * STEPS):
            term *= x / (a + k)
            total += term
            if term < total * PRECISION:
                break
        return 1.0 - scale * total
    b = x + 1.0 - a
    c, d = 1.0 / TINY, 1.0 / b
    value = d
    for k in range(1, 10 * STEPS):
        factor = -k * (k - a)
        b += 2.0
        d = 1.0 / (factor * d + b or TINY)
        c = b + factor / c or TINY
        value *= c * d
        if abs(c * d - 1.0) < PRECISION:
            break
    return scale * value


def t_two_sided(t: float, df: float) -> float:
    return beta_fraction(df / (df + t * t), df / 2.0, 0.5)


def f_upper(f: float, df1: float, df2: float) -> float:
    return beta_fraction(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def _columnwise(function, *columns: pd.Series) -> pd.Series:
    rows = zip(*[c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns])
    return pd.Series([np.nan if any(math.isnan(v) for v in r) else function(*r) for r in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _columnwise(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _columnwise(f_upper, f, df1, df2)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return _columnwise(chi2_upper, x, df)
