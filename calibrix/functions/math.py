"""Probability and activation functions as Spark column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrix.functions.random import uniform

SQRT2 = math.sqrt(2.0)
HALF_LOG_2PI = math.log(2.0 * math.pi) / 2.0
# Degree of the polynomial in erf.
ERF_DEGREE = 26


def _log_scaled_erfc(z: float) -> float:
    """log(erfc(z) exp(z^2)) for z >= 0: directly, and by the asymptotic series where erfc is tiny."""
    if z < 20.0:
        return math.log(math.erfc(z)) + z * z
    term, total = 1.0, 1.0
    for k in range(1, 8):
        term *= -(2 * k - 1) / (2.0 * z * z)
        total += term
    return math.log(total) - math.log(z * math.sqrt(math.pi))


def _erf_coefficients(degree: int = ERF_DEGREE) -> list[float]:
    """Coefficients, lowest first, of the polynomial p with erfc(z) = t exp(-z^2 + p(2t - 1)), t = 2 / (2 + z), z >= 0:
    p interpolates at Chebyshev nodes, with an error of about 1e-13."""
    import numpy as np
    from numpy.polynomial import chebyshev as C

    def p(x):
        t = (np.asarray(x) + 1.0) / 2.0
        return np.array([_log_scaled_erfc(2.0 / v - 2.0) - math.log(v) for v in t])

    return [float(c) for c in C.cheb2poly(C.chebinterpolate(p, degree))]


ERF_COEFFICIENTS = _erf_coefficients()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(float(x)))


def _erf_u(x: Column) -> Column:
    return F.lit(4.0) / (F.lit(2.0) + F.abs(x)) - F.lit(1.0)


def _erf(x: Column, u: Column) -> Column:
    poly = F.lit(ERF_COEFFICIENTS[-1])
    for c in reversed(ERF_COEFFICIENTS[:-1]):
        poly = poly * u + F.lit(c)
    y = F.lit(1.0) - (u + F.lit(1.0)) / F.lit(2.0) * F.exp(poly - x * x)
    return F.when(x < 0, -y).otherwise(y)


def erf(x) -> Column:
    """erf(x) to about 1e-15 (see ``_erf_coefficients``). Same evaluation order as the SQL oracle."""
    x = _c(x)
    return _erf(x, _erf_u(x))


def normal_cdf(label, mean, stddev) -> Column:
    """PIT: Phi((label - mean) / stddev) = 0.5 (1 + erf(z / sqrt 2))."""
    z = (_c(label) - _c(mean)) / _c(stddev) / F.lit(SQRT2)
    return F.lit(0.5) * (F.lit(1.0) + erf(z))


def with_normal_cdf(df: DataFrame, out: str, label: str = "label", mean: str = "mean", stddev: str = "stddev") -> DataFrame:
    """``df`` with ``normal_cdf`` as a column ``out``. What the polynomial reads many times is projected first, so that the
    generated code holds it once however many expressions use ``out``."""
    z = (F.col(label) - F.col(mean)) / F.col(stddev) / F.lit(SQRT2)
    df = df.select("*", z.alias("__z")).select("*", _erf_u(F.col("__z")).alias("__u"))
    cdf = F.lit(0.5) * (F.lit(1.0) + _erf(F.col("__z"), F.col("__u")))
    return df.select("*", cdf.alias(out)).drop("__z", "__u")


def gaussian_nll(label, mean, stddev) -> Column:
    """Negative log density of label under N(mean, stddev^2)."""
    z = (_c(label) - _c(mean)) / _c(stddev)
    return F.log(_c(stddev)) + F.lit(HALF_LOG_2PI) + z * z / F.lit(2.0)


def clamp(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    """``x`` within [lo, hi]; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(float(lo))), F.lit(float(hi))))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def sigmoid_stddev(x) -> Column:
    """Positive scale head: sigmoid(x) * 5 + 0.01, in (0.01, 5.01)."""
    return sigmoid(x) * F.lit(5.0) + F.lit(0.01)


def leaky_relu(x, slope: float = 0.01) -> Column:
    x = _c(x)
    return F.when(x > 0, x).otherwise(F.lit(slope) * x)


def relu(x) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


def sample_normal(mean, stddev, id_col, seed: int = 42) -> Column:
    """A draw from N(mean, stddev) by Box-Muller on two hash uniforms (1-u under the log)."""
    u1 = uniform(f"bm1_{seed}", id_col)
    u2 = uniform(f"bm2_{seed}", id_col)
    z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return _c(mean) + _c(stddev) * z
