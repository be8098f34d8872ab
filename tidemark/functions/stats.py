"""Statistical column functions: the normal distribution and unit-root tables."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

# Rational approximation of the error function (W. J. Cody, 1969).
_ERF_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_ERF_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_ERF_C = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_ERF_D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_ERF_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_ERF_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def erfc(x: Column) -> Column:
    """The complementary error function to double precision, in JVM arithmetic only."""
    y = F.abs(x)
    z = y * y
    n, d = F.lit(_ERF_A[4]) * z, z
    for i in range(3):
        n, d = (n + _ERF_A[i]) * z, (d + _ERF_B[i]) * z
    near = 1 - x * (n + _ERF_A[3]) / (d + _ERF_B[3])
    n, d = F.lit(_ERF_C[8]) * y, y
    for i in range(7):
        n, d = (n + _ERF_C[i]) * y, (d + _ERF_D[i]) * y
    middle = F.exp(-z) * (n + _ERF_C[7]) / (d + _ERF_D[7])
    w = 1 / F.when(z == 0, F.lit(1.0)).otherwise(z)
    n, d = F.lit(_ERF_P[5]) * w, w
    for i in range(4):
        n, d = (n + _ERF_P[i]) * w, (d + _ERF_Q[i]) * w
    far = F.exp(-z) * (1 / math.sqrt(math.pi) - w * (n + _ERF_P[4]) / (d + _ERF_Q[4])) / F.when(y == 0, F.lit(1.0)).otherwise(y)
    tail = F.when(y <= 4, middle).otherwise(far)
    return F.when(y <= 0.46875, near).when(x < 0, 2 - tail).otherwise(tail)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


# MacKinnon (1994), constant only, one variable.
_ADF_SMALL = (2.1659, 1.4412, 0.038269)
_ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
_ADF_STAR, _ADF_MIN, _ADF_MAX = -1.61, -18.83, 2.74


def adf_pvalue(t: Column) -> Column:
    small = _ADF_SMALL[0] + _ADF_SMALL[1] * t + _ADF_SMALL[2] * t * t
    large = _ADF_LARGE[0] + _ADF_LARGE[1] * t + _ADF_LARGE[2] * t * t + _ADF_LARGE[3] * t * t * t
    p = normal_cdf(F.when(t <= _ADF_STAR, small).otherwise(large))
    return F.when(t == 0, F.lit(1.0)).when(t > _ADF_MAX, F.lit(1.0)).when(t < _ADF_MIN, F.lit(0.0)).otherwise(p)


# KPSS level critical values and their probabilities.
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)
#: Fixed value: Johansen trace test, no deterministic part, two series, 95 %.
JOHANSEN_TRACE_95 = 12.3212


def kpss_pvalue(stat: Column) -> Column:
    out = F.lit(KPSS_P[-1])
    for (a, b), (p, q) in reversed(list(zip(zip(KPSS_CRITICAL, KPSS_CRITICAL[1:]), zip(KPSS_P, KPSS_P[1:])))):
        out = F.when(stat <= b, p + (stat - a) * ((q - p) / (b - a))).otherwise(out)
    return F.when(stat.isNull(), F.lit(0.0)).when(stat <= KPSS_CRITICAL[0], F.lit(KPSS_P[0])).otherwise(out)


def expected_max_sharpe(n_trials: float, variance: float) -> float:
    """The largest Sharpe ratio to expect of so many trials without skill."""
    if n_trials < 2 or variance <= 0:
        return 0.0
    euler = 0.5772156649015329
    return math.sqrt(variance) * ((1 - euler) * normal_quantile(1 - 1 / n_trials) + euler * normal_quantile(1 - 1 / (n_trials * math.e)))


def effective_trials(mean_correlation: float, n_trials: float) -> float:
    return max(1.001, n_trials ** (1 - min(max(mean_correlation, 0.0), 0.999)))


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurtosis: Column) -> Column:
    spread = 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr
    z = (sr - benchmark) * F.sqrt(n - 1) / F.sqrt(F.when(spread > 0, spread))
    return F.when(n > 1, F.coalesce(normal_cdf(z), F.lit(0.0))).otherwise(F.lit(0.0))
