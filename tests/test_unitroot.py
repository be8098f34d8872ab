"""Unit-root tests with an automatic lag, against plain least squares."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import unitroot as U
from tidemark.operators import screens as S1, signals as SG


def plainly(x, most=None):
    """(t, lag) by least squares on the data themselves."""
    x = np.asarray(x, float)
    d, n = np.diff(x), len(x)
    m = min(math.ceil(12 * (n / 100) ** 0.25) if most is None else most, n // 2 - 2)

    def fit(lag, sample):
        rows = range(sample, len(d))
        a = np.array([[1.0, x[t], *(d[t - j] for j in range(1, lag + 1))] for t in rows])
        y = d[sample:]
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        rss = float(((y - a @ b) ** 2).sum())
        return a, b, rss, len(y)

    scores = []
    for lag in range(m + 1):
        _, _, rss, rows = fit(lag, m)
        scores.append(rows * math.log(rss / rows) + 2 * (lag + 2))
    lag = int(np.argmin(scores))
    a, b, rss, rows = fit(lag, lag)
    return b[1] / math.sqrt(rss / (rows - lag - 2) * np.linalg.inv(a.T @ a)[1, 1]), lag


def series_of(seed, n, kind):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n)
    x = np.cumsum(e)
    if kind == "returning":
        for i in range(1, n):
            x[i] = 0.9 * x[i - 1] + e[i]
    elif kind == "lags":
        d = np.zeros(n)
        for i in range(4, n):
            d[i] = 0.5 * d[i - 1] - 0.3 * d[i - 3] + e[i]
        x = np.cumsum(d)
    return x + 100


@pytest.mark.parametrize("most", [None, 0, 1, 5])
@pytest.mark.parametrize("kind", ["walk", "returning", "lags"])
def test_sums_equal_least_squares(kind, most):
    for seed, n in ((1, 14), (2, 60), (3, 300)):
        x = series_of(seed, n, kind)
        t, lag = U.adf(U.sums_of(x, most), most)
        wanted = plainly(x, most)
        assert lag == wanted[1] and t == pytest.approx(wanted[0], rel=1e-6, abs=1e-9)
    if kind == "lags" and most is None:
        assert lag >= 3


def test_series_that_cannot_be_tested():
    for x in ([], [1.0], [1.0] * 50, [1.0, 2.0, 1.0], list(range(8))):
        assert U.adf(U.sums_of(np.array(x, float))) == (0.0, 0)


def test_table_by_one_aggregate(spark):
    rows = [(f"{kind}{n}", i, float(v)) for kind, n in (("walk", 40), ("returning", 200), ("lags", 350)) for i, v in enumerate(series_of(7, n, kind))]
    rows += [("still", i, 5.0) for i in range(30)] + [("short", 0, 1.0), ("holes", 0, None)] + [("holes", i + 1, float(v)) for i, v in enumerate(series_of(8, 50, "walk"))]
    df = spark.createDataFrame(rows, "pair string, seq int, ratio double").repartition(4)
    for most in (None, 1):
        got = {r["pair"]: (r["adf_t"], r["lag"], r["adf_p"]) for r in S1.adf_auto(df, most=most).collect()}
        for pair in ("walk40", "returning200", "lags350", "holes"):
            t, lag = plainly([v for p, _, v in rows if p == pair and v is not None], most)
            assert got[pair][1] == lag and got[pair][0] == pytest.approx(t, rel=1e-6)
        assert got["still"] == (0.0, 0, 1.0) == got["short"]
    assert S1.adf_auto(df.limit(0)).count() == 0


def test_no_row_is_multiplied(spark):
    df = spark.createDataFrame([("a", i, float(i % 7)) for i in range(100)], "pair string, seq int, ratio double")
    plan = S1.adf_auto(df)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") <= 4


def test_gate_of_the_spread_signal(spark):
    x = series_of(5, 400, "walk")
    df = spark.createDataFrame([("w", i, i + 1, float(v), float(v), 1.0) for i, v in enumerate(x)], "pair string, ts int, seq int, ratio double, num_close double, den_close double")
    assert SG.cointegration_spread(df).filter("entry or exit").count() == 0
    assert SG.cointegration_spread(df, alpha=1.0).filter(F.col("entry")).count() > 0
