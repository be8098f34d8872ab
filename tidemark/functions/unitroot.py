"""The augmented Dickey-Fuller test with a constant and a lag chosen by least AIC, from sums of products.

All that the regressions need of a series x with differences d are, for every lag h, the sums of d(t) d(t - h)
and of x(t) d(t - h), the sums of x and of its square, and the first and last values. From those the matrix of
all lagged products follows for any sample: two lags further on, a product sum differs by one term at
either end. Regressions on the first columns of that matrix are nested, so one Cholesky factor gives the
residuals of all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from . import stats


def pvalue(t: float) -> float:
    """``stats.adf_pvalue`` of one number."""
    if t == 0 or t > stats._ADF_MAX:
        return 1.0
    if t < stats._ADF_MIN:
        return 0.0
    terms = stats._ADF_SMALL if t <= stats._ADF_STAR else stats._ADF_LARGE
    return 0.5 * math.erfc(-sum(a * t**i for i, a in enumerate(terms)) / math.sqrt(2))


def most_lags(n: int, most: int | None = None) -> int:
    """The usual bound, 12 (n / 100) ** 0.25 rounded up, and never so many that the regression has no room."""
    usual = math.ceil(12 * (n / 100) ** 0.25) if most is None else most
    return min(usual, n // 2 - 2)


@dataclass
class Sums:
    """Of a series of n values; ``head`` and ``tail`` are its first and last ones, at least 2 lags + 3 of them."""

    n: int
    x: float
    xx: float
    #: Sum of d(t) d(t - h) for h = 0, 1, ...
    dd: np.ndarray
    #: Sum of x(t) d(t - h) for h = -1, 0, 1, ...
    xd: np.ndarray
    head: np.ndarray
    tail: np.ndarray

    def at(self, i: int) -> float:
        """x(i), i from 1, near either end."""
        return self.head[i - 1] if i <= len(self.head) else self.tail[i - 1 - self.n + len(self.tail)]

    def step(self, i: int) -> float:
        return self.at(i) - self.at(i - 1)

    def products(self, m: int) -> np.ndarray:
        """Products of (1, x(t-1), d(t-1), ..., d(t-m), d(t)), summed over t = m + 2 .. n."""
        n, p = self.n, m + 3
        first = np.array([self.step(i) for i in range(2, m + 2)])  # d(2) .. d(m + 1)
        last = np.array([self.step(i) for i in range(n - m + 1, n + 1)])  # d(n - m + 1) .. d(n)
        g = np.zeros((m + 1, m + 1))
        for j in range(m + 1):
            # t runs from m + 2, so of the sum over all t the terms below go.
            g[0, j] = self.dd[j] - sum(first[s - 2] * first[s - j - 2] for s in range(j + 2, m + 2))
        for i in range(m):
            a, b = first[m - 1 - i], last[m - 1 - i]
            for j in range(i, m):
                g[i + 1, j + 1] = g[i, j] + a * first[m - 1 - j] - b * last[m - 1 - j]
        low = np.array([self.at(i) for i in range(1, m + 1)])
        end = self.at(n)
        cross = np.empty(m + 1)
        for j in range(m + 1):
            h = j - 1  # x(s) d(s - h) over s = m + 1 .. n - 1
            cross[j] = self.xd[j] - sum(low[s - 1] * self.step(s - h) for s in range(max(1, h + 2), m + 1)) - (end * self.step(n - h) if h >= 0 else 0.0)
        out = np.zeros((p, p))
        order = [*range(1, m + 1), 0]  # the lags, then d(t) itself
        for a, i in enumerate(order):
            for b, j in enumerate(order):
                out[a + 2, b + 2] = g[min(i, j), max(i, j)]
            out[a + 2, 1] = out[1, a + 2] = cross[i]
            out[a + 2, 0] = out[0, a + 2] = self.at(n - i) - self.at(m + 1 - i)
        out[1, 1] = self.xx - (low * low).sum() - end * end
        out[0, 1] = out[1, 0] = self.x - low.sum() - end
        out[0, 0] = n - m - 1
        return out


def sums_of(x: np.ndarray, most: int | None = None) -> Sums:
    x = np.asarray(x, float)
    x = x - x[0] if len(x) else x
    n, d = len(x), np.diff(x)
    m = max(most_lags(n, most), 0)
    lagged = lambda h: float(d[h:] @ d[: len(d) - h]) if h < len(d) else 0.0
    across = lambda h: float(x[:-1] @ d) if h < 0 else float(x[h + 1 :] @ d[: len(d) - h]) if h < len(d) else 0.0
    k = 2 * m + 3
    return Sums(n, float(x.sum()), float(x @ x), np.array([lagged(h) for h in range(m + 1)]), np.array([across(h) for h in range(-1, m)]), x[:k], x[-k:])


def adf(s: Sums, most: int | None = None, least: int = 10) -> tuple[float, int]:
    """(t, lag). All lags are compared on the rows that the longest of them leaves; the test itself uses all
    rows that its own lag leaves. t is 0 for series that are too short or don't move."""
    m = most_lags(s.n, most)
    if s.n < least or m < 0:
        return 0.0, 0
    g = s.products(m)
    try:
        factor = np.linalg.cholesky(g[:-1, :-1])
        share = np.linalg.solve(factor, g[:-1, -1]) ** 2
        rows = g[0, 0]
        left = np.maximum(g[-1, -1] - np.cumsum(share)[1:], 1e-300)
        lag = int(np.argmin(rows * np.log(left / rows) + 2 * (np.arange(m + 1) + 2)))
        g = s.products(lag)
        # x last: its coefficient over its error is then the last entry over the residual deviation.
        order = [0, *range(2, lag + 2), 1]
        factor = np.linalg.cholesky(g[np.ix_(order, order)])
        z = np.linalg.solve(factor, g[order, -1])
    except np.linalg.LinAlgError:
        return 0.0, 0
    rest, free = g[-1, -1] - z @ z, g[0, 0] - lag - 2
    return (float(z[-1] / math.sqrt(rest / free)) if rest > 0 and free > 0 else 0.0), lag
