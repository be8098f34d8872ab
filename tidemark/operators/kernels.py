"""Path-dependent recurrences as NumPy kernels, run per key by ``applyInPandas``.

``per_key`` sorts a key's rows, calls ``fn(columns) -> columns`` and returns missing values as null.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

Columns = dict[str, np.ndarray]


def per_key(df: DataFrame, fn: Callable[[Columns], Columns], outputs: dict[str, str], inputs: list[str], key: str = "pair", seq: str = "seq") -> DataFrame:
    """``df`` with the columns ``fn`` makes from ``inputs``, key by key in the order of ``seq``."""
    fields = T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items()]])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq, kind="stable").reset_index(drop=True)
        got = fn({c: rows[c].to_numpy(dtype=float, na_value=np.nan) if rows[c].dtype != bool else rows[c].to_numpy() for c in inputs})
        for name, kind in outputs.items():
            v = got[name]
            rows[name] = np.asarray(v, dtype=bool) if kind == "boolean" else v
            if kind == "double":
                rows[name] = rows[name].where(np.isfinite(rows[name]), None)
        return rows[[f.name for f in fields]]

    return df.groupBy(key).applyInPandas(run, fields)


def shifted(flags: np.ndarray) -> np.ndarray:
    """One bar later; nothing on the first bar."""
    out = np.zeros(len(flags), dtype=bool)
    out[1:] = flags[:-1]
    return out


def ewm(x: np.ndarray, alpha: float, least: int, adjust: bool = True) -> np.ndarray:
    """Exponentially weighted mean that skips missing values but lets their weight decay."""
    out = np.full(len(x), np.nan)
    num = den = 0.0
    seen = 0
    for i, v in enumerate(x):
        if adjust:
            num *= 1 - alpha
            den *= 1 - alpha
            if v == v:
                num, den, seen = num + v, den + 1, seen + 1
        elif v == v:
            num = v if seen == 0 else (1 - alpha) * num + alpha * v
            den, seen = 1.0, seen + 1
        if seen >= least and den > 0:
            out[i] = num / den
    return out


def ema(x: np.ndarray, span: int, adjust: bool = True, least: int | None = None) -> np.ndarray:
    return ewm(x, 2 / (span + 1), span if least is None else least, adjust)


def diff(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.nan], np.diff(x)])


def atr_close(x: np.ndarray, period: int = 14) -> np.ndarray:
    return ewm(np.abs(diff(x)), 1 / period, period)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    prev = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - prev), np.abs(low - prev)))


def atr_ohlc(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = 14) -> np.ndarray:
    return ewm(true_range(high, low, close), 1 / period, period)


def atr_wilder(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = 14) -> np.ndarray:
    """Seeded with the plain mean of the first ``period`` ranges after the first bar; zero before."""
    tr = true_range(high, low, close)
    out = np.zeros(len(close))
    if len(close) <= period:
        return out
    out[period] = tr[1 : period + 1].mean()
    for i in range(period + 1, len(close)):
        out[i] = (out[i - 1] * (period - 1) + tr[i]) / period
    return out


def _adx(up: np.ndarray, down: np.ndarray, tr: np.ndarray, period: int) -> np.ndarray:
    a = 1 / period
    base = ewm(tr, a, period)
    with np.errstate(divide="ignore", invalid="ignore"):
        base = np.where(base == 0, np.nan, base)
        plus, minus = 100 * ewm(up, a, period) / base, 100 * ewm(down, a, period) / base
        both = np.where(plus + minus == 0, np.nan, plus + minus)
        return ewm(100 * np.abs(plus - minus) / both, a, period)


def adx_close(x: np.ndarray, period: int = 14) -> np.ndarray:
    d = diff(x)
    with np.errstate(invalid="ignore"):
        return _adx(np.clip(d, 0, None), np.clip(-d, 0, None), np.abs(d), period)


def adx_ohlc(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = 14) -> np.ndarray:
    up, down = np.nan_to_num(diff(high)), np.nan_to_num(-diff(low))
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    return _adx(plus, minus, true_range(high, low, close), period)


def rsi_wilder(x: np.ndarray, n: int) -> np.ndarray:
    d = diff(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain, loss = ewm(np.clip(d, 0, None), 1 / n, n), ewm(np.clip(-d, 0, None), 1 / n, n)
        return 100 - 100 / (1 + gain / np.where(loss == 0, np.nan, loss))


def percent_rank(x: np.ndarray, n: int, need: int) -> np.ndarray:
    """Average-tie rank of each value among the last n, divided by their number, once there are ``need``.

    The window is kept sorted: one value goes in and one out a bar."""
    out, held = np.full(len(x), np.nan), []
    for i, v in enumerate(x.tolist()):
        if i >= n and (old := x[i - n]) == old:
            held.pop(bisect.bisect_left(held, old))
        if v == v:
            bisect.insort(held, v)
            if len(held) >= need:
                below = bisect.bisect_left(held, v)
                out[i] = (below + (bisect.bisect_right(held, v) - below + 1) / 2) / len(held)
    return out


def kama(x: np.ndarray, period: int = 10, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Adaptive mean seeded with the price at index ``period``; a still market counts as efficiency 0."""
    out = np.full(len(x), np.nan)
    if len(x) <= period:
        return out
    quick, lazy = 2 / (fast + 1), 2 / (slow + 1)
    path = np.concatenate([[0.0], np.cumsum(np.abs(np.diff(x)))])
    out[period] = x[period]
    for i in range(period + 1, len(x)):
        way = path[i] - path[i - period]
        er = abs(x[i] - x[i - period]) / way if way > 0 else 0.0
        out[i] = out[i - 1] + (er * (quick - lazy) + lazy) ** 2 * (x[i] - out[i - 1])
    return out


def kalman_mean(x: np.ndarray, q: float = 0.01, r: float = 1.0) -> np.ndarray:
    """Random-walk level filter that starts at the first value; the first step is an update only."""
    out = np.empty(len(x))
    level, p = (x[0] if len(x) else 0.0), 1.0
    for i, v in enumerate(x):
        if i:
            p += q
        k = p / (p + r)
        level += k * (v - level)
        p *= 1 - k
        out[i] = level
    return out


def kalman_hedge(a: np.ndarray, b: np.ndarray, delta: float = 1e-4, noise: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slope, level, innovation) of a = slope x b + level with a random-walk state from (1, 0)."""
    n = len(a)
    slope, level, innovation = (np.full(n, np.nan) for _ in range(3))
    x, p = np.array([1.0, 0.0]), np.eye(2)
    for i in range(n):
        p = p + delta * np.eye(2)
        h = np.array([b[i], 1.0])
        y = a[i] - h @ x
        s = h @ p @ h + noise
        if not s > 0:
            break
        k = p @ h / s
        x = x + k * y
        p = p - np.outer(k, h) @ p
        slope[i], level[i], innovation[i] = x[0], x[1], y
    return slope, level, innovation


def max_hold_exits(entries: np.ndarray, natural: np.ndarray, most: int) -> np.ndarray:
    """Natural exits, and one forced ``most`` bars after an entry without a natural one."""
    out, held = natural.copy(), -1
    for i in range(len(entries)):
        if held < 0:
            if entries[i]:
                held = 0
            continue
        held += 1
        if natural[i]:
            held = -1
        elif held >= most:
            out[i], held = True, -1
    return out


def time_decay_exits(z: np.ndarray, entries: np.ndarray, raw_exit: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """The exit level shrinks with time in the trade, down to a tenth, and time is up at ``most``."""
    out, held = np.zeros(len(z), dtype=bool), -1
    z = np.nan_to_num(z)
    for i in range(len(z)):
        if held < 0:
            if entries[i]:
                held = 0
            continue
        held += 1
        if z[i] >= threshold * max(1 - held / most, 0.1) or held >= most or raw_exit[i]:
            out[i], held = True, -1
    return out


def positions(close: np.ndarray, entry: np.ndarray, exit_: np.ndarray, stop: float = 0.0, fee: float = 0.001) -> dict[str, np.ndarray]:
    """Long or flat, bar by bar: stop, then exit, then hold, then enter; no exit and entry in one bar.

    Returns daily returns with fees on the entry and the exit bar, the position after each bar, and
    on a trade's last bar its summed return.
    """
    n = len(close)
    ret, pos, trade = np.zeros(n), np.zeros(n, dtype=np.int64), np.full(n, np.nan)
    held, at, run = False, 0.0, 0.0
    for i in range(1, n):
        r = close[i] / close[i - 1] - 1 if close[i - 1] > 0 else 0.0
        if held:
            out = (stop > 0 and close[i] / at - 1 <= -stop) or bool(exit_[i])
            ret[i] = r - fee if out else r
            run += ret[i]
            if out:
                held, trade[i] = False, run
        elif entry[i]:
            held, at, run = True, close[i], -fee
            ret[i] = -fee
        pos[i] = held
    if held and n:
        trade[n - 1] = run
    return {"ret": ret, "position": pos, "trade_ret": trade}


def double_bottom(x: np.ndarray, window: int, tolerance: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, exits) of a second trough near the last one.

    A trough is the bar before one that rises, if it is no higher than the ``window`` bars before it. It
    opens a trade if it lies within ``tolerance`` of the trough before, at least ``window`` bars after it,
    and the price has since stood above that trough by the tolerance. A trade ends at the highest of
    ``window`` bars or after ``most`` bars, its first one counted.
    """
    n = len(x)
    go, leave = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n <= window + 1:
        return go, leave
    views = np.lib.stride_tricks.sliding_window_view(x, window)
    lowest, highest = views.min(axis=1), views.max(axis=1)
    # A trough at bar i - 1 is known at bar i; lowest[k] is of the bars k .. k + window - 1.
    i = np.arange(window + 1, n)
    known = i[(x[i - 1] <= lowest[i - 1 - window]) & (x[i] > x[i - 1])]
    pairs = [(a, b) for a, b in zip(known, known[1:]) if b - a >= window and abs(x[b - 1] / x[a - 1] - 1) <= tolerance and x[a : b + 1].max() >= x[a - 1] * (1 + tolerance)]
    free = 0  # the first bar on which no trade is open
    for _, b in pairs:
        if b >= free:
            ends = np.flatnonzero(x[b : b + most] == highest[b - window + 1 : b - window + 1 + len(x[b : b + most])])
            end = b + (ends[0] if len(ends) else most - 1)
            go[b] = True
            if end < n:
                leave[end] = True
            free = end + 1
    return go, leave
