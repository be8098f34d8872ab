"""Signals as NumPy functions of one stretch of bars, for what tries many settings on many stretches.

A segment signal is (ratio, window, settings) to where it wants in and out, before the shift by a bar.
The settings are entry, exit_, slope_min and slope_window; missing ones have the signal's own defaults.
They say the same as the signals of one name in ``signals``, which hold the long tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd

from ..functions import unitroot
from . import kernels as K

Flags = tuple[np.ndarray, np.ndarray]
SegmentSignal = Callable[[np.ndarray, int, dict], Flags]
#: Deviations below this are none.
FLAT = 1e-10


def rolled(x: np.ndarray, w: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``f`` of each window of w values, NaN before the first."""
    out = np.full(len(x), np.nan)
    if len(x) >= w > 0:
        out[w - 1 :] = f(np.lib.stride_tricks.sliding_window_view(x, w))
    return out


def mean(x: np.ndarray, w: int) -> np.ndarray:
    return rolled(x, w, lambda v: v.mean(axis=1))


def deviation(x: np.ndarray, w: int) -> np.ndarray:
    sd = rolled(x, w, lambda v: v.std(axis=1, ddof=1)) if w > 1 else np.full(len(x), np.nan)
    return np.where(sd > FLAT, sd, np.nan)


def zscore(x: np.ndarray, w: int) -> np.ndarray:
    return (x - mean(x, w)) / deviation(x, w)


def _steep(z: np.ndarray, p: dict) -> np.ndarray:
    least, n = p.get("slope_min", 0.0), int(p.get("slope_window", 2))
    if not least:
        return np.ones(len(z), dtype=bool)
    slope = np.full(len(z), np.nan)
    slope[n:] = (z[n:] - z[:-n]) / n
    return slope >= least


def _levels(z: np.ndarray, p: dict, entry: float = -2.0, exit_: float = 0.0) -> Flags:
    return (z <= p.get("entry", entry)) & _steep(z, p), z >= p.get("exit_", exit_)


def _robust(x: np.ndarray, w: int) -> np.ndarray:
    m = rolled(x, w, lambda v: np.median(v, axis=1))
    d = rolled(np.abs(x - m), w, lambda v: np.median(v, axis=1))
    return (x - m) / np.where(d > FLAT, 1.4826 * d, np.nan)


def _rsi(x: np.ndarray, n: int) -> np.ndarray:
    d = K.diff(x)
    gain, loss = (mean(np.where(np.isnan(d), np.nan, np.clip(s * d, 0, None)), n) for s in (1, -1))
    return 100 - 100 / (1 + gain / np.where(loss == 0, np.nan, loss))


def _state(on: np.ndarray) -> Flags:
    return on, ~on


def _momentum(x: np.ndarray, w: int, p: dict) -> Flags:
    before = np.full(len(x), np.nan)
    before[w:] = x[: max(len(x) - w, 0)]
    return _state(x / before - 1 > 0)


def _donchian(x: np.ndarray, w: int, p: dict) -> Flags:
    n, m = max(int(p.get("entry", 20)), 5), max(int(p.get("exit_", 10)), 3)
    last = lambda k, f: np.concatenate([[np.nan], rolled(x, k, f)[:-1]])  # noqa: E731  of the bars before
    return x >= last(n, lambda v: v.max(axis=1)), x <= last(m, lambda v: v.min(axis=1))


def _adx_gate(x: np.ndarray, w: int, p: dict) -> Flags:
    adx = np.nan_to_num(K.adx_close(x), nan=30.0)
    z = zscore(x, w)
    return z <= p.get("entry", -2.0), z >= p.get("exit_", 0.5) * np.where(adx > 40, 1.5, np.where(adx < 20, 0.5, 1.0))


def _pullback(x: np.ndarray, w: int, p: dict) -> Flags:
    atr = K.atr_close(x)
    depth = (rolled(x, w, lambda v: v.max(axis=1)) - x) / np.where(atr == 0, np.nan, atr)
    return depth >= p.get("entry", 2.0), depth <= p.get("exit_", 0.5)


def _regime(x: np.ndarray, w: int, p: dict) -> Flags:
    z, on, adx = zscore(x, w), x > mean(x, w), np.nan_to_num(K.adx_close(x), nan=22.5)
    was = K.shifted(on)
    quiet, moving = adx < p.get("ranging", 20.0), adx > p.get("trending", 25.0)
    return (quiet & (z <= p.get("entry", -2.0))) | (moving & on & ~was), (quiet & (z >= p.get("exit_", 0.0))) | (moving & ~on & was)


def _decay(x: np.ndarray, w: int, p: dict) -> Flags:
    z, hl = zscore(x, w), np.nan
    go, leave = z <= p.get("entry", -2.0), z >= p.get("exit_", 0.5)
    if len(x) >= 30 and np.ptp(x[:-1]) > 0:
        slope = np.polyfit(x[:-1], np.diff(x), 1)[0]
        hl = -np.log(2) / slope if slope < 0 else np.nan
    return go, K.time_decay_exits(z, go, leave, p.get("exit_", 0.5), int(2 * hl)) if hl >= 2 else leave


def _change(x: np.ndarray) -> np.ndarray:
    before = np.where(x[:-1] == 0, np.nan, x[:-1])
    return np.concatenate([[np.nan], x[1:] / before - 1])


def _lowest(x: np.ndarray, w: int) -> np.ndarray:
    return rolled(x, w, lambda v: v.min(axis=1))


def _highest(x: np.ndarray, w: int) -> np.ndarray:
    return rolled(x, w, lambda v: v.max(axis=1))


def _held(go: np.ndarray, leave: np.ndarray, most: int) -> Flags:
    """Out at the latest ``most`` bars after an entry."""
    return go, K.max_hold_exits(go, leave, most)


def _known(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, np.nan, v)


def _connors(x: np.ndarray, w: int, p: dict) -> Flags:
    up = x > mean(x, int(p.get("sma_long", 200))) if p.get("trend_filter", True) else np.ones(len(x), bool)
    rsi = K.rsi_wilder(x, w)
    return _held((rsi <= p.get("entry", 25.0)) & up, (x > mean(x, int(p.get("sma_short", 5)))) | (rsi >= p.get("exit_", 55.0)), int(p.get("max_hold", 10)))


def _cumulated(x: np.ndarray, w: int, p: dict) -> Flags:
    rsi = _rsi(x, w)
    cum = rolled(rsi, 2, lambda v: v.sum(axis=1))
    return (cum <= p.get("entry", 35.0)) & _steep(cum, p), (rsi >= p.get("exit_", 65.0)) | (x > mean(x, 5))


def _ranked(v: np.ndarray, w: int, p: dict) -> np.ndarray:
    return np.nan_to_num(K.percent_rank(v, int(p.get("lookback", 252)), w), nan=0.5)


def _volatility(x: np.ndarray, w: int) -> np.ndarray:
    return rolled(_change(x), w, lambda v: v.std(axis=1, ddof=1)) if w > 1 else np.full(len(x), np.nan)


def _adaptive(x: np.ndarray, w: int, p: dict) -> Flags:
    z, scale = zscore(x, w), 1 + 0.5 * (_ranked(_volatility(x, w), w, p) - 0.5)
    return (z <= p.get("entry", -2.0) * scale) & _steep(z, p), z >= p.get("exit_", 0.0) * scale


def _forecast(x: np.ndarray, w: int, p: dict) -> Flags:
    vol, z = _volatility(x, w), zscore(x, w)
    long = pd.Series(vol).rolling(int(p.get("lookback", 252)), min_periods=w).mean().to_numpy()
    rank = _ranked(0.7 * K.ema(vol, w, least=1) + 0.3 * long, w, p)
    return (z <= p.get("entry", -2.0)) & (rank <= p.get("calm", 0.30)), (z >= p.get("exit_", 0.0)) | (rank >= p.get("wild", 0.75))


def _midline(x: np.ndarray, w: int, p: dict) -> Flags:
    low, width = _lowest(x, w), _highest(x, w) - _lowest(x, w)
    return x < low + p.get("entry", 0.2) * width, x >= low + p.get("exit_", 0.5) * width


def _keltner(x: np.ndarray, w: int, p: dict) -> Flags:
    z = (x - K.ema(x, w, adjust=False)) / _known(K.atr_close(x, int(p.get("atr_lookback", 14))))
    return _levels(z, p | {"entry": -p.get("entry", 2.0)})


def _cointegrated(x: np.ndarray, w: int, p: dict) -> Flags:
    if unitroot.pvalue(unitroot.adf(unitroot.sums_of(x))[0]) > p.get("alpha", 0.05):
        return np.zeros(len(x), bool), np.zeros(len(x), bool)
    return _levels(zscore(x, w), p)


def _distance(x: np.ndarray, w: int, p: dict) -> Flags:
    d = x / _known(mean(x, w)) - 1
    return d < p.get("entry", -0.02), d > p.get("exit_", 0.0)


def _stochastic(x: np.ndarray, w: int, p: dict) -> Flags:
    low = _lowest(x, w)
    k = mean(100 * (x - low) / _known(_highest(x, w) - low), int(p.get("smooth", 3)))
    return k < p.get("entry", 20.0), k > p.get("exit_", 80.0)


def _williams(x: np.ndarray, w: int, p: dict) -> Flags:
    high = _highest(x, w)
    r = -100 * (high - x) / _known(high - _lowest(x, w))
    return r < p.get("entry", -80.0), r > p.get("exit_", -20.0)


def _falling(x: np.ndarray, w: int, p: dict) -> Flags:
    r = _change(x)
    down = r < p.get("entry", 0.0)
    rows = np.arange(len(x))
    streak = rows - np.maximum.accumulate(np.where(down, -1, rows))
    return _held((streak >= w) & (x > mean(x, int(p.get("sma_long", 200)))), r > 0, int(p.get("exit_", 5)))


def _nday(x: np.ndarray, w: int, p: dict) -> Flags:
    return _held((x <= _lowest(x, w)) & (x > mean(x, int(p.get("entry", 200)))), x >= _highest(x, w), int(p.get("exit_", 10)))


def _ema_pullback(x: np.ndarray, w: int, p: dict) -> Flags:
    e, n, swing = K.ema(x, w, adjust=False), int(p.get("lookback", 5)), int(p.get("swing", 3))
    touch = x <= e
    recent = pd.Series(touch.astype(float)).rolling(n, min_periods=1).max().to_numpy() == 1
    before = np.concatenate([[np.nan], x[:-1]])
    ups = pd.Series((x > before).astype(float)).rolling(swing - 1).sum().shift(1).to_numpy()
    return (K.adx_close(x) > p.get("entry", 25.0)) & (x > e) & K.shifted(touch) & recent, (x < before) & (ups == swing - 1)


#: Each signal's own thresholds (entry, exit), for what varies them without a row of an optimiser.
THRESHOLDS: dict[str, tuple[float, float]] = {
    "rsi_simple": (30.0, 60.0), "rsi_wilder": (30.0, 60.0), "rsi_connors": (25.0, 55.0), "cum_rsi": (35.0, 65.0), "donchian": (20.0, 10.0), "donchian_midline": (0.2, 0.5),
    "adx_regime_gate": (-2.0, 0.5), "atr_pullback": (2.0, 0.5), "halflife_time_decay": (-2.0, 0.5), "keltner": (2.0, 0.0), "sma_distance": (-0.02, 0.0), "stochastic_k": (20.0, 80.0),
    "williams_r": (-80.0, -20.0), "consec_down": (0.0, 5.0), "nday_low": (200.0, 10.0), "double_bottom": (0.02, 20.0), "adx_ema_pullback": (25.0, 0.0),
    "ma_crossover": (0.0, 0.0), "ema_crossover": (0.0, 0.0), "dual_ma_crossover": (0.0, 0.0), "kama_crossover": (0.0, 0.0), "momentum": (0.0, 0.0),
}
#: Users add their own under a name.
SEGMENT_SIGNALS: dict[str, SegmentSignal] = {
    "zscore_standard": lambda x, w, p: _levels(zscore(x, w), p),
    "bollinger": lambda x, w, p: _levels(zscore(x, w), p),
    "zscore_robust_mad": lambda x, w, p: _levels(_robust(x, w), p),
    "kalman_hedge": lambda x, w, p: _levels(_robust(x - K.kalman_mean(x), w), p),
    "rsi_simple": lambda x, w, p: _levels(_rsi(x, w), p, 30.0, 60.0),
    "rsi_wilder": lambda x, w, p: _levels(K.rsi_wilder(x, w), p, 30.0, 60.0),
    "ma_crossover": lambda x, w, p: _state(x > mean(x, w)),
    "ema_crossover": lambda x, w, p: _state(x > K.ema(x, w)),
    "dual_ma_crossover": lambda x, w, p: _state(mean(x, max(int(0.33 * w), 5)) > mean(x, w)),
    "kama_crossover": lambda x, w, p: _state(x > K.kama(x, w)),
    "momentum": _momentum,
    "donchian": _donchian,
    "adx_regime_gate": _adx_gate,
    "atr_pullback": _pullback,
    "regime_switch": _regime,
    "halflife_time_decay": _decay,
    "vol_adaptive_zscore": _adaptive,
    "vol_forecast_gate": _forecast,
    "rsi_connors": _connors,
    "cum_rsi": _cumulated,
    "donchian_midline": _midline,
    "keltner": _keltner,
    "cointegration_spread": _cointegrated,
    "sma_distance": _distance,
    "stochastic_k": _stochastic,
    "williams_r": _williams,
    "consec_down": _falling,
    "nday_low": _nday,
    "double_bottom": lambda x, w, p: K.double_bottom(x, w, p.get("entry", 0.02), int(p.get("exit_", 20))),
    "adx_ema_pullback": _ema_pullback,
}


def segment_signal(signal: str | SegmentSignal) -> SegmentSignal:
    if not isinstance(signal, str):
        return signal
    if signal not in SEGMENT_SIGNALS:
        raise KeyError(f"no segment signal {signal!r}; there are {', '.join(sorted(SEGMENT_SIGNALS))}")
    return SEGMENT_SIGNALS[signal]


def flags(signal: SegmentSignal, x: np.ndarray, w: int, p: dict) -> Flags:
    """The flags as they act: one bar later; comparisons with a missing value are false."""
    with np.errstate(divide="ignore", invalid="ignore"):
        go, leave = signal(x, w, p)
    return K.shifted(np.asarray(go, dtype=bool)), K.shifted(np.asarray(leave, dtype=bool))


def fold_window(x: np.ndarray, default: int) -> int:
    """The look-back that a part's half-life asks for; the default if it doesn't revert."""
    p, d = x[:-1], np.diff(x)
    if len(x) < 30 or not np.ptp(p) > 0:
        return default
    slope = ((p - p.mean()) * (d - d.mean())).sum() / ((p - p.mean()) ** 2).sum()
    return min(max(int(-math.log(2) / math.log1p(slope) * 0.5), 10), 252) if -1 < slope < 0 else default


def sharpe(r: np.ndarray, ddof: int = 1) -> float:
    sd = r.std(ddof=ddof) if len(r) > ddof else 0.0
    return float(r.mean() / sd * math.sqrt(252)) if sd > FLAT else 0.0


def deepest(r: np.ndarray) -> float:
    curve = np.cumprod(1 + r)
    return float((curve / np.maximum.accumulate(curve) - 1).min()) if len(r) else 0.0


def cagr(r: np.ndarray) -> float:
    end = np.prod(1 + r) if len(r) else 1.0
    return float(end ** (252 / len(r)) - 1) if len(r) and end > 0 else -1.0 if len(r) else 0.0
