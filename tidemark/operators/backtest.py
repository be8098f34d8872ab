"""Backtests: signals to positions to daily returns, and their metrics.

``run`` needs ``series`` columns with entry and exit; it adds ret, position and trade_ret. Summaries
are plain aggregates by any keys, so folds and parameter sets only add grouping columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import kernels as K, segments as SG

YEAR = 252


def run(signals: DataFrame, stop: float = 0.0, fee: float = 0.001, price: str = "num_close", key: str = "pair", seq: str = "seq") -> DataFrame:
    return K.per_key(signals, lambda c: K.positions(c[price], c["entry"], c["exit"], stop, fee), {"ret": "double", "position": "long", "trade_ret": "double"}, [price, "entry", "exit"], key, seq)


def sharpe(r: Column, ddof: int = 1) -> Column:
    sd = F.stddev_samp(r) if ddof else F.stddev_pop(r)
    return F.coalesce(F.when(sd > 1e-10, F.avg(r) / sd * math.sqrt(YEAR)), F.lit(0.0))


def growth(r: Column) -> Column:
    """Product of 1 + r; null if any factor is not positive."""
    return F.when(F.min(1 + r) > 0, F.exp(F.sum(F.ln(F.when(r > -1, 1 + r)))))


def cagr(r: Column) -> Column:
    return F.coalesce(F.pow(growth(r), YEAR / F.count(r)) - 1, F.lit(-1.0))


def with_equity(rets: DataFrame, r: str = "ret", key: str | list[str] = "pair", seq: str = "seq") -> DataFrame:
    from pyspark.sql import Window as W

    keys = [key] if isinstance(key, str) else key
    w = W.partitionBy(*keys).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    out = rets.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col(r))).over(w)))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def summary(rets: DataFrame, *by: str, seq: str = "seq") -> DataFrame:
    """Sharpe, CAGR, deepest drawdown, trades and share of winning trades by the given keys."""
    curves = with_equity(rets, key=list(by), seq=seq)
    r = F.col("ret")
    return curves.groupBy(*by).agg(
        sharpe(r).alias("sharpe"), cagr(r).alias("cagr"), F.min("drawdown").alias("max_dd"), F.count("trade_ret").alias("n_trades"),
        F.coalesce(F.avg((F.col("trade_ret") > 0).cast("int")), F.lit(0.0)).alias("hit_rate"), F.count("*").alias("n_bars"),
    )


def penalised(sr: Column, n_params: int, trades: Column, missing: float = 0.0) -> Column:
    return F.when(trades >= n_params, sr * F.sqrt(1 - n_params / F.nullif(trades.cast("double"), F.lit(0.0)))).otherwise(F.lit(missing))


def state_backtest(series: DataFrame, on: Column, price: str = "ratio", key: str = "pair", seq: str = "seq") -> DataFrame:
    """A 0/1 state traded with windows alone: the return to the next bar while on."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(seq)
    s = series.withColumn("position", F.coalesce(on.cast("int"), F.lit(0)))
    s = s.withColumn("ret", F.coalesce(F.lag("position").over(w), F.lit(0)) * F.coalesce(F.col(price) / F.nullif(F.lag(price).over(w), F.lit(0.0)) - 1, F.lit(0.0)))
    return s.withColumn("_open", (F.col("position") > F.coalesce(F.lag("position").over(w), F.lit(0))).cast("int")).withColumn("trade", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_open")


Combo = tuple[float, float, float]


def _product(entries: Sequence[float], exits: Sequence[float], stops: Sequence[float]) -> list[Combo]:
    return [(e, x, s) for e in entries for x in exits for s in stops]


def advance(close: np.ndarray, stop: np.ndarray, wants: Callable[[int], tuple[np.ndarray, np.ndarray]], fee: float, least_trades: int, n_params: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Sharpe, trades, penalised Sharpe) of many settings; -inf where there are too few trades.

    All advance together: one vector step per bar, not one bar loop per setting. ``wants(i)`` says which of
    them go in and which leave at bar i.
    """
    n, k = len(close), len(stop)
    held, at = np.zeros(k, dtype=bool), np.ones(k)
    trades, total, square = np.zeros(k, dtype=np.int64), np.zeros(k), np.zeros(k)
    floor = np.where(stop > 0, -stop, -np.inf)
    for i in range(1, n):
        go, leave = wants(i)
        r = close[i] / close[i - 1] - 1 if close[i - 1] > 0 else 0.0
        out = held & ((close[i] / at - 1 <= floor) | leave)
        enter = ~held & go
        ret = np.where(held, r, 0.0) - fee * (out | enter)
        total += ret
        square += ret * ret
        at = np.where(enter, close[i], at)
        trades += enter
        held = (held & ~out) | enter
    mean = total / n
    sd = np.sqrt(np.maximum(square - n * mean * mean, 0) / max(n - 1, 1))
    sr = np.where(sd > 1e-10, mean / np.where(sd > 0, sd, 1) * math.sqrt(YEAR), 0.0)
    ok = (trades >= least_trades) & (trades >= n_params)
    return sr, trades, np.where(ok, sr * np.sqrt(np.maximum(1 - n_params / np.maximum(trades, 1), 0)), -np.inf)


def _advance(close: np.ndarray, grid: Sequence[Combo], rules: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], fee: float, least_trades: int, n_params: int) -> tuple[int, float, int, float] | None:
    """(grid index, sharpe, trades, penalised) of the best entry, exit and stop; the first among equals.
    ``rules(i, entries, exits)`` says which of them want in and which want out after bar i."""
    if not grid or len(close) < 3:
        return None
    e, x, stop = (np.array(c) for c in zip(*grid))
    sr, trades, pen = advance(close, stop, lambda i: rules(i - 1, e, x), fee, least_trades, n_params)
    best = int(np.argmax(pen))
    return (best, float(sr[best]), int(trades[best]), float(pen[best])) if np.isfinite(pen[best]) else None


def threshold_rules(signal: np.ndarray, oversold: bool = True) -> Callable:
    def rules(i, e, x):
        z = signal[i]  # comparisons with a missing value are false
        return (z <= e, z >= x) if oversold else (z >= e, z <= x)

    return rules


def regime_rules(signal: np.ndarray, on: np.ndarray, adx: np.ndarray, trending: float = 25.0, ranging: float = 20.0) -> Callable:
    """Thresholds while the ADX is below ``ranging``; above ``trending`` the average's state turning on
    or off; between them, and where the ADX is missing, neither."""
    plain = threshold_rules(signal)

    def rules(i, e, x):
        if adx[i] < ranging:
            return plain(i, e, x)
        turned = int(on[i]) - int(on[i - 1] if i else 0) if adx[i] > trending else 0
        return np.full(len(e), turned > 0), np.full(len(e), turned < 0)

    return rules


def sweep(signal: np.ndarray, close: np.ndarray, entries: Sequence[float], exits: Sequence[float], stops: Sequence[float], fee: float = 0.001, least_trades: int = 3, n_params: int = 4, oversold: bool = True) -> tuple[int, float, int, float] | None:
    """The best of a threshold grid: (grid index, sharpe, trades, penalised)."""
    return _advance(close, _product(entries, exits, stops), threshold_rules(signal, oversold), fee, least_trades, n_params)


def sweep_regime(signal: np.ndarray, on: np.ndarray, adx: np.ndarray, close: np.ndarray, entries: Sequence[float], exits: Sequence[float], stops: Sequence[float], fee: float = 0.001, least_trades: int = 3, n_params: int = 4, trending: float = 25.0, ranging: float = 20.0) -> tuple[int, float, int, float] | None:
    """The best of a grid whose rules depend on the ADX regime: (grid index, sharpe, trades, penalised)."""
    return _advance(close, _product(entries, exits, stops), regime_rules(signal, on, adx, trending, ranging), fee, least_trades, n_params)


SEARCHED = "pair string, window double, entry_thresh double, exit_thresh double, stop_pct double, slope_min double, is_sharpe double, is_penalized_sharpe double, is_trades double, oos_sharpe double, oos_trades double, passed boolean"
#: A set of settings: window, entry, exit, stop, slope.
Trial = tuple[int, float, float, float, float]


class _Bars:
    """One pair's bars, cut in two, and the best of the settings tried on the first part."""

    def __init__(self, rows: pd.DataFrame, signal: SG.SegmentSignal, is_ratio: float, fee: float, extra: dict):
        rows = rows.sort_values("seq")
        self.x, self.close = rows["ratio"].to_numpy(float), rows["num_close"].to_numpy(float)
        self.pair, self.cut, self.signal, self.fee, self.extra = rows["pair"].iloc[0], int(len(rows) * is_ratio), signal, fee, extra
        self.window = int(rows["window"].iloc[0]) if "window" in rows and rows["window"].iloc[0] > 0 else 20

    def settings(self, t: Trial) -> dict:
        return self.extra | {"entry": t[1], "exit_": t[2], "slope_min": t[4]}

    def scores(self, trials: Sequence[Trial], least_trades: int, n_params: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(Sharpe, trades, penalised) of each trial on the first part; all advance together. Too few trades: -inf."""
        made: dict[tuple, SG.Flags] = {}
        for t in trials:
            key = (t[0], t[1], t[2], t[4])
            if key not in made:
                made[key] = SG.flags(self.signal, self.x[: self.cut], t[0], self.settings(t))
        go, leave = (np.stack([made[t[0], t[1], t[2], t[4]][side] for t in trials], axis=1) for side in (0, 1))
        return advance(self.close[: self.cut], np.array([t[3] for t in trials]), lambda i: (go[i], leave[i]), self.fee, least_trades, n_params)

    def row(self, t: Trial, sr: float, pen: float, trades: int, least_oos: float, least_oos_trades: int) -> tuple:
        p = K.positions(self.close[self.cut :], *SG.flags(self.signal, self.x[self.cut :], t[0], self.settings(t)), t[3], self.fee)
        oos, n = SG.sharpe(p["ret"]), int(np.isfinite(p["trade_ret"]).sum())
        return self.pair, float(t[0]), t[1], t[2], t[3], t[4], sr, pen, float(trades), oos, float(n), bool(oos >= least_oos and n >= least_oos_trades)


def _search(series: DataFrame, choose: Callable[[_Bars], tuple[Trial, float, float, int] | None], signal: str | SG.SegmentSignal, is_ratio: float, least_is: float, least_oos: float, least_oos_trades: int, fee: float, extra: dict) -> DataFrame:
    """What ``choose`` finds on the first part of each pair, tried on the rest; a row for each pair where it
    reaches ``least_is``. A task holds one pair: all settings are tried on its bars in place."""
    fn = SG.segment_signal(signal)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        bars = _Bars(rows, fn, is_ratio, fee, extra)
        got = choose(bars) if bars.cut >= 3 and len(rows) - bars.cut >= 3 else None
        found = [bars.row(got[0], *got[1:], least_oos, least_oos_trades)] if got and got[1] >= least_is else []
        return pd.DataFrame(found, columns=[c.split()[0] for c in SEARCHED.split(", ")])

    columns = [c for c in ("pair", "seq", "ratio", "num_close", "window") if c in series.columns]
    return series.select(*columns).groupBy("pair").applyInPandas(one, SEARCHED)


# The published grids.
ENTRIES, EXITS, STOPS, SLOPES = (-4.0, -3.5, -3.0, -2.5, -2.0, -1.5, -1.0), (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0), (0.0, 0.1, 0.2), (0.0,)


def grid_search(series: DataFrame, signal: str | SG.SegmentSignal = "zscore_standard", windows: Sequence[int] | None = None, entries: Sequence[float] = ENTRIES, exits: Sequence[float] = EXITS, stops: Sequence[float] = STOPS, slopes: Sequence[float] = SLOPES, is_ratio: float = 0.8, least_trades: int = 5, least_is: float = 0.5, least_oos: float = 0.0, least_oos_trades: int = 5, fee: float = 0.001, **extra) -> DataFrame:
    """Every entry, exit, stop, slope and window; the best penalised Sharpe, the first in that order among
    equals. Without ``windows`` the pair's own ``window`` column counts, or 20."""

    def choose(b: _Bars) -> tuple[Trial, float, float, int] | None:
        trials = [(w, float(e), float(x), float(s), float(m)) for e in entries for x in exits for s in stops for m in slopes for w in (windows or (b.window,))]
        sr, n, pen = b.scores(trials, least_trades, 5 if windows and len(windows) > 1 else 4)
        best = int(np.argmax(pen))
        return (trials[best], float(sr[best]), float(pen[best]), int(n[best])) if np.isfinite(pen[best]) else None

    return _search(series, choose, signal, is_ratio, least_is, least_oos, least_oos_trades, fee, extra)


def grid_regime(series: DataFrame, trending: float = 25.0, ranging: float = 20.0, **options) -> DataFrame:
    """The grid with the rules of the ADX regime: thresholds while the ADX is below ``ranging``; above
    ``trending`` the average's state turning on or off; between them neither."""
    return grid_search(series, "regime_switch", trending=trending, ranging=ranging, **options)


def _parzen(rng: np.random.Generator, values: Sequence, good: list[int], bad: list[int], draws: int) -> np.ndarray:
    """Of ``draws`` values from the good trials' smoothed frequencies, by place, their odds against the bad ones."""
    weight = lambda seen: (np.bincount(seen, minlength=len(values)) + 1.0) / (len(seen) + len(values))
    p, q = weight(good), weight(bad)
    at = rng.choice(len(values), size=draws, p=p / p.sum())
    return np.stack([at, np.log(p[at] / q[at])])


def tpe(rng: np.random.Generator, grids: Sequence[Sequence], score: Callable[[tuple], float], trials: int, start: int = 10, draws: int = 24) -> tuple[tuple | None, float]:
    """Tree-structured Parzen estimators over independent categorical settings: after ``start`` random
    trials each is the draw with the best odds of belonging to the best tenth (25 at most)."""
    seen: list[tuple[int, ...]] = []
    values: list[float] = []
    for k in range(trials):
        if k < start:
            at = tuple(int(rng.integers(len(g))) for g in grids)
        else:
            order = np.argsort([-v for v in values], kind="stable")
            n = min(25, max(1, math.ceil(0.1 * k)))
            parts = [_parzen(rng, g, [seen[i][d] for i in order[:n]], [seen[i][d] for i in order[n:]], draws) for d, g in enumerate(grids)]
            best = int(np.argmax(sum(p[1] for p in parts)))
            at = tuple(int(p[0][best]) for p in parts)
        seen.append(at)
        values.append(score(tuple(g[i] for g, i in zip(grids, at, strict=True))))
    top = int(np.argmax(values))
    return (tuple(g[i] for g, i in zip(grids, seen[top], strict=True)), values[top]) if np.isfinite(values[top]) else (None, -np.inf)


def optuna_tpe(series: DataFrame, signal: str | SG.SegmentSignal = "zscore_standard", trials: int = 50, seed: int = 42, windows: Sequence[int] | None = None, entries: Sequence[float] = ENTRIES, exits: Sequence[float] = EXITS, stops: Sequence[float] = STOPS, slopes: Sequence[float] = SLOPES, is_ratio: float = 0.8, least_trades: int = 5, least_is: float = 0.5, least_oos: float = 0.0, least_oos_trades: int = 5, fee: float = 0.001, **extra) -> DataFrame:
    """Seeded TPE trials over the same grids; each pair has a sampler of its own."""

    def choose(b: _Bars) -> tuple[Trial, float, float, int] | None:
        known: dict[tuple, tuple[float, int, float]] = {}

        def score(t: tuple) -> float:
            if t not in known:
                sr, n, pen = b.scores([t], least_trades, 5)
                known[t] = float(sr[0]), int(n[0]), float(pen[0])
            return known[t][2]

        grids = [windows or (b.window,), *([float(v) for v in g] for g in (entries, exits, stops, slopes))]
        best, pen = tpe(np.random.default_rng(seed), grids, score, trials)
        return (best, known[best][0], pen, known[best][1]) if best else None

    return _search(series, choose, signal, is_ratio, least_is, least_oos, least_oos_trades, fee, extra)


def optuna_ma(series: DataFrame, kind: str = "sma", trials: int = 50, seed: int = 42, low: int = 10, high: int = 270, is_ratio: float = 0.8) -> DataFrame:
    """Seeded TPE trials over the look-back of a moving-average state."""

    def choose(score: Callable[[int], float]) -> int | None:
        found, _ = tpe(np.random.default_rng(seed), [range(low, high + 1)], lambda t: score(t[0]), trials)
        return found[0] if found else None

    return _ma_search(series, kind, choose, is_ratio)


def _ma_signal(kind: str, x: pd.Series, w: int) -> np.ndarray:
    if kind == "sma":
        on = x > x.rolling(w).mean()
    elif kind == "ema":
        on = x > x.ewm(span=w, min_periods=w).mean()
    elif kind == "dual":
        on = x.rolling(max(w // 3, 2)).mean() > x.rolling(w).mean()
    elif kind == "kama":
        on = pd.Series(np.nan_to_num(x.to_numpy() - K.kama(x.to_numpy(float), w)) > 0)
    elif kind == "momentum":
        on = x.pct_change(w) > 0
    else:
        raise KeyError(f"no moving-average signal {kind!r}; there are sma, ema, dual, kama, momentum")
    return on.to_numpy()


def _ma_search(series: DataFrame, kind: str, choose: Callable[[Callable[[int], float]], int | None], is_ratio: float) -> DataFrame:
    schema = "pair string, window long, is_sharpe double, oos_sharpe double, oos_cagr double, oos_max_dd double, oos_exposure double, lag5_autocorr double, passed boolean"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq").reset_index(drop=True)
        x = rows["ratio"]
        r = x.pct_change().fillna(0.0).to_numpy()
        cut = int(len(rows) * is_ratio)
        net = lambda w: r * K.shifted(_ma_signal(kind, x, w))
        w = choose(lambda w: SG.sharpe(net(w)[:cut])) if cut < len(rows) else None
        if w is None:
            return pd.DataFrame([], columns=[c.split()[0] for c in schema.split(", ")])
        whole = net(w)
        out = whole[cut:]
        ac = np.corrcoef(out[5:], out[:-5])[0, 1] if len(out) > 10 and out.std() > 0 else 0.0
        s = SG.sharpe(out)
        return pd.DataFrame([(rows["pair"].iloc[0], w, SG.sharpe(whole[:cut]), s, float((1 + out.mean()) ** YEAR - 1), SG.deepest(out), float((out != 0).mean()), float(np.nan_to_num(ac)), s > 0)], columns=[c.split()[0] for c in schema.split(", ")])

    return series.groupBy("pair").applyInPandas(one, schema)


def grid_ma(series: DataFrame, kind: str = "sma", low: int = 10, high: int = 270, step: int = 1, is_ratio: float = 0.8) -> DataFrame:
    """Every look-back of a moving-average state on the first part, the best one on the rest; pairs
    are aligned by date before, never by position."""
    return _ma_search(series, kind, lambda score: max(range(low, high + 1, step), key=score), is_ratio)


def best_first(rows: DataFrame, key: str, score: str, index: str) -> DataFrame:
    """The best row of each key; among equals the first in grid order."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(F.col(score).desc(), index)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
