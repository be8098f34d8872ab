"""Trading signals: ``signal(series, ...) -> series + entry, exit``.

Window signals are column expressions; recurrent ones run a NumPy kernel per pair. Unless said
otherwise both flags act one bar after they show. ``SIGNALS`` names them all; a user's own function
of the same form can be registered with ``register_signal``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rolling as R
from . import kernels as K

SIGNALS: dict[str, Callable[..., DataFrame]] = {}


def register_signal(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    SIGNALS[fn.__name__] = fn
    return fn


def _out(df: DataFrame, entry: Column, exit_: Column, shift: bool = True) -> DataFrame:
    keep = [c for c in df.columns if not c.startswith("_")]
    flagged = df.withColumn("_entry", F.coalesce(entry, F.lit(False))).withColumn("_exit", F.coalesce(exit_, F.lit(False)))
    if not shift:
        return flagged.select(*keep, F.col("_entry").alias("entry"), F.col("_exit").alias("exit"))
    return flagged.select(*keep, R.next_bar(F.col("_entry")).alias("entry"), R.next_bar(F.col("_exit")).alias("exit"))


def _sloped(df: DataFrame, z: Column, n: int) -> DataFrame:
    df = df.withColumn("_z", z)
    return df.withColumn("_s", (F.col("_z") - R.lag(F.col("_z"), n)) / n)


def _level(df: DataFrame, z: Column, entry: float, exit_: float, slope_min: float, slope_window: int) -> DataFrame:
    df = _sloped(df, z, slope_window)
    steep = (F.col("_s") >= slope_min) if slope_min else F.lit(True)
    return _out(df, (F.col("_z") <= entry) & steep, F.col("_z") >= exit_)


def _state(df: DataFrame, on: Column) -> DataFrame:
    """In while ``on``: entries where it is true, exits where it is false or unknown."""
    on = F.coalesce(on, F.lit(False))
    return _out(df, on, ~on)


@register_signal
def zscore_standard(s: DataFrame, window: int = 20, entry: float = -2.0, exit_: float = 0.0, slope_min: float = 0.0, slope_window: int = 2) -> DataFrame:
    return _level(s, R.zscore(F.col("ratio"), window), entry, exit_, slope_min, slope_window)


def robust_zscore(s: DataFrame, window: int, to: str = "_rz", value: str = "ratio") -> DataFrame:
    """Distance from the rolling median in units of 1.4826 rolling median absolute deviations, each
    bar measured from its own rolling median."""
    x = F.col(value)
    s = s.withColumn("_m", R.median(x, window)).withColumn("_d", F.abs(x - F.col("_m")))
    return s.withColumn(to, R.ratio_or_null(x - F.col("_m"), 1.4826 * R.median(F.col("_d"), window)))


@register_signal
def zscore_robust_mad(s: DataFrame, window: int = 20, entry: float = -2.0, exit_: float = 0.0, slope_min: float = 0.0, slope_window: int = 2) -> DataFrame:
    return _level(robust_zscore(s, window), F.col("_rz"), entry, exit_, slope_min, slope_window)


@register_signal
def bollinger(s: DataFrame, window: int = 20, entry: float = -2.0, exit_: float = 0.0, slope_min: float = 0.0, slope_window: int = 2) -> DataFrame:
    x = F.col("ratio")
    m, d = R.mean(x, window), R.std(x, window)
    s = s.withColumn("_z", R.ratio_or_null(x - m, d)).withColumn("_lo", m + entry * d).withColumn("_hi", m + exit_ * d)
    s = s.withColumn("_s", (F.col("_z") - R.lag(F.col("_z"), slope_window)) / slope_window)
    steep = (F.col("_s") >= slope_min) if slope_min else F.lit(True)
    return _out(s, (x <= F.col("_lo")) & steep, x >= F.col("_hi"))


@register_signal
def kalman_hedge(s: DataFrame, window: int = 20, entry: float = -2.0, exit_: float = 0.0, slope_min: float = 0.0, slope_window: int = 2) -> DataFrame:
    s = K.per_key(s, lambda c: {"_resid": c["ratio"] - K.kalman_mean(c["ratio"])}, {"_resid": "double"}, ["ratio"])
    return _level(robust_zscore(s, window, value="_resid"), F.col("_rz"), entry, exit_, slope_min, slope_window)


@register_signal
def ma_crossover(s: DataFrame, window: int = 20, **_) -> DataFrame:
    return _state(s, F.col("ratio") > R.mean(F.col("ratio"), window))


@register_signal
def ema_crossover(s: DataFrame, window: int = 20, **_) -> DataFrame:
    s = K.per_key(s, lambda c: {"_ema": K.ema(c["ratio"], window)}, {"_ema": "double"}, ["ratio"])
    return _state(s, F.col("ratio") > F.col("_ema"))


@register_signal
def dual_ma_crossover(s: DataFrame, window: int = 60, **_) -> DataFrame:
    x = F.col("ratio")
    return _state(s, R.mean(x, max(int(0.33 * window), 5)) > R.mean(x, window))


@register_signal
def kama_crossover(s: DataFrame, window: int = 20, **_) -> DataFrame:
    s = K.per_key(s, lambda c: {"_kama": K.kama(c["ratio"], window)}, {"_kama": "double"}, ["ratio"])
    return _state(s, F.col("ratio") > F.col("_kama"))


@register_signal
def momentum(s: DataFrame, window: int = 20, **_) -> DataFrame:
    return _state(s, R.change(F.col("ratio"), window) > 0)


def rsi_simple_of(s: DataFrame, window: int, to: str = "_rsi") -> DataFrame:
    x = F.col("ratio")
    s = s.withColumn("_diff", x - R.lag(x))
    s = s.withColumn("_gain", F.when(F.col("_diff").isNotNull(), F.greatest(F.col("_diff"), F.lit(0.0)))).withColumn("_loss", F.when(F.col("_diff").isNotNull(), F.greatest(-F.col("_diff"), F.lit(0.0))))
    gain, loss = R.mean(F.col("_gain"), window), R.mean(F.col("_loss"), window)
    return s.withColumn(to, 100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))


@register_signal
def rsi_simple(s: DataFrame, window: int = 14, entry: float = 30.0, exit_: float = 60.0, slope_min: float = 0.0, slope_window: int = 2) -> DataFrame:
    return _level(rsi_simple_of(s, window), F.col("_rsi"), entry, exit_, slope_min, slope_window)


@register_signal
def rsi_wilder(s: DataFrame, window: int = 14, entry: float = 30.0, exit_: float = 60.0, slope_min: float = 0.0, slope_window: int = 2) -> DataFrame:
    s = K.per_key(s, lambda c: {"_rsi": K.rsi_wilder(c["ratio"], window)}, {"_rsi": "double"}, ["ratio"])
    return _level(s, F.col("_rsi"), entry, exit_, slope_min, slope_window)


def _held(s: DataFrame, entry: Column, natural: Column, most: int) -> DataFrame:
    """Acts one bar later, then exits at the latest ``most`` bars after an entry."""
    keep = [c for c in s.columns if not c.startswith("_")]
    s = _out(s, entry, natural)
    s = K.per_key(s.withColumnRenamed("exit", "_natural"), lambda c: {"exit": K.max_hold_exits(c["entry"], c["_natural"], most)}, {"exit": "boolean"}, ["entry", "_natural"])
    return s.select(*keep, "entry", "exit")


@register_signal
def rsi_connors(s: DataFrame, window: int = 4, entry: float = 25.0, exit_: float = 55.0, sma_short: int = 5, sma_long: int = 200, max_hold: int = 10, trend_filter: bool = True, **_) -> DataFrame:
    x = F.col("ratio")
    s = K.per_key(s, lambda c: {"_rsi": K.rsi_wilder(c["ratio"], window)}, {"_rsi": "double"}, ["ratio"])
    s = s.withColumn("_short", R.mean(x, sma_short)).withColumn("_long", R.mean(x, sma_long))
    up = (x > F.col("_long")) if trend_filter else F.lit(True)
    leave = F.coalesce(x > F.col("_short"), F.lit(False)) | F.coalesce(F.col("_rsi") >= exit_, F.lit(False))
    return _held(s, (F.col("_rsi") <= entry) & up, leave, max_hold)


@register_signal
def cum_rsi(s: DataFrame, window: int = 2, entry: float = 35.0, exit_: float = 65.0, slope_min: float = 0.0, slope_window: int = 2) -> DataFrame:
    x = F.col("ratio")
    s = rsi_simple_of(s, window).withColumn("_cum", R.total(F.col("_rsi"), 2)).withColumn("_short", R.mean(x, 5))
    s = s.withColumn("_s", (F.col("_cum") - R.lag(F.col("_cum"), slope_window)) / slope_window)
    steep = (F.col("_s") >= slope_min) if slope_min else F.lit(True)
    leave = F.coalesce(F.col("_rsi") >= exit_, F.lit(False)) | F.coalesce(x > F.col("_short"), F.lit(False))
    return _out(s, (F.col("_cum") <= entry) & steep, leave)


@register_signal
def vol_adaptive_zscore(s: DataFrame, window: int = 20, entry: float = -2.0, exit_: float = 0.0, slope_min: float = 0.0, slope_window: int = 2, lookback: int = 252) -> DataFrame:
    x = F.col("ratio")
    s = _sloped(s.withColumn("_r", R.change(x)), R.zscore(x, window), slope_window).withColumn("_vol", R.std(F.col("_r"), window))
    s = K.per_key(s, lambda c: {"_pct": K.percent_rank(c["_vol"], lookback, window)}, {"_pct": "double"}, ["_vol"])
    s = s.withColumn("_pct", F.coalesce("_pct", F.lit(0.5)))
    scale = 1 + 0.5 * (F.col("_pct") - 0.5)
    steep = (F.col("_s") >= slope_min) if slope_min else F.lit(True)
    return _out(s, (F.col("_z") <= entry * scale) & steep, F.col("_z") >= exit_ * scale)


def _with_adx(s: DataFrame, period: int = 14) -> DataFrame:
    return K.per_key(s, lambda c: {"_adx": K.adx_close(c["ratio"], period)}, {"_adx": "double"}, ["ratio"])


@register_signal
def adx_regime_gate(s: DataFrame, window: int = 20, entry: float = -2.0, exit_: float = 0.5, **_) -> DataFrame:
    s = _with_adx(s).withColumn("_z", R.zscore(F.col("ratio"), window))
    adx = F.coalesce("_adx", F.lit(30.0))
    scale = F.when(adx > 40, F.lit(1.5)).when(adx < 20, F.lit(0.5)).otherwise(F.lit(1.0))
    return _out(s, F.col("_z") <= entry, F.col("_z") >= exit_ * scale)


@register_signal
def donchian(s: DataFrame, entry: float = 20, exit_: float = 10, **_) -> DataFrame:
    """The thresholds are look-backs: a new high over the bars before enters, a new low exits."""
    x, n, m = F.col("ratio"), max(int(entry), 5), max(int(exit_), 3)
    up = R.full(F.max(x).over(R.before(n)), x, n, R.before(n))
    down = R.full(F.min(x).over(R.before(m)), x, m, R.before(m))
    return _out(s, x >= up, x <= down)


@register_signal
def donchian_midline(s: DataFrame, window: int = 20, entry: float = 0.2, exit_: float = 0.5, **_) -> DataFrame:
    x = F.col("ratio")
    low, width = R.lowest(x, window), R.highest(x, window) - R.lowest(x, window)
    return _out(s, x < low + entry * width, x >= low + exit_ * width)


@register_signal
def atr_pullback(s: DataFrame, window: int = 20, entry: float = 2.0, exit_: float = 0.5, **_) -> DataFrame:
    s = K.per_key(s, lambda c: {"_atr": K.atr_close(c["ratio"])}, {"_atr": "double"}, ["ratio"])
    depth = R.ratio_or_null(R.highest(F.col("ratio"), window) - F.col("ratio"), F.col("_atr"))
    s = s.withColumn("_depth", depth)
    return _out(s, F.col("_depth") >= entry, F.col("_depth") <= exit_)


@register_signal
def keltner(s: DataFrame, window: int = 20, entry: float = 2.0, exit_: float = 0.0, atr_lookback: int = 14, slope_min: float = 0.0, slope_window: int = 2) -> DataFrame:
    s = K.per_key(s, lambda c: {"_e": K.ema(c["ratio"], window, adjust=False), "_atr": K.atr_close(c["ratio"], atr_lookback)}, {"_e": "double", "_atr": "double"}, ["ratio"])
    return _level(s, R.ratio_or_null(F.col("ratio") - F.col("_e"), F.col("_atr")), -entry, exit_, slope_min, slope_window)


@register_signal
def vol_forecast_gate(s: DataFrame, window: int = 20, entry: float = -2.0, exit_: float = 0.0, calm: float = 0.30, wild: float = 0.75, lookback: int = 252, **_) -> DataFrame:
    """Enters only while the volatility forecast ranks low; leaves when it ranks high."""
    x = F.col("ratio")
    s = s.withColumn("_r", R.change(x)).withColumn("_vol", R.std(F.col("_r"), window)).withColumn("_z", R.zscore(x, window))
    s = K.per_key(s, lambda c: {"_ew": K.ema(c["_vol"], window, least=1)}, {"_ew": "double"}, ["_vol"])
    s = s.withColumn("_f", 0.7 * F.col("_ew") + 0.3 * R.mean(F.col("_vol"), lookback, need=window))
    s = K.per_key(s, lambda c: {"_pct": K.percent_rank(c["_f"], lookback, window)}, {"_pct": "double"}, ["_f"])
    s = s.withColumn("_pct", F.coalesce("_pct", F.lit(0.5)))
    return _out(s, (F.col("_z") <= entry) & (F.col("_pct") <= calm), F.coalesce(F.col("_z") >= exit_, F.lit(False)) | (F.col("_pct") >= wild))


@register_signal
def halflife_time_decay(s: DataFrame, window: int = 20, entry: float = -2.0, exit_: float = 0.5, **_) -> DataFrame:
    """The exit level decays over twice the half-life, at the end of which the trade is closed."""
    keep = s.columns
    s = s.withColumn("_z", R.zscore(F.col("ratio"), window)).withColumn("_in", F.coalesce(F.col("_z") <= entry, F.lit(False))).withColumn("_raw", F.coalesce(F.col("_z") >= exit_, F.lit(False)))

    def run(c: K.Columns) -> K.Columns:
        x = c["ratio"]
        hl = np.nan
        if len(x) >= 30:
            slope = np.polyfit(x[:-1], np.diff(x), 1)[0]
            hl = -np.log(2) / slope if slope < 0 else np.nan
        out = K.time_decay_exits(c["_z"], c["_in"], c["_raw"], exit_, int(2 * hl)) if hl >= 2 else c["_raw"]
        return {"entry": K.shifted(c["_in"]), "exit": K.shifted(out)}

    return K.per_key(s, run, {"entry": "boolean", "exit": "boolean"}, ["ratio", "_z", "_in", "_raw"]).select(*keep, "entry", "exit")


@register_signal
def cointegration_spread(s: DataFrame, window: int = 20, entry: float = -2.0, exit_: float = 0.0, alpha: float = 0.05, slope_min: float = 0.0, slope_window: int = 2) -> DataFrame:
    """The z signal of pairs whose unit root is rejected; other pairs never trade."""
    from . import screens

    p = screens.adf_auto(s).select("pair", (F.col("adf_p") <= alpha).alias("_ok"))
    out = _level(s, R.zscore(F.col("ratio"), window), entry, exit_, slope_min, slope_window)
    return out.join(p, "pair", "left").select(*s.columns, (F.col("entry") & F.coalesce("_ok", F.lit(False))).alias("entry"), (F.col("exit") & F.coalesce("_ok", F.lit(False))).alias("exit"))


@register_signal
def regime_switch(s: DataFrame, window: int = 20, entry: float = -2.0, exit_: float = 0.0, ranging: float = 20.0, trending: float = 25.0, **_) -> DataFrame:
    x = F.col("ratio")
    s = _with_adx(s).withColumn("_z", R.zscore(x, window)).withColumn("_on", F.coalesce((x > R.mean(x, window)).cast("int"), F.lit(0)))
    s = s.withColumn("_was", F.coalesce(R.lag(F.col("_on")), F.lit(0)))
    adx = F.coalesce("_adx", F.lit(22.5))
    enter = ((adx < ranging) & F.coalesce(F.col("_z") <= entry, F.lit(False))) | ((adx > trending) & (F.col("_on") > F.col("_was")))
    leave = ((adx < ranging) & F.coalesce(F.col("_z") >= exit_, F.lit(False))) | ((adx > trending) & (F.col("_on") < F.col("_was")))
    return _out(s, enter, leave)


@register_signal
def sma_distance(s: DataFrame, window: int = 50, entry: float = -0.02, exit_: float = 0.0, **_) -> DataFrame:
    s = s.withColumn("_d", R.ratio_or_null(F.col("ratio"), R.mean(F.col("ratio"), window)) - 1)
    return _out(s, F.col("_d") < entry, F.col("_d") > exit_)


@register_signal
def stochastic_k(s: DataFrame, window: int = 14, entry: float = 20.0, exit_: float = 80.0, smooth: int = 3, **_) -> DataFrame:
    x = F.col("ratio")
    low, high = R.lowest(x, window), R.highest(x, window)
    s = s.withColumn("_raw", R.ratio_or_null(100 * (x - low), high - low)).withColumn("_k", R.mean(F.col("_raw"), smooth))
    return _out(s, F.col("_k") < entry, F.col("_k") > exit_)


@register_signal
def williams_r(s: DataFrame, window: int = 14, entry: float = -80.0, exit_: float = -20.0, **_) -> DataFrame:
    x = F.col("ratio")
    low, high = R.lowest(x, window), R.highest(x, window)
    s = s.withColumn("_w", R.ratio_or_null(-100 * (high - x), high - low))
    return _out(s, F.col("_w") < entry, F.col("_w") > exit_)


def streaks(s: DataFrame, flag: Column, to: str = "_streak") -> DataFrame:
    """How many rows in a row the flag has been true: islands between resets."""
    from pyspark.sql import Window as W

    s = s.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_island", F.sum((~F.col("_flag")).cast("int")).over(R.ordered().rowsBetween(W.unboundedPreceding, 0)))
    run = F.sum(F.col("_flag").cast("int")).over(W.partitionBy("pair", "_island").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return s.withColumn(to, run)


@register_signal
def consec_down(s: DataFrame, window: int = 3, entry: float = 0.0, exit_: float = 5, sma_long: int = 200, **_) -> DataFrame:
    x = F.col("ratio")
    s = streaks(s.withColumn("_r", R.change(x)), F.col("_r") < entry).withColumn("_long", R.mean(x, sma_long))
    return _held(s, (F.col("_streak") >= window) & (x > F.col("_long")), F.col("_r") > 0, int(exit_))


@register_signal
def nday_low(s: DataFrame, window: int = 7, entry: float = 200, exit_: float = 10, **_) -> DataFrame:
    x = F.col("ratio")
    s = s.withColumn("_lo", R.lowest(x, window)).withColumn("_hi", R.highest(x, window)).withColumn("_sma", R.mean(x, int(entry)))
    return _held(s, (x <= F.col("_lo")) & (x > F.col("_sma")), x >= F.col("_hi"), int(exit_))


@register_signal
def double_bottom(s: DataFrame, window: int = 10, entry: float = 0.02, exit_: float = 20, **_) -> DataFrame:
    def run(c):
        go, leave = K.double_bottom(c["ratio"], window, entry, int(exit_))
        return {"_in": go, "_out": leave}

    s = K.per_key(s, run, {"_in": "boolean", "_out": "boolean"}, ["ratio"])
    return _out(s, F.col("_in"), F.col("_out"))


@register_signal
def adx_ema_pullback(s: DataFrame, window: int = 20, entry: float = 25.0, lookback: int = 5, swing: int = 3, **_) -> DataFrame:
    """In a trend, the price crosses back over its average after touching it; leaves after the first
    lower close that follows a row of higher ones."""
    x = F.col("ratio")
    s = K.per_key(s, lambda c: {"_adx": K.adx_close(c["ratio"]), "_e": K.ema(c["ratio"], window, adjust=False)}, {"_adx": "double", "_e": "double"}, ["ratio"])
    s = s.withColumn("_touch", F.coalesce((x <= F.col("_e")).cast("int"), F.lit(0)))
    cross = (x > F.col("_e")) & (R.lag(F.col("_touch")) == 1) & (F.max("_touch").over(R.trailing(lookback)) == 1)
    s = s.withColumn("_up", F.coalesce((x > R.lag(x)).cast("int"), F.lit(0)))
    leave = (x < R.lag(x)) & (F.sum("_up").over(R.before(swing - 1)) == swing - 1)
    return _out(s, (F.col("_adx") > entry) & cross, leave)


def hl_spread_band(bars: DataFrame, k: float = 2.0, n: int = 10, m: int = 5, r: int = 0, key: str = "ticker", seq: str = "ts") -> DataFrame:
    """Close below the highest of the last closes by k mean ranges; leaves over the last high, or under
    its mean of r bars. Acts on the same bar."""
    close = F.col("close")
    wn, wm = R.before(n, key, seq), R.before(m, key, seq)
    top = R.full(F.max(close).over(wn), close, n, wn)
    spread = F.col("high") - F.col("low")
    width = R.full(F.avg(spread).over(wm), spread, m, wm)
    leave = F.coalesce(close > R.lag(F.col("high"), 1, key, seq), F.lit(False))
    if r > 0:
        leave = leave | F.coalesce(close < R.mean(close, r, key, seq), F.lit(False))
    return bars.withColumn("entry", F.coalesce(close < top - k * width, F.lit(False))).withColumn("exit", leave)


def obv(bars: DataFrame, key: str = "ticker", seq: str = "ts") -> DataFrame:
    from pyspark.sql import Window as W

    move = F.coalesce(F.signum(F.col("close") - R.lag(F.col("close"), 1, key, seq)), F.lit(0.0))
    s = bars.withColumn("_v", move * F.col("volume"))
    return s.withColumn("obv", F.sum("_v").over(R.ordered(key, seq).rowsBetween(W.unboundedPreceding, 0))).drop("_v")
