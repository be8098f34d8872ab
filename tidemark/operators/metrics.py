"""Performance metrics and benchmark analytics over long tables.

``curve(key, ts, equity)`` or ``returns(key, ts, r)``; everything groups by ``key``, so many curves
are measured in one job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.intervals import day_number, range_join

from ..functions import stats

YEAR = 252
ROOT = math.sqrt(YEAR)


def _null0(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def simple_returns(curve: DataFrame, key: str = "key", ts: str = "ts", value: str = "equity") -> DataFrame:
    w = W.partitionBy(key).orderBy(ts)
    return curve.withColumn("r", F.col(value) / _null0(F.lag(value).over(w)) - 1).filter("r is not null")


def rebase(curve: DataFrame, start: str, base: float = 100.0, key: str = "key", ts: str = "ts") -> DataFrame:
    cut = curve.filter(F.col(ts) >= F.lit(start).cast("date"))
    first = F.first("equity").over(W.partitionBy(key).orderBy(ts).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return cut.withColumn("equity", F.when(first == 0, F.col("equity")).otherwise(F.col("equity") * base / _null0(first)))


def cumulative(returns: DataFrame, key: str = "key", ts: str = "ts", r: str = "r") -> DataFrame:
    w = W.partitionBy(key).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    out = returns.withColumn("cum", F.exp(F.sum(F.ln(1 + F.col(r))).over(w)))
    return out.withColumn("peak", F.max("cum").over(w)).withColumn("dd", F.col("cum") / F.col("peak") - 1).withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy(ts)))


def core(returns: DataFrame, key: str = "key", rf: float = 0.0) -> DataFrame:
    """sharpe, cagr, max_dd, calmar, sortino, volatility by key."""
    c = cumulative(returns, key)
    r = F.col("r")
    sd = F.stddev_samp(r)
    g = c.groupBy(key).agg(
        F.count("*").alias("n"), F.coalesce(F.when(sd > 0, (F.avg(r) - rf / YEAR) / _null0(sd) * ROOT), F.lit(0.0)).alias("sharpe"),
        (F.pow(F.exp(F.sum(F.ln(1 + r))), YEAR / F.count("*")) - 1).alias("cagr"), F.min("dd").alias("max_dd"), (sd * ROOT).alias("volatility"), (F.stddev_samp(F.when(r < 0, r)) * ROOT).alias("_down"),
    )
    return g.withColumn("calmar", F.coalesce(F.col("cagr") / _null0(F.abs("max_dd")), F.lit(0.0))).withColumn("sortino", F.coalesce(F.col("cagr") / _null0(F.col("_down")), F.lit(0.0))).drop("_down")


def equity_metrics(returns: DataFrame, key: str = "key", least: int = 10) -> DataFrame:
    """Adds Ulcer and Martin, sample skewness and excess kurtosis, the longest drawdown run, share of
    days invested; fewer rows than ``least`` give nulls."""
    c = cumulative(returns, key)
    w = W.partitionBy(key).orderBy("ts")
    c = c.withColumn("_under", (F.col("dd") < 0).cast("int")).withColumn("_isle", F.sum(1 - F.col("_under")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = c.groupBy(key, "_isle").agg(F.sum("_under").alias("run")).groupBy(key).agg(F.max("run").alias("max_dd_run"))
    n = F.count("*").cast("double")
    skew = F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("r") + 6)
    g = c.groupBy(key).agg(
        F.count("*").alias("_n"), F.sqrt(F.avg(F.pow(100 * F.col("dd"), F.lit(2.0)))).alias("ulcer"), F.when(n > 3, skew).alias("skew"), F.when(n > 3, kurt).alias("kurtosis"),
        F.avg((F.col("r") != 0).cast("int")).alias("pct_invested"), F.avg((F.col("r") > 0).cast("int")).alias("win_rate"), F.max("r").alias("best_day"), F.min("r").alias("worst_day"),
    )
    out = core(returns, key).join(g, key).join(runs, key).withColumn("martin", F.coalesce(100 * F.col("cagr") / _null0(F.col("ulcer")), F.lit(0.0)))
    names = [x for x in out.columns if x not in (key, "_n", "n")]
    return out.select(key, "n", *[F.when(F.col("_n") >= least, F.col(x)).alias(x) for x in names])


def bars_per_year(curve: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    years = F.datediff(F.max(ts), F.min(ts)) / 365.25
    return curve.groupBy(key).agg(F.when(years >= 0.1, F.count("*") / F.when(years > 0, years)).otherwise(F.lit(252.0)).alias("bars_per_year"))


def joined(returns: DataFrame, bench: DataFrame, key: str = "key") -> DataFrame:
    return returns.join(bench.select("ts", F.col("r").alias("b")), "ts").withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy("ts")))


def vs_benchmark(returns: DataFrame, bench: DataFrame, key: str = "key") -> DataFrame:
    """beta, alpha, information ratio, tracking error, capture, excess CAGR, correlation, Treynor, R2."""
    j = joined(returns, bench, key)
    r, b = F.col("r"), F.col("b")
    up, down = F.avg(F.when(b > 0, b)), F.avg(F.when(b < 0, b))
    growth = lambda x: F.pow(F.exp(F.sum(F.ln(1 + x))), YEAR / F.count("*")) - 1
    g = j.groupBy(key).agg(
        F.count("*").alias("n"), F.regr_slope(r, b).alias("beta"), (F.avg(r) * YEAR).alias("_mr"), (F.avg(b) * YEAR).alias("_mb"), (F.stddev_samp(r - b) * ROOT).alias("tracking_error"),
        (F.avg(F.when(b > 0, r)) / _null0(up)).alias("up_capture"), (F.avg(F.when(b < 0, r)) / _null0(down)).alias("down_capture"), (growth(r) - growth(b)).alias("excess_cagr"), F.corr(r, b).alias("correlation"), growth(r).alias("_cagr"),
    )
    out = g.withColumn("alpha", F.col("_mr") - F.col("beta") * F.col("_mb")).withColumn("information_ratio", F.coalesce((F.col("_mr") - F.col("_mb")) / _null0(F.col("tracking_error")), F.lit(0.0)))
    return out.withColumn("treynor", F.col("_cagr") / _null0(F.col("beta"))).withColumn("r2", F.col("correlation") * F.col("correlation")).drop("_mr", "_mb", "_cagr")


def fundamental_law(ic: Column, breadth: Column, tc: float = 1.0) -> Column:
    return ic * F.sqrt(breadth) * tc


def extended(returns: DataFrame, key: str = "key", bars: float = YEAR) -> DataFrame:
    """Distribution and trade-like statistics from published formulas.

    ``var`` is the quantile of the returns; ``parametric_var`` that of the normal with their mean and
    deviation, and each ``cvar`` the mean of the returns beyond its own. The "smart" ratios are divided by
    the penalty for autocorrelation, sqrt(1 + 2 sum over k of (n - k) / n x |rho| ^ k).
    """
    r = F.col("r")
    q = lambda p: F.percentile(r, p)
    z95, z99 = stats.normal_quantile(0.95), stats.normal_quantile(0.99)
    mu, sd = F.avg(r), F.stddev_samp(r)
    quant = returns.groupBy(key).agg(
        q(0.05).alias("var_95"), q(0.01).alias("var_99"), q(0.95).alias("q95"), q(0.99).alias("q99"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"),
        (mu - z95 * sd).alias("parametric_var_95"), (mu - z99 * sd).alias("parametric_var_99"),
    )
    c = cumulative(returns, key)
    lagged = c.withColumn("before", F.lag("r").over(W.partitionBy(key).orderBy("ts")))
    j = lagged.join(quant, key)
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    cut = lambda level: F.avg(F.when(r < F.col(level), r))
    n = F.count("*").cast("double")
    g = j.groupBy(key).agg(
        F.count("*").alias("n"), mu.alias("_mu"), sd.alias("_sd"), F.sum(r).alias("_sum"), F.min("dd").alias("_mdd"), F.sqrt(F.sum(F.col("dd") * F.col("dd")) / (n - 1)).alias("_ulcer"),
        F.avg("dd").alias("_dmu"), F.stddev_samp("dd").alias("_dsd"), F.sqrt(F.sum(F.when(r < 0, r * r)) / n).alias("_down"), F.skewness("r").alias("_g1"), F.kurtosis("r").alias("_g2"),
        F.exp(F.sum(F.ln(1 + r))).alias("_growth"), F.corr("r", "before").alias("autocorr_lag1"), F.count(F.when(r != 0, 1)).alias("_moved"), F.count(F.when(r >= 0, 1)).alias("_flat_up"), F.count(loss).alias("_downs"),
        F.avg(F.when(r >= 0, r)).alias("_up_mean"), F.sum(F.when(r >= 0, r)).alias("_up_sum"), F.avg(F.when(r != 0, r)).alias("avg_return"), F.max(r).alias("best_day"), F.min(r).alias("worst_day"),
        F.first("var_95").alias("var_95"), F.first("var_99").alias("var_99"), F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95"), F.avg(F.when(r <= F.col("var_99"), r)).alias("cvar_99"),
        F.first("parametric_var_95").alias("parametric_var_95"), F.first("parametric_var_99").alias("parametric_var_99"), cut("parametric_var_95").alias("parametric_cvar_95"), cut("parametric_var_99").alias("parametric_cvar_99"),
        F.abs(F.first("q95") / _null0(F.first("var_95"))).alias("tail_ratio"), F.first("q99").alias("_q99"), (F.sum(F.greatest(r, F.lit(0.0))) / _null0(F.sum(F.greatest(-r, F.lit(0.0))))).alias("omega"),
        F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.avg((r > 0).cast("int")).alias("win_rate"), F.count(win).alias("_wins"), F.sum(loss).alias("_loss_sum"),
        F.first("median").alias("median"), (F.first("q75") - F.first("q25")).alias("iqr"),
    )
    c1 = lambda name: F.col(name)
    # Worst drawdowns: the mean of those beyond their normal quantile.
    beyond = j.select(key, "dd").join(g.select(key, (c1("_dmu") - z95 * c1("_dsd")).alias("_cut")), key).groupBy(key).agg(F.avg(F.when(F.col("dd") < F.col("_cut"), F.col("dd"))).alias("_pit"))
    g = g.join(beyond, key)
    total = c1("_growth") - 1
    rho = F.abs(F.coalesce("autocorr_lag1", F.lit(0.0)))
    # Sum over k of (n - k) / n rho ^ k for k = 1 .. n - 1, in closed form.
    m = c1("n").cast("double")
    power = F.pow(rho, m)
    series = F.when(rho < 1, (rho - power) / (1 - rho) - (rho * (1 - m * F.pow(rho, m - 1) + (m - 1) * power) / ((1 - rho) * (1 - rho))) / m).otherwise((m - 1) / 2)
    penalty = F.sqrt(1 + 2 * series)
    sharpe = c1("_mu") / _null0(c1("_sd"))
    sortino = c1("_mu") / _null0(c1("_down"))
    skew = c1("_g1") * F.sqrt(m * (m - 1)) / (m - 2)
    excess = (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * c1("_g2") + 6)
    chance = lambda x: stats.normal_cdf(x / _null0(F.sqrt((1 + 0.5 * x * x - skew * x + (excess - 3) / 4 * x * x) / (m - 1))))
    moved = c1("_wins") / F.nullif(c1("_moved").cast("double"), F.lit(0.0))
    payoff = F.abs(c1("avg_win") / _null0(c1("avg_loss")))
    factor = c1("_up_sum") / _null0(F.abs("_loss_sum"))
    exposure = F.ceil(c1("_moved") / m * 100) / 100
    cagr = F.pow(c1("_growth"), bars / m) - 1
    pit = -c1("_pit") / _null0(c1("_sd"))
    out = {
        "total_return": total, "geometric_mean": F.pow(c1("_growth"), 1 / m) - 1, "rar": cagr / _null0(exposure), "smart_sharpe": sharpe / penalty * math.sqrt(bars), "smart_sortino": sortino / penalty * math.sqrt(bars),
        "adjusted_sortino": sortino / math.sqrt(2) * math.sqrt(bars), "gain_to_pain": c1("_sum") / _null0(F.abs("_loss_sum")), "risk_return_ratio": sharpe, "payoff_ratio": payoff, "win_loss_ratio": payoff,
        "serenity_index": c1("_sum") / _null0(c1("_ulcer") * pit), "upi": total / _null0(c1("_ulcer")), "probabilistic_sharpe": chance(sharpe), "probabilistic_sortino": chance(sortino), "probabilistic_adj_sortino": chance(sortino / math.sqrt(2)),
        "outlier_win_ratio": c1("_q99") / _null0(c1("_up_mean")), "outlier_loss_ratio": c1("var_99") / _null0(c1("avg_loss")), "win_share": moved,
        "profit_ratio": F.abs(c1("_up_mean") / c1("_flat_up")) / _null0(F.abs(c1("avg_loss") / _null0(c1("_downs").cast("double")))), "profit_factor": factor, "cpc_index": factor * moved * payoff, "common_sense_ratio": factor * c1("tail_ratio"),
        "kelly_criterion": (payoff * moved - (1 - moved)) / _null0(payoff), "risk_of_ruin": F.pow((1 - moved) / (1 + moved), m), "recovery_factor": F.abs("_sum") / _null0(F.abs("_mdd")),
    }
    g = g.withColumns(out).withColumn("payoff", F.col("payoff_ratio")).withColumn("kelly", F.col("win_rate") - (1 - F.col("win_rate")) / _null0(F.col("payoff")))
    g = g.drop(*[x for x in g.columns if x.startswith("_")], "n")
    return g.join(stability(returns, key).withColumnRenamed("stability_r2", "stability_of_timeseries"), key).join(streak_lengths(returns, key).withColumnsRenamed({"longest_gain": "consecutive_wins", "longest_loss": "consecutive_losses"}), key)


def streak_lengths(returns: DataFrame, key: str = "key") -> DataFrame:
    """Longest rows of gains and of losses."""
    w = W.partitionBy(key).orderBy("ts")
    s = returns.withColumn("_s", F.signum("r")).withColumn("_n", (F.col("_s") != F.coalesce(F.lag("_s").over(w), F.lit(9.0))).cast("int"))
    s = s.withColumn("_isle", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(key, "_isle").agg(F.first("_s").alias("s"), F.count("*").alias("run"))
    return s.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("s") > 0, F.col("run"))), F.lit(0)).alias("longest_gain"), F.coalesce(F.max(F.when(F.col("s") < 0, F.col("run"))), F.lit(0)).alias("longest_loss"))


def stability(returns: DataFrame, key: str = "key") -> DataFrame:
    c = cumulative(returns, key)
    return c.groupBy(key).agg(F.regr_r2(F.ln("cum"), F.col("seq")).alias("stability_r2"))


def _period_last(curve: DataFrame, unit: str, key: str) -> DataFrame:
    return curve.groupBy(key, F.trunc("ts", unit).alias("period")).agg(F.max_by("equity", "ts").alias("last"), F.min_by("equity", "ts").alias("first"))


def period_returns(curve: DataFrame, unit: str = "month", key: str = "key") -> DataFrame:
    """Change from one period's last value to the next's; the first period has none."""
    w = W.partitionBy(key).orderBy("period")
    return _period_last(curve, unit, key).withColumn("r", F.col("last") / _null0(F.lag("last").over(w)) - 1).filter("r is not null").select(key, "period", "r")


def monthly_table(curve: DataFrame, key: str = "key") -> DataFrame:
    """A row for each year: twelve months and the year so far."""
    m = period_returns(curve, "month", key).withColumn("year", F.year("period")).withColumn("month", F.month("period"))
    table = m.groupBy(key, "year").pivot("month", list(range(1, 13))).agg(F.first("r"))
    ytd = m.groupBy(key, "year").agg((F.exp(F.sum(F.ln(1 + F.col("r")))) - 1).alias("ytd"))
    named = table.select(key, "year", *[F.col(str(i)).alias(f"m{i:02d}") for i in range(1, 13)])
    return named.join(ytd, [key, "year"])


def annual_returns(curve: DataFrame, key: str = "key") -> DataFrame:
    """From the last value of the year before; the first year from its first value."""
    w = W.partitionBy(key).orderBy("period")
    y = _period_last(curve, "year", key)
    return y.select(key, F.year("period").alias("year"), (F.col("last") / _null0(F.coalesce(F.lag("last").over(w), F.col("first"))) - 1).alias("r"))


def rolling(returns: DataFrame, window: int = 252, key: str = "key") -> DataFrame:
    """Rolling Sharpe, Sortino and volatility; null until the window is full."""
    w = W.partitionBy(key).orderBy("ts").rowsBetween(-(window - 1), 0)
    r = F.col("r")
    ready = F.count("r").over(w) == window
    sd, down = F.stddev_samp(r).over(w), F.stddev_samp(F.when(r < 0, r)).over(w)
    m = F.avg(r).over(w)
    return returns.select(key, "ts", F.when(ready, m / _null0(sd) * ROOT).alias("rolling_sharpe"), F.when(ready, m / _null0(down) * ROOT).alias("rolling_sortino"), F.when(ready, sd * ROOT).alias("rolling_vol"))


def rolling_beta(returns: DataFrame, bench: DataFrame, window: int = 252, key: str = "key") -> DataFrame:
    w = W.partitionBy(key).orderBy("ts").rowsBetween(-(window - 1), 0)
    j = joined(returns, bench, key)
    beta = F.covar_samp("r", "b").over(w) / _null0(F.var_samp("b").over(w))
    return j.select(key, "ts", F.when(F.count("r").over(w) == window, beta).alias("rolling_beta"), F.when(F.count("r").over(w) == window, F.corr("r", "b").over(w)).alias("rolling_corr"))


NAMES, DATES = 64, 4096


def correlation(returns: DataFrame, key: str = "key", names: int = NAMES, dates: int = DATES) -> DataFrame:
    """(a, b, corr, cov, n) of all pairs of keys a < b on their common dates.

    Keys are numbered and cut into blocks of ``names``, dates into stretches of ``dates``; a task holds two blocks of
    one stretch as matrices, and products of matrices give the sums of all their pairs at once. What is shuffled is a
    matrix for each pair of blocks, and a row of sums for each pair of keys and stretch, never dates x keys squared.
    """
    import numpy as np
    import pandas as pd

    kind = returns.schema["ts"].dataType.typeName()
    at = F.unix_date("ts") if kind == "date" else F.unix_micros("ts") if kind == "timestamp" else F.col("ts")
    long = dates if kind != "timestamp" else dates * 86_400_000_000
    given = returns.filter("r is not null").select(F.col(key).cast("string").alias("key"), at.cast("long").alias("day"), "r")
    about = given.groupBy("key").agg(F.avg("r").alias("mu"))
    numbered = about.withColumn("i", F.row_number().over(W.orderBy("key")) - 1).withColumn("block", F.expr(f"i div {names}"))
    last = numbered.agg(F.max("block")).first()[0]
    if last is None:
        return returns.sparkSession.createDataFrame([], "a string, b string, corr double, cov double, n long")
    # Sums of differences from each key's mean stay small.
    rows = given.join(numbered, "key").select("key", "block", F.expr(f"day div {long}").alias("stretch"), "day", (F.col("r") - F.col("mu")).alias("r"))
    partner = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(int(last)))))
    dealt = partner.withColumn("lo", F.least("block", "o")).withColumn("hi", F.greatest("block", "o")).drop("o")
    schema = "a string, b string, n long, x double, y double, xx double, yy double, xy double"

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        days, d = np.unique(rows["day"].to_numpy(), return_inverse=True)
        sides = []
        for block in (rows["lo"].iloc[0], rows["hi"].iloc[0]):
            mine = (rows["block"] == block).to_numpy()
            keys, k = np.unique(rows["key"].to_numpy(str)[mine], return_inverse=True)
            value, there = np.zeros((len(days), len(keys))), np.zeros((len(days), len(keys)))
            value[d[mine], k], there[d[mine], k] = rows["r"].to_numpy()[mine], 1.0
            sides.append((keys, value, there))
        (ka, va, ta), (kb, vb, tb) = sides
        n = ta.T @ tb
        parts = {"n": n, "x": va.T @ tb, "y": ta.T @ vb, "xx": (va * va).T @ tb, "yy": ta.T @ (vb * vb), "xy": va.T @ vb}
        i, j = np.nonzero((ka[:, None] < kb[None, :]) & (n > 0))
        return pd.DataFrame({"a": ka[i], "b": kb[j], **{c: v[i, j].astype(np.int64) if c == "n" else v[i, j] for c, v in parts.items()}})

    g = dealt.groupBy("lo", "hi", "stretch").applyInPandas(sums, schema).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.col("n")
    cov, vx, vy = (F.col(c) - F.col(p) * F.col(q) / n for c, p, q in (("xy", "x", "y"), ("xx", "x", "x"), ("yy", "y", "y")))
    return g.select("a", "b", (cov / F.nullif(F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))), F.lit(0.0))).alias("corr"), F.when(n > 1, cov / (n - 1)).alias("cov"), "n")


def tail_correlation(returns: DataFrame, low: float = 0.05, key: str = "key", least: int = 10) -> DataFrame:
    """Correlation over the days on which some series is in a tail."""
    q = returns.groupBy(key).agg(F.percentile("r", low).alias("lo"), F.percentile("r", 1 - low).alias("hi"))
    days = returns.join(q, key).filter((F.col("r") < F.col("lo")) | (F.col("r") > F.col("hi"))).select("ts").distinct()
    return correlation(returns.join(days, "ts", "left_semi"), key).filter(F.col("n") >= least)


def diversification(weights: DataFrame, returns: DataFrame, key: str = "key") -> DataFrame:
    """(w sigma) / sqrt(w' S w) and 1 / sqrt(w' C w) from the returns of the weighted sum, so no
    covariance matrix is formed."""
    sd = returns.groupBy(key).agg(F.stddev_samp("r").alias("sd")).join(weights, key)
    rows = returns.join(sd, key)
    day = rows.groupBy("ts").agg(F.sum(F.col("w") * F.col("r")).alias("p"), F.sum(F.col("w") * F.col("r") / _null0(F.col("sd"))).alias("z"), F.count("*").alias("k"))
    top = sd.agg(F.sum(F.col("w") * F.col("sd")).alias("ws"), F.count("*").alias("n"))
    g = day.join(top, day["k"] == top["n"]).groupBy("ws").agg(F.stddev_samp("p").alias("sp"), F.stddev_samp("z").alias("sz"))
    return g.select((F.col("ws") / _null0(F.col("sp"))).alias("diversification_ratio"), (1 / _null0(F.col("sz"))).alias("diversification_multiplier"))


def sma_regime(prices: DataFrame, fast: int = 50, slow: int = 200, key: str = "ticker") -> DataFrame:
    def sma(n: int) -> Column:
        w = W.partitionBy(key).orderBy("ts").rowsBetween(-(n - 1), 0)
        return F.when(F.count("close").over(w) == n, F.avg("close").over(w))

    return prices.filter("close is not null").select(key, "ts", F.coalesce((sma(fast) > sma(slow)).cast("int"), F.lit(0)).alias("regime"))


def regime_metrics(returns: DataFrame, labels: DataFrame, least: int = 20, key: str = "key") -> DataFrame:
    rows = returns.join(labels.select("ts", "regime"), "ts").withColumn("_k", F.concat_ws("|", key, F.col("regime").cast("string")))
    out = core(rows.select(F.col("_k").alias("key"), "ts", "r"), "key").filter(F.col("n") >= least)
    return out.select(F.substring_index("key", "|", 1).alias(key), F.substring_index("key", "|", -1).alias("regime"), "n", "sharpe", "cagr", "max_dd")


# The published stress windows.
STRESS = (
    ("US_Housing_2003", "2003-01-08", "2003-02-08"),
    ("Aug07_QuantQuake", "2007-08-01", "2007-09-01"),
    ("Mar08_BearStearns", "2008-03-01", "2008-04-01"),
    ("Sep08_Lehman", "2008-09-01", "2008-10-01"),
    ("Lehman", "2008-08-01", "2008-10-01"),
    ("2009Q1", "2009-01-01", "2009-03-01"),
    ("2009Q2", "2009-03-01", "2009-06-01"),
    ("Flash_Crash_May2010", "2010-05-05", "2010-05-10"),
    ("Fukushima_Mar2011", "2011-03-16", "2011-04-16"),
    ("US_Downgrade_Aug2011", "2011-08-05", "2011-09-05"),
    ("EZB_Rate_Sep2012", "2012-09-10", "2012-10-10"),
    ("Apr14", "2014-04-01", "2014-05-01"),
    ("Oct14_Bund_Tantrum", "2014-10-01", "2014-11-01"),
    ("Fall2015_Aug_Tantrum", "2015-08-15", "2015-09-30"),
    ("Dotcom_2000", "2000-03-10", "2000-09-10"),
    ("9_11", "2001-09-11", "2001-10-11"),
    ("Low_Vol_Bull_05_07", "2005-01-01", "2007-08-01"),
    ("GFC_Crash", "2007-08-01", "2009-04-01"),
    ("Recovery_09_13", "2009-04-01", "2013-01-01"),
    ("New_Normal", "2013-01-01", "2020-01-01"),
    ("COVID_Crash_2020", "2020-02-19", "2020-03-23"),
    ("COVID_Recovery_2020", "2020-03-24", "2020-12-31"),
    ("Rate_Shock_2022", "2022-01-03", "2022-10-13"),
    ("SVB_Mar2023", "2023-03-08", "2023-03-15"),
    ("Yen_Unwind_Aug2024", "2024-07-31", "2024-08-09"),
    ("Trump_Trade_Q4_2024", "2024-11-05", "2024-12-31"),
)


def stress_table(spark) -> DataFrame:
    """(name, start, end) of the published windows."""
    rows = spark.createDataFrame(list(STRESS), "name string, start string, end string")
    return rows.select("name", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))


def _within(rows: DataFrame, windows: DataFrame, width: int = 64) -> DataFrame:
    return range_join(rows, windows, day_number(F.col("ts")), day_number(F.col("start")), day_number(F.col("end")), width)


def stress_windows(returns: DataFrame, windows: DataFrame, bench: DataFrame | None = None, least: int = 5, key: str = "key") -> DataFrame:
    """Named date ranges (name, start, end): total return, Sharpe, drawdown. Dates and ranges meet in bins."""
    rows = _within(returns, windows).withColumn("_k", F.concat_ws("|", key, "name"))
    c = core(rows.select(F.col("_k").alias("key"), "ts", "r"), "key").filter(F.col("n") >= least)
    total = rows.groupBy(F.col("_k").alias("key")).agg((F.exp(F.sum(F.ln(1 + F.col("r")))) - 1).alias("total_return"))
    out = c.join(total, "key").select(F.substring_index("key", "|", 1).alias(key), F.substring_index("key", "|", -1).alias("name"), "n", "total_return", "sharpe", "max_dd")
    if bench is None:
        return out
    b = _within(bench, windows).groupBy("name").agg((F.exp(F.sum(F.ln(1 + F.col("r")))) - 1).alias("_b"))
    return out.join(b, "name", "left").withColumn("excess", F.col("total_return") - F.col("_b")).drop("_b")


def drawdown_table(returns: DataFrame, top: int = 10, key: str = "key") -> DataFrame:
    """The deepest episodes: peak, valley and recovery dates (null while under water)."""
    c = cumulative(returns, key)
    w = W.partitionBy(key).orderBy("ts")
    c = c.withColumn("_at", (F.col("dd") >= 0).cast("int")).withColumn("_isle", F.sum("_at").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_next", F.lead("ts").over(w))
    g = c.groupBy(key, "_isle").agg(F.min(F.when(F.col("dd") >= 0, F.col("ts"))).alias("peak_date"), F.min_by("ts", F.struct("dd", "ts")).alias("valley_date"), F.min("dd").alias("depth"), F.max_by("_next", "ts").alias("recovery_date"), F.count(F.when(F.col("dd") < 0, 1)).alias("bars_under")).filter("depth < 0")
    return g.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("depth", "valley_date"))).filter(F.col("rank") <= top).drop("_isle")


def decile_returns(returns: DataFrame, bench: DataFrame, bins: int = 10, key: str = "key") -> DataFrame:
    """Mean return by decile of the benchmark's (interpolated edges, duplicates dropped)."""
    j = joined(returns, bench, key)
    edges = j.groupBy(key).agg(F.array_distinct(F.percentile("b", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("edges"))
    rows = j.join(edges, key)
    rows = rows.withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("b")))))
    return rows.groupBy(key, "bin").agg(F.avg("r").alias("mean_return"), F.avg("b").alias("mean_bench"), F.count("*").alias("n"))


def kde(returns: DataFrame, points: int = 400, key: str = "key") -> DataFrame:
    """Gaussian density on a grid from the smallest to the largest return, Scott's bandwidth."""
    g = returns.groupBy(key).agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.stddev_samp("r").alias("sd"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), -0.2)
    grid = g.withColumn("h", h).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1))
    d = grid.join(returns.select(key, "r"), key)
    k = F.exp(-F.pow((F.col("x") - F.col("r")) / F.col("h"), 2.0) / 2) / math.sqrt(2 * math.pi)
    return d.groupBy(key, "i").agg(F.first("x").alias("x"), (F.sum(k) / F.first("n") / F.first("h")).alias("density"))


def curve_hash(curve: DataFrame, key: str = "key") -> DataFrame:
    """Digest of each curve rebased to its first value, six decimals; equal curves share it."""
    first = F.first("equity").over(W.partitionBy(key).orderBy("ts").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = curve.withColumn("_v", F.format_string("%s:%.6f", F.col("ts").cast("string"), F.col("equity") / _null0(first)))
    return rows.groupBy(key).agg(F.sha1(F.array_join(F.sort_array(F.collect_list("_v")), ",").cast("binary")).alias("curve_sha1"))


def trade_summary(trades: DataFrame, by: str) -> DataFrame:
    """Number, mean, total and win share of trades by exit reason, ticker or the like."""
    return trades.groupBy(by).agg(F.count("*").alias("n"), F.avg("pnl_pct").alias("mean_pnl_pct"), F.sum("pnl_dollars").alias("total_pnl"), F.avg((F.col("pnl_pct") > 0).cast("int")).alias("win_rate"))
