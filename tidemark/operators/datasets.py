"""Data sets of trades and distributions, from any table of trades or curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def trades_of(rets: DataFrame, key: str = "pair", seq: str = "seq", at: str = "ts") -> DataFrame:
    """(key, trade, entry_ts, exit_ts, bars, pnl) from a backtest's rows (position after each bar, trade_ret on a
    trade's last bar)."""
    w = W.partitionBy(key).orderBy(seq)
    opened = (F.col("position") > 0) & (F.coalesce(F.lag("position").over(w), F.lit(0)) == 0)
    rows = rets.withColumn("_open", opened.cast("int")).withColumn("trade", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = rows.filter("trade > 0").groupBy(key, "trade").agg(
        F.min(F.when(F.col("_open") == 1, F.col(at))).alias("entry_ts"), F.max(F.when(F.col("trade_ret").isNotNull(), F.col(at))).alias("exit_ts"),
        (F.max(F.when(F.col("trade_ret").isNotNull(), F.col(seq))) - F.min(F.when(F.col("_open") == 1, F.col(seq)))).cast("long").alias("bars"), F.sum("trade_ret").alias("pnl"),
    )
    return g.filter("exit_ts is not null")


def open_positions(trades: DataFrame, days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, ts, n_open): trades open at the end of each of ``days`` (ts), by a sweep over entries and exits.

    A trade is open from its entry day to the day before its exit. Changes are summed by day before the sweep, so what
    is swept has a row a day, however many trades there are.
    """
    change = lambda day, by_one: trades.select(*by, F.col(day).alias("ts"), F.lit(by_one).alias("d"))
    changes = change("entry_ts", 1).unionAll(change("exit_ts", -1)).groupBy(*by, "ts").agg(F.sum("d").alias("d"))
    calendar = days.select("ts").distinct()
    if by:
        calendar = trades.select(*by).distinct().withColumn("_all", F.lit(1)).join(calendar.withColumn("_all", F.lit(1)), "_all").drop("_all")
    laid = changes.join(calendar.withColumn("_day", F.lit(True)), [*by, "ts"], "full")
    w = W.partitionBy(*by).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return laid.withColumn("n_open", F.coalesce(F.sum("d").over(w), F.lit(0))).filter("_day").select(*by, "ts", "n_open")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, low, high, n) on given equal bins; a value on an edge belongs to the upper one, the last bin has both
    edges. Bin 0 holds what lies below, bin ``bins`` + 1 what lies above; empty bins have no row."""
    x, width = F.col(value), (high - low) / bins
    bin_ = F.when(x < low, 0).when(x > high, bins + 1).otherwise(F.least(F.floor((x - low) / width) + 1, F.lit(bins))).cast("int")
    g = rows.filter(x.isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    edge = lambda k: F.lit(low) + k * width
    return g.select(*by, "bin", F.when(F.col("bin") > 0, edge(F.col("bin") - 1)).alias("low"), F.when(F.col("bin") <= bins, edge(F.col("bin"))).alias("high"), "n")


def box(rows: DataFrame, value: str, by: Sequence[str], reach: float = 1.5) -> DataFrame:
    """(by, n, q1, median, q3, low, high, outliers): whiskers end at the outmost values within ``reach`` boxes."""
    q = rows.groupBy(*by).agg(F.count(value).alias("n"), *[F.percentile(value, p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    span = (F.col("q3") - F.col("q1")) * reach
    x = F.col(value)
    inside = x.between(F.col("q1") - span, F.col("q3") + span)
    g = rows.filter(x.isNotNull()).join(q, list(by)).groupBy(*by, "n", "q1", "median", "q3")
    return g.agg(F.min(F.when(inside, x)).alias("low"), F.max(F.when(inside, x)).alias("high"), F.count_if(~inside).alias("outliers"))


def trade_kpis(trades: DataFrame, by: Sequence[str], pnl: str = "pnl") -> DataFrame:
    """Number, win rate, means of wins and losses, profit factor, expectancy and bars held, by reason, ticker or the like."""
    x = F.col(pnl)
    won, lost = F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x))
    return trades.groupBy(*by).agg(
        F.count(pnl).alias("n"), F.avg((x > 0).cast("int")).alias("win_rate"), F.avg(F.when(x > 0, x)).alias("mean_win"), F.avg(F.when(x < 0, x)).alias("mean_loss"),
        (won / F.nullif(lost, F.lit(0.0))).alias("profit_factor"), F.avg(x).alias("expectancy"), F.avg("bars").alias("mean_bars"), F.max(x).alias("best"), F.min(x).alias("worst"),
    )


def period_histogram(curve: DataFrame, unit: str, low: float, high: float, bins: int, key: str = "key") -> DataFrame:
    """The histogram of returns by ``unit`` (day, week, month, ...) in percent, with each key's mean and deviation."""
    w = W.partitionBy(key).orderBy("period")
    last = curve.groupBy(key, F.date_trunc(unit, "ts").cast("date").alias("period")).agg(F.max_by("equity", "ts").alias("e"))
    r = last.select(key, (100 * (F.col("e") / F.nullif(F.lag("e").over(w), F.lit(0.0)) - 1)).alias("pct")).filter("pct is not null")
    moments = r.groupBy(key).agg(F.avg("pct").alias("mean_pct"), F.stddev_samp("pct").alias("sd_pct"))
    return histogram(r, "pct", low, high, bins, (key,)).join(moments, key)


def cumulative_excess(returns: DataFrame, bench: DataFrame, key: str = "key") -> DataFrame:
    """(key, ts, cum, cum_bench, excess): compounded returns of both on common dates, and their difference."""
    w = W.partitionBy(key).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    grown = lambda c: F.exp(F.sum(F.ln(1 + F.col(c))).over(w)) - 1
    j = returns.join(bench.select("ts", F.col("r").alias("b")), "ts")
    return j.select(key, "ts", grown("r").alias("cum"), grown("b").alias("cum_bench")).withColumn("excess", F.col("cum") - F.col("cum_bench"))


def regression(returns: DataFrame, bench: DataFrame, key: str = "key", year: int = 252) -> DataFrame:
    """The line through returns over the benchmark's: slope, intercept a year, r squared, points."""
    j = returns.join(bench.select("ts", F.col("r").alias("b")), "ts")
    return j.groupBy(key).agg(F.regr_slope("r", "b").alias("beta"), (F.regr_intercept("r", "b") * year).alias("alpha"), F.regr_r2("r", "b").alias("r2"), F.count("*").alias("n"))

