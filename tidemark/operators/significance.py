"""Row-wise significance tests on validation rows, and the choice of the best tier."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import stats

TOP, SECOND, REJECT = "TOP_TIER", "SECOND_TIER", "REJECT"
TIERS = (TOP, SECOND, REJECT)


def safe_float(x: Column, default: float) -> Column:
    v = F.expr("try_cast(null as double)") if x is None else x.try_cast("double")
    return F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(default))


def n_obs(df: DataFrame) -> Column:
    """Bars where they are known and positive, else periods."""
    periods = F.col("n_test_periods").cast("double")
    if "n_oos_bars" not in df.columns:
        return periods
    return F.coalesce(F.when(F.col("n_oos_bars") > 0, F.col("n_oos_bars").cast("double")), periods)


def _tier(ok: Column) -> Column:
    return F.when(ok, F.lit(TOP)).otherwise(F.lit(REJECT))


def _done(df: DataFrame, ok: Column, method: str) -> DataFrame:
    ok = F.coalesce(ok, F.lit(False))
    return df.withColumn("passed", ok).withColumn("tier", _tier(F.col("passed"))).withColumn("sig_method", F.lit(method))


def _se() -> Column:
    return F.col("std_test_sharpe") / F.sqrt(F.col("n_test_periods").cast("double"))


def t_test(s3: DataFrame, threshold: float = 2.0) -> DataFrame:
    t = F.when((F.col("std_test_sharpe") > 0) & (F.col("n_test_periods") >= 2), F.col("mean_test_sharpe") / F.nullif(_se(), F.lit(0.0))).otherwise(F.lit(0.0))
    s = s3.filter("passed").withColumn("t_stat", t)
    return _done(s, F.col("t_stat") > threshold, "t_test")


def carver_2sigma(s3: DataFrame) -> DataFrame:
    s = s3.filter("passed").withColumn("lower", F.col("mean_test_sharpe") - 2 * F.when(F.col("n_test_periods") >= 1, _se()).otherwise(F.lit(0.0)))
    return _done(s, F.col("lower") > 0, "carver_2sigma")


def _moments(df: DataFrame) -> tuple[Column, Column]:
    skew = F.col("skew") if "skew" in df.columns else F.lit(0.0)
    kurt = F.col("kurtosis") if "kurtosis" in df.columns else F.lit(3.0)
    return F.coalesce(skew, F.lit(0.0)), F.coalesce(kurt, F.lit(3.0))


def psr(s3: DataFrame, benchmark: float = 0.0, threshold: float = 0.95, annual: bool = True) -> DataFrame:
    """``annual``: the Sharpe ratio is used as it is; else it is first brought to one period."""
    s = s3.filter("passed")
    skew, kurt = _moments(s)
    sr = F.col("mean_test_sharpe") if annual else F.col("mean_test_sharpe") / math.sqrt(252)
    s = s.withColumn("psr", stats.probabilistic_sharpe(sr, F.lit(benchmark), n_obs(s), skew, kurt))
    return _done(s, F.col("psr") > threshold, "psr")


def dsr(s3: DataFrame, n_trials: float, sr_variance: float | None = None, mean_correlation: float = 0.0, threshold: float = 0.95) -> DataFrame:
    s = s3.filter("passed")
    n = stats.effective_trials(mean_correlation, n_trials)
    unit = stats.expected_max_sharpe(n, 1.0)
    v = F.lit(sr_variance) if sr_variance is not None else F.when(F.col("std_test_sharpe") > 0, F.col("std_test_sharpe") * F.col("std_test_sharpe")).otherwise(F.lit(0.25))
    skew, kurt = _moments(s)
    s = s.withColumn("sr_star", F.sqrt(v) * unit)
    s = s.withColumn("dsr", stats.probabilistic_sharpe(F.col("mean_test_sharpe"), F.col("sr_star"), n_obs(s), skew, kurt))
    return _done(s, F.col("dsr") > threshold, "dsr")


def min_trl(s3: DataFrame, confidence: float = 0.975) -> DataFrame:
    """Years of track record needed; informational, passes always."""
    s = s3.filter("passed")
    skew, kurt = _moments(s)
    sr = F.col("mean_test_sharpe")
    z = stats.normal_quantile(confidence)
    years = F.when(sr > 0, (1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * F.pow(z / F.when(sr > 0, sr), 2.0)) / 252).otherwise(F.lit(float("inf")))
    return _done(s.withColumn("min_trl_years", years), F.lit(True), "min_trl")


def permutation(s3: DataFrame, level: float = 0.95) -> DataFrame:
    """Against the analytic quantile of N(0, max(deviation, 0.1))."""
    s = s3.filter("passed").withColumn("null_quantile", stats.normal_quantile(level) * F.greatest("std_test_sharpe", F.lit(0.1)))
    return _done(s, F.col("mean_test_sharpe") > F.col("null_quantile"), "permutation")


def drawdown(s3: DataFrame) -> DataFrame:
    s = s3.filter("passed")
    s = s.withColumn("expected_dd", -1 / F.greatest("mean_test_sharpe", F.lit(0.01)) * F.sqrt(2 * n_obs(s) / 252))
    return _done(s, F.lit(True), "drawdown")


def wfe(s3: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Only walk-forward rows count; a table without any is an error at plan time if it lacks the column."""
    if "wfe" not in s3.columns:
        raise ValueError("wfe needs walk-forward rows")
    s = s3.filter("passed").filter(F.col("val_method").startswith("wfa"))
    return _done(s, F.col("wfe") > threshold, "wfe")


def best_tier(methods: dict[str, DataFrame]) -> DataFrame:
    """One row per pair: the best tier over methods; among equals the method listed first."""
    out = None
    for i, (name, df) in enumerate(methods.items()):
        part = df.select("pair", "tier", "passed", F.lit(name).alias("sig_method"), F.lit(i).alias("_i"))
        out = part if out is None else out.unionByName(part)
    rank = F.when(F.col("tier") == TOP, 0).when(F.col("tier") == SECOND, 1).otherwise(2)
    w = W.partitionBy("pair").orderBy(rank, "_i")
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_i")


def dsr_inputs(positions: DataFrame, cost: float = 0.001, is_ratio: float = 0.8) -> DataFrame:
    """From (unit, combo, seq, position, r): mean pairwise correlation of the combos' net returns, and
    variance and maximum of their in-sample Sharpe ratios.

    The mean correlation comes from sums over combos per bar (the variance of the sum of standardised
    returns), so no pairs of combos are formed.
    """
    w = W.partitionBy("unit", "combo").orderBy("seq")
    p = F.coalesce(F.lag("position").over(w), F.lit(0))
    net = p * F.col("r") - cost * F.abs(F.col("position") - p)
    rows = positions.withColumn("net", net).withColumn("n", F.count("*").over(W.partitionBy("unit", "combo")))
    whole = W.partitionBy("unit", "combo")
    rows = rows.withColumn("sd", F.stddev_pop("net").over(whole)).withColumn("mu", F.avg("net").over(whole)).filter("sd > 1e-10")
    per_bar = rows.groupBy("unit", "seq").agg(F.sum((F.col("net") - F.col("mu")) / F.col("sd")).alias("z"), F.count("*").alias("k"))
    corr = per_bar.groupBy("unit").agg(F.max("k").alias("n_combos"), F.avg(F.col("z") * F.col("z")).alias("v"))
    corr = corr.withColumn("mean_correlation", F.when(F.col("n_combos") > 1, (F.col("v") - F.col("n_combos")) / (F.col("n_combos") * (F.col("n_combos") - 1))))
    ins = rows.filter(F.col("seq") <= F.floor(F.col("n") * is_ratio)).groupBy("unit", "combo").agg((F.avg("net") / F.nullif(F.stddev_pop("net"), F.lit(0.0)) * math.sqrt(252)).alias("sr"))
    best = ins.groupBy("unit").agg(F.var_samp("sr").alias("sr_variance"), F.max("sr").alias("max_sharpe"))
    return corr.join(best, "unit").select("unit", "n_combos", "mean_correlation", "sr_variance", "max_sharpe")
