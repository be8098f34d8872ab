"""All queries of the library by name, with the SQL that checks them.

A query is (spark, sf_dir) -> DataFrame over whole tables. ``@query(name, sql)`` registers it; without
SQL it is checked by tests instead. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import rolling as R
from ..operators import backtest as B, datasets as DS, metrics as M, patterns as PT, pipeline as PL, position_blocks as PB, replay as RP, resampling as RS, rules as RL, screens as S1, signals as SG, significance as S4, table_functions as TF, validation as V, weights as WT
from ..sources import bar_cache as BC, feed as FD, panel as P
from ..sources.shared import Files, shared_folder
from ..streaming import events as EV
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            _SQL[name] = sql
        return fn

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel, pairs, ratio, signals, positions, daily returns, metrics: the whole slice."""
    return rounded(B.summary(B.run(SG.zscore_standard(P.series(spark, sf_dir))), "pair"))


query("bt_zscore_summary", Q.BACKTEST)(flagship)

# Panel ------------------------------------------------------------------------------------------


@query("panel_px", Q.PX + "SELECT ticker, ts, round(close,6) AS close FROM px")
def _(spark, d):
    return P.px(spark, d)


@query("panel_ratio", Q.S + "SELECT pair, ts, seq, round(ratio,6) AS ratio, round(num_close,6) AS num_close, round(den_close,6) AS den_close FROM s")
def _(spark, d):
    return P.series(spark, d).withColumn("seq", F.col("seq").cast("long"))


@query("panel_bars", Q.BARS + "SELECT ticker, ts, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, round(volume,6) AS volume FROM bars")
def _(spark, d):
    return P.bars(spark, d)


@query("panel_coverage", Q.SPARSE + "SELECT ticker, min(ts) AS first_date, max(ts) AS last_date, count(*) AS n_bars FROM sp WHERE close IS NOT NULL GROUP BY 1")
def _(spark, d):
    prices = P.px_sparse(spark, d)
    return P.coverage(prices, prices)


@query("panel_freshness", Q.SPARSE + "SELECT ticker, CAST(DATE '2001-08-05' - max(ts) AS INTEGER) AS days_behind, (DATE '2001-08-05' - max(ts)) BETWEEN 0 AND 4 AS fresh FROM sp GROUP BY 1")
def _(spark, d):
    prices = P.px_sparse(spark, d)
    return P.freshness(prices, prices, "2001-08-05", 4)


@query("panel_sparse_ratio", Q.SPARSE + Q.PAIRS.format(src="sp") + "SELECT pair, ts, round(ratio,6) AS ratio FROM s")
def _(spark, d):
    prices = P.px_sparse(spark, d)
    return P.compute_ratio(prices, P.universe(prices)).select("pair", "ts", "ratio")


@query("panel_weekdays", Q.PX + "SELECT ticker, count(*) AS n FROM px WHERE isodow(ts) <= 5 GROUP BY 1")
def _(spark, d):
    return P.weekdays_only(P.px(spark, d)).groupBy("ticker").agg(F.count("*").alias("n"))


@query("panel_last_business_day", Q.PX + "SELECT DISTINCT ts, CASE isodow(ts) WHEN 7 THEN ts - 2 WHEN 1 THEN ts - 3 ELSE ts - 1 END AS lbd, isodow(ts) = 5 AS friday FROM px")
def _(spark, d):
    return P.px(spark, d).select("ts", P.last_business_day(F.col("ts")).alias("lbd"), P.is_friday(F.col("ts")).alias("friday")).distinct()


@query("panel_wide_long", Q.PX + "SELECT ts, ticker, round(close,6) AS close FROM px WHERE close IS NOT NULL")
def _(spark, d):
    return P.to_long(P.to_wide(P.px(spark, d), tickers=["A", "N", "R"])).filter("close is not null")


@query("panel_ratio_ohlc", Q.BARS + "SELECT a.ticker || '/' || b.ticker AS pair, a.ts, round(a.open/b.open,6) AS open, round(a.high/b.low,6) AS high, round(a.low/b.high,6) AS low, round(a.close/b.close,6) AS close FROM bars a JOIN bars b ON a.ts = b.ts AND a.ticker < b.ticker QUALIFY count(*) OVER (PARTITION BY a.ticker, b.ticker) >= 504")
def _(spark, d):
    bars = P.bars(spark, d)
    return P.ratio_ohlc(bars, P.universe(bars)).select("pair", "ts", "open", "high", "low", "close")


def _feed_folder(spark, d) -> str:
    """The tables' bars as a feed: a folder of its own in the shared one, that goes with the driver."""
    root = f"{shared_folder(spark)}/tidemark-feed/{uuid.uuid4().hex}"
    files = Files(spark, root)
    files.make()
    files.delete_on_exit()
    P.bars(spark, d).repartition("ticker").write.partitionBy("ticker").parquet(f"{root}/feed")
    return root


_FOLDER = "tidemark.sources.feed:folder"


@query("src_bars_feed", Q.BARS + "SELECT ticker, CAST(ts AS VARCHAR) AS day, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, round(volume,6) AS volume, 'feed' AS source, 3 AS requests FROM bars UNION ALL SELECT 'Z', 'none', NULL, NULL, NULL, NULL, NULL, 'missing', 4")
def _(spark, d):
    """The feed fails twice, and never has Z."""
    rows = FD.read_bars(spark, ["A", "N", "R", "Z"], _FOLDER, path=f"{_feed_folder(spark, d)}/feed", batch=2, failing=2, backoff=0)
    return rows.select("ticker", F.coalesce(F.col("ts").cast("string"), F.lit("none")).alias("day"), *FD.FIELDS, "source", "requests")


@query("src_bar_cache", Q.BARS + "SELECT ticker, ts, round(close,6) AS close FROM bars WHERE ts <= (SELECT min(t) FROM (SELECT max(ts) AS t FROM bars GROUP BY ticker))")
def _(spark, d):
    """Two tickers are cached, then three wanted: the third is fetched, and all are read from the cache."""
    root = _feed_folder(spark, d)
    cache, options = BC.BarCache(spark, f"{root}/cache"), {"path": f"{root}/feed", "backoff": 0, "failing": 1}
    reached = P.bars(spark, d).groupBy("ticker").agg(F.max("ts").alias("t")).agg(F.min("t").cast("string")).first()[0]
    for wanted in (["A", "R"], ["A", "N", "R"]):
        cache.load(wanted, _FOLDER, reached, **options)
    return cache.close().filter(F.col("ts") <= F.lit(reached).cast("date"))


# Screens ----------------------------------------------------------------------------------------


@query("s1_halflife", Q.S + Q.HALFLIFE)
def _(spark, d):
    h = S1.halflives(P.series(spark, d))
    return h.select("pair", "halflife", S1.window_of(F.col("halflife")).cast("long").alias("window"))


@query("s1_adf_tstat", Q.S + Q.ADF)
def _(spark, d):
    return S1.adf(P.series(spark, d)).select("pair", "adf_t")


@query("s1_adf_auto", Q.ADF_AUTO)
def _(spark, d):
    return S1.adf_auto(P.series(spark, d))


@query("s1_kaufman_er", Q.S + Q.ER)
def _(spark, d):
    return S1.kaufman_er(P.series(spark, d))


@query("s1_kaufman_er_trend", Q.S + Q.ER.replace("< 0.3", "> 0.3"))
def _(spark, d):
    return S1.kaufman_er(P.series(spark, d), trend=True)


@query("s1_variance_ratio", Q.S + Q.VR)
def _(spark, d):
    return S1.variance_ratio(P.series(spark, d))


@query("s1_vol_cone", Q.S + Q.VOL_CONE)
def _(spark, d):
    return S1.vol_cone(P.series(spark, d))


@query("s1_passthrough", Q.S + Q.PASSTHROUGH)
def _(spark, d):
    return S1.passthrough(P.series(spark, d)).withColumn("window", F.col("window").cast("long"))


@query("s1_chan_hurst", Q.HURST)
def _(spark, d):
    return S1.chan_hurst(P.series(spark, d))


@query("s1_chan_hurst_trend", Q.HURST_TREND)
def _(spark, d):
    return S1.chan_hurst(P.series(spark, d), trend=True)


for _name, _fn in {"s1_chan_halflife": S1.chan_halflife, "s1_kpss": S1.kpss, "s1_cadf": S1.cadf, "s1_cadf_rolling": S1.cadf_rolling, "s1_johansen": S1.johansen, "s1_chan_combined": S1.chan_combined, "s1_trend_combined": S1.trend_combined, "s1_kaufman_kama": S1.kaufman_kama, "s1_cadf_rolling_kalman": S1.cadf_rolling_kalman}.items():
    query(_name, {"s1_chan_halflife": Q.CHAN_HALFLIFE, "s1_johansen": Q.JOHANSEN, "s1_kpss": Q.KPSS, "s1_cadf": Q.CADF, "s1_cadf_rolling": Q.CADF_ROLLING, "s1_kaufman_kama": Q.KAUFMAN_KAMA, "s1_chan_combined": Q.CHAN_COMBINED, "s1_trend_combined": Q.TREND_COMBINED}.get(_name))(lambda spark, d, fn=_fn: fn(P.series(spark, d)))


@query("s1_regime_aware")
def _(spark, d):
    return S1.regime_aware(P.series(spark, d), P.benchmark_px(spark, d))


# Signals ----------------------------------------------------------------------------------------

for _name, _fn in SG.SIGNALS.items():
    query(f"sig_{_name}", Q.signal(_name))(lambda spark, d, fn=_fn: fn(P.series(spark, d)).select("pair", "ts", "entry", "exit"))


@query("sig_hl_spread_band", Q.BARS + Q.HL_BAND)
def _(spark, d):
    return SG.hl_spread_band(P.bars(spark, d)).select("ticker", "ts", "entry", "exit")


@query("sig_obv", Q.BARS + "SELECT ticker, ts, round(sum(coalesce(sign(dc),0)*volume) OVER (PARTITION BY ticker ORDER BY ts),6) AS obv FROM (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS dc FROM bars)")
def _(spark, d):
    return SG.obv(P.bars(spark, d)).select("ticker", "ts", "obv")


@query("sig_obv_pivot")
def _(spark, d):
    bars = SG.obv(P.bars(spark, d))
    pivots = PT.classify_pivots(PT.fractal_pivots(bars))
    out = None
    for m in "ABC":
        got = PT.pivot_positions(bars, pivots, m).select(F.lit(m).alias("mapping"), "ticker", "ts", "position")
        out = got if out is None else out.unionByName(got)
    return out


@query("pat_fractal_pivots", Q.BARS + Q.FRACTAL)
def _(spark, d):
    return PT.fractal_pivots(SG.obv(P.bars(spark, d))).select("ticker", "ts", "kind")


_LINES = {"least_points": 4, "error_pct": 0.5, "least_period": 21}


def _breakout_bars(spark, d):
    """Bars around the smoothed ratio: the raw bars range too widely from day to day for lines to mean anything."""
    x = F.col("ratio")
    return P.series(spark, d).select("pair", "ts", (x * 1.005).alias("high"), (x * 0.995).alias("low"), x.alias("close"), "num_close")


@query("pat_live_lines", Q.LIVE_LINES)
def _(spark, d):
    """A line through every 25th bar and the one 25 later, live for 120 bars after it: the live lines of each bar."""
    bars = P.series(spark, d).select("pair", (F.col("seq") - 1).alias("seq"), "ratio")
    w = W.partitionBy("pair").orderBy("seq")
    ends = bars.withColumn("later", F.lead("ratio", 25).over(w)).filter("seq % 25 = 0 and later is not null")
    slope = (F.col("later") - F.col("ratio")) / 25
    kind = F.when(slope < 0, F.lit("resistance")).otherwise(F.lit("support"))
    lines = ends.select("pair", kind.alias("kind"), (F.col("seq") + 25).alias("end_idx"), (F.col("seq") + 145).alias("last_idx"), slope.alias("slope"), (F.col("ratio") - slope * F.col("seq")).alias("intercept"))
    return PT.live_lines(bars, lines)


@query("pat_trendlines")
def _(spark, d):
    return PT.trendlines(_breakout_bars(spark, d), **_LINES)


@query("sig_trendline_breakout")
def _(spark, d):
    from pyspark.sql import Window as W

    rows = _breakout_bars(spark, d).withColumn("seq", F.row_number().over(W.partitionBy("pair").orderBy("ts")))
    return PT.breakout(rows, **_LINES).select("pair", "ts", "entry", "exit")


# Backtests and optimisers -----------------------------------------------------------------------


@query("bt_state_ma", Q.S + Q.STATE_MA)
def _(spark, d):
    s = P.series(spark, d)
    b = B.state_backtest(s, F.col("ratio") > R.mean(F.col("ratio"), 20))
    return b.groupBy("pair").agg(B.sharpe(F.col("ret")).alias("sharpe"), F.sum("position").alias("bars_in"), F.max("trade").cast("long").alias("n_trades"))


@query("bt_obv_walk")
def _(spark, d):
    bars = SG.obv(P.bars(spark, d))
    pos = PT.pivot_positions(bars, PT.classify_pivots(PT.fractal_pivots(bars)))
    out = None
    for label, stop, p in PT.OBV_STOPS:
        got = PT.obv_walk(pos, stop, p).groupBy("ticker").agg(B.sharpe(F.col("ret"), 0).alias("sharpe"), B.cagr(F.col("ret")).alias("cagr")).withColumn("stop", F.lit(label))
        out = got if out is None else out.unionByName(got)
    return out


@query("opt_grid_obv_pivot")
def _(spark, d):
    return PT.grid_obv_pivot(P.bars(spark, d))


@query("opt_grid_breakout")
def _(spark, d):
    return PT.grid_breakout(_breakout_bars(spark, d), **_LINES)


@query("bt_breakout_trace")
def _(spark, d):
    return PT.breakout_trace(_breakout_bars(spark, d), **_LINES)


@query("opt_grid_search")
def _(spark, d):
    return B.grid_search(P.series(spark, d), windows=(10, 20, 40), slopes=(0.0, 0.05), least_is=-10.0)


for _kind in ("sma", "ema", "dual", "kama", "momentum"):
    query(f"opt_grid_ma_{_kind}", None if _kind == "kama" else Q.grid_ma(_kind))(lambda spark, d, kind=_kind: B.grid_ma(P.series(spark, d), kind))


@query("opt_grid_regime")
def _(spark, d):
    return B.grid_regime(P.series(spark, d), least_is=-10.0)


@query("opt_optuna_tpe")
def _(spark, d):
    return B.optuna_tpe(P.series(spark, d), windows=(10, 20, 30, 40, 60), least_is=-10.0)


@query("opt_optuna_ma")
def _(spark, d):
    return B.optuna_ma(P.series(spark, d))


@query("sql_zscore_summary", Q.BACKTEST)
def _(spark, d):
    """Signals and positions by table functions, in SQL, with a built-in signal and the position kernel."""
    TF.register(spark)
    P.series(spark, d).createOrReplaceTempView("tidemark_series")
    rets = spark.sql("""
        WITH flags AS (SELECT * FROM signal(TABLE(SELECT pair, seq, ratio FROM tidemark_series) PARTITION BY pair ORDER BY seq, name => 'zscore_standard', window => 20)),
        priced AS (SELECT f.*, s.num_close FROM flags f JOIN tidemark_series s USING (pair, seq))
        SELECT * FROM positions(TABLE(priced) PARTITION BY pair ORDER BY seq, stop => 0.0D)""")
    return B.summary(rets, "pair")


@query("sql_user_signal", Q.signal("donchian"))
def _(spark, d):
    """A user's function of a stretch of bars, called in SQL: a new high enters, a new low leaves."""

    def channel(x, window, settings):
        n, m = window, int(settings["back"])
        high = np.array([x[i - n : i].max() if i >= n else np.nan for i in range(len(x))])
        low = np.array([x[i - m : i].min() if i >= m else np.nan for i in range(len(x))])
        return x >= high, x <= low

    TF.register_signal(spark, "channel", channel)
    P.series(spark, d).createOrReplaceTempView("tidemark_series")
    return spark.sql("""
        SELECT pair, ts, entry, exit FROM channel(TABLE(SELECT pair, seq, ratio FROM tidemark_series) PARTITION BY pair ORDER BY seq, window => 20, back => 10)
        JOIN tidemark_series USING (pair, seq)""")


# Validation -------------------------------------------------------------------------------------


@query("fold_expanding", Q.S + "SELECT pair, fold, 0::BIGINT AS is_lo, (fold+1)*c AS is_hi, (fold+1)*c AS oos_lo, least((fold+2)*c, n) AS oos_hi FROM (SELECT pair, n, n//9 AS c, unnest(range(0,8))::INTEGER AS fold FROM (SELECT pair, count(*) AS n FROM s GROUP BY 1)) WHERE c >= 20 AND (fold+1)*c >= 50 AND least((fold+2)*c, n) - (fold+1)*c >= 10")
def _(spark, d):
    return V.expanding_folds(V.lengths(P.series(spark, d)))


@query("fold_rolling", Q.S + "SELECT pair, fold::INTEGER AS fold, fold*180 AS is_lo, fold*180+504 AS is_hi, fold*180+504 AS oos_lo, fold*180+684 AS oos_hi FROM (SELECT pair, unnest(range(0, least((n-684)//180+1, 30))) AS fold FROM (SELECT pair, count(*) AS n FROM s GROUP BY 1) WHERE n >= 684)")
def _(spark, d):
    return V.rolling_folds(V.lengths(P.series(spark, d)))


@query("fold_cpcv", Q.S + Q.CPCV)
def _(spark, d):
    return V.cpcv_folds(V.lengths(P.series(spark, d))).select("pair", F.element_at("test_folds", 1).alias("f1"), F.element_at("test_folds", 2).alias("f2"), "n_train", "n_test")


@query("fold_by_date", Q.S + "SELECT pair, ts <= DATE '1999-06-30' AS in_sample, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY 1,2")
def _(spark, d):
    return V.split(P.series(spark, d), cutoff="1999-06-30").groupBy("pair", "in_sample").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("s3_resolved", Q.RESOLVED)
def _(spark, d):
    """Two validators of each pair to one row, by agreement."""
    s = P.series(spark, d)
    columns = ["pair", "mean_test_sharpe", "degradation", "passed", "val_method"]
    rows = rounded(V.wfa_expanding(s).select(*columns).unionByName(V.chan_is_oos(s).select(*columns)))
    return PL.resolve_validators(rows, "agreement")


@query("fold_factorisation", "SELECT r::BIGINT AS path, CASE WHEN j=0 THEN least(9, r%9) ELSE least((r+j)%9, (r-j+9)%9) END::BIGINT AS a, CASE WHEN j=0 THEN 9 ELSE greatest((r+j)%9, (r-j+9)%9) END::BIGINT AS b FROM range(9) t(r), range(5) u(j)")
def _(spark, d):
    return spark.createDataFrame([(p, *e) for p, edges in enumerate(V.factorisation()) for e in edges], "path long, a long, b long")


for _name, _fn in {"wfa_expanding": V.wfa_expanding, "wfa_rolling": V.wfa_rolling, "is_oos": V.chan_is_oos, "cpcv": V.cpcv}.items():
    query(f"s3_{_name}", Q.validated(_name))(lambda spark, d, fn=_fn: fn(P.series(spark, d)).withColumn("n_test_periods", F.col("n_test_periods").cast("long")))


@query("s3_wfa_fixed")
def _(spark, d):
    return V.wfa_expanding(P.series(spark, d), "zscore_robust_mad", fixed=True, window=40, entry=-1.5, stop=0.1, slope_min=0.01)


@query("s3_cpcv_fixed")
def _(spark, d):
    return V.cpcv(P.series(spark, d), "ma_crossover", fixed=True, window=50)


@query("s3_out_of_sample", Q.validated("out_of_sample"))
def _(spark, d):
    return V.out_of_sample(P.series(spark, d))


@query("s3_bootstrap_ci")
def _(spark, d):
    return V.bootstrap_ci(V.out_of_sample(P.series(spark, d)))


@query("s3_monte_carlo")
def _(spark, d):
    return V.monte_carlo(V.out_of_sample(P.series(spark, d)))


@query("s3_sensitivity")
def _(spark, d):
    return V.sensitivity(P.series(spark, d), entry=-2.0, exit_=0.5, stop=0.1)


# Significance -------------------------------------------------------------------------------------


def _s3(spark, d):
    """Walk-forward and cross-validation rows of the tables, and a few that reach every guard."""
    series = P.series(spark, d)
    columns = ["mean_test_sharpe", "std_test_sharpe", "n_test_periods", "n_oos_bars", F.lit(True).alias("passed"), "wfe", "val_method"]
    real = [rounded(fn(series)).select(F.concat_ws(" ", "pair", "val_method").alias("pair"), *columns) for fn in (V.wfa_expanding, V.cpcv)]
    held = spark.createDataFrame(Q.S3_ROWS, "pair string, mean_test_sharpe double, std_test_sharpe double, n_test_periods long, n_oos_bars long, passed boolean, wfe double, val_method string")
    return real[0].unionByName(real[1]).unionByName(held)


_KEEP = ("pair", "passed", "tier")


@query("s4_t_test", Q.S3 + "SELECT pair, round(t,6) AS t_stat, t > 2 AS passed, CASE WHEN t > 2 THEN 'TOP_TIER' ELSE 'REJECT' END AS tier FROM (SELECT pair, CASE WHEN sd > 0 AND n >= 2 THEN m/(sd/sqrt(n)) ELSE 0 END AS t FROM s3 WHERE passed)")
def _(spark, d):
    return S4.t_test(_s3(spark, d)).select("t_stat", *_KEEP)


@query("s4_carver_2sigma", Q.S3 + "SELECT pair, round(l,6) AS lower, l > 0 AS passed, CASE WHEN l > 0 THEN 'TOP_TIER' ELSE 'REJECT' END AS tier FROM (SELECT pair, m - 2*sd/sqrt(n) AS l FROM s3 WHERE passed)")
def _(spark, d):
    return S4.carver_2sigma(_s3(spark, d)).select("lower", *_KEEP)


@query("s4_drawdown", Q.S3 + "SELECT pair, round(-1/greatest(m,0.01)*sqrt(2*coalesce(CASE WHEN nb>0 THEN nb END, n)/252.0),6) AS expected_dd, true AS passed, 'TOP_TIER' AS tier FROM s3 WHERE passed")
def _(spark, d):
    return S4.drawdown(_s3(spark, d)).select("expected_dd", *_KEEP)


@query("s4_permutation", Q.S3 + "SELECT pair, round(q,6) AS null_quantile, m > q AS passed, CASE WHEN m > q THEN 'TOP_TIER' ELSE 'REJECT' END AS tier FROM (SELECT pair, m, 1.6448536269514715*greatest(sd,0.1) AS q FROM s3 WHERE passed)")
def _(spark, d):
    return S4.permutation(_s3(spark, d)).select("null_quantile", *_KEEP)


@query("s4_wfe", Q.S3 + "SELECT pair, wfe > 0.5 AS passed, CASE WHEN wfe > 0.5 THEN 'TOP_TIER' ELSE 'REJECT' END AS tier FROM s3 WHERE passed AND vm LIKE 'wfa%'")
def _(spark, d):
    return S4.wfe(_s3(spark, d)).select(*_KEEP)


@query("s4_psr", Q.PSR)
def _(spark, d):
    return S4.psr(_s3(spark, d)).select("psr", *_KEEP)


@query("s4_dsr", Q.dsr(46))
def _(spark, d):
    return S4.dsr(_s3(spark, d), 46).select("dsr", "sr_star", *_KEEP)


@query("s4_min_trl", Q.MIN_TRL)
def _(spark, d):
    return S4.min_trl(_s3(spark, d)).select(F.when(F.col("min_trl_years") < float("inf"), F.col("min_trl_years")).alias("min_trl_years"), *_KEEP)


@query("s4_best_tier", Q.S3 + "SELECT pair, CASE WHEN t>2 OR l>0 THEN 'TOP_TIER' ELSE 'REJECT' END AS tier, t>2 OR l>0 AS passed, CASE WHEN t<=2 AND l>0 THEN 'carver' ELSE 't_test' END AS sig_method FROM (SELECT pair, CASE WHEN sd > 0 AND n >= 2 THEN m/(sd/sqrt(n)) ELSE 0 END AS t, m - 2*sd/sqrt(n) AS l FROM s3 WHERE passed)")
def _(spark, d):
    s = _s3(spark, d)
    return S4.best_tier({"t_test": S4.t_test(s), "carver": S4.carver_2sigma(s)})


@query("s4_dsr_inputs", Q.DSR_INPUTS)
def _(spark, d):
    s = P.series(spark, d).withColumn("r", R.change(F.col("num_close")))
    out = None
    for w in (10, 20, 40):
        got = s.select(F.col("pair").alias("unit"), F.lit(w).alias("combo"), "seq", F.coalesce((F.col("ratio") > R.mean(F.col("ratio"), w)).cast("int"), F.lit(0)).alias("position"), F.coalesce("r", F.lit(0.0)).alias("r"))
        out = got if out is None else out.unionByName(got)
    return S4.dsr_inputs(out)


@query("s4_dsr_inputs_blocks", Q.DSR_INPUTS)
def _(spark, d):
    """The same positions and returns as ``s4_dsr_inputs``, as blocks."""

    def over_mean(ratio, window):
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        out = np.zeros(len(ratio))
        out[window - 1 :] = ratio[window - 1 :] > (total[window:] - total[:-window]) / window
        return out

    rows = P.series(spark, d).withColumnRenamed("pair", "unit")
    return PB.dsr_inputs(PB.position_blocks(rows, over_mean, [{"window": w} for w in (10, 20, 40)], ("ratio",), "num_close", order="seq"))


@query("s4_dsr_inputs_ohlc", Q.DSR_INPUTS_OHLC)
def _(spark, d):
    """A hundred combinations a ticker on its whole bars: bought low in the bar's range, above a mean of closes."""

    def low_in_range(close, high, low, share, window):
        total = np.concatenate([[0.0], np.cumsum(close)])
        over = np.zeros(len(close), bool)
        over[window - 1 :] = close[window - 1 :] > (total[window:] - total[:-window]) / window
        return ((close - low) < share * (high - low)) & over

    combos = [{"share": a / 20, "window": w} for a in range(6, 16) for w in range(10, 110, 10)]
    return PB.dsr_inputs(PB.position_blocks(P.bars(spark, d).withColumnRenamed("ticker", "unit"), low_in_range, combos))


# Metrics ----------------------------------------------------------------------------------------


def _curve(spark, d):
    return P.px(spark, d).filter("close is not null").select(F.col("ticker").alias("key"), "ts", F.col("close").alias("equity"))


def _returns(spark, d):
    return M.simple_returns(_curve(spark, d)).select("key", "ts", "r")


def _bench(spark, d):
    return M.simple_returns(P.benchmark_px(spark, d).filter("close is not null").select(F.col("ticker").alias("key"), "ts", F.col("close").alias("equity"))).select("ts", "r")


query("met_simple_returns", Q.RET + "SELECT key, ts, round(r,6) AS r FROM ret")(_returns)
query("met_core", Q.RET + Q.CORE)(lambda s, d: M.core(_returns(s, d)))
query("met_equity_metrics", Q.RET + Q.EQUITY)(lambda s, d: M.equity_metrics(_returns(s, d)).select("key", "ulcer", "skew", "kurtosis", "pct_invested", "win_rate", "best_day", "worst_day", "max_dd_run"))
query("met_vs_benchmark", Q.RET + Q.VS)(lambda s, d: M.vs_benchmark(_returns(s, d), _bench(s, d)))
query("met_extended", Q.RET + Q.EXTENDED)(lambda s, d: M.extended(_returns(s, d)).drop("consecutive_wins", "consecutive_losses"))
query("met_streaks", Q.RET + Q.STREAKS)(lambda s, d: M.streak_lengths(_returns(s, d)))
query("met_stability", Q.RET + "SELECT key, round(regr_r2(lc, seq),6) AS stability_r2 FROM (SELECT key, sum(ln(1+r)) OVER w AS lc, row_number() OVER w AS seq FROM ret WINDOW w AS (PARTITION BY key ORDER BY ts)) GROUP BY 1")(lambda s, d: M.stability(_returns(s, d)))
query("met_monthly_table", Q.RET + Q.MONTHLY)(lambda s, d: M.monthly_table(_curve(s, d)))
query("met_annual_returns", Q.RET + Q.ANNUAL)(lambda s, d: M.annual_returns(_curve(s, d)))
query("met_rolling", Q.RET + Q.ROLLING)(lambda s, d: M.rolling(_returns(s, d)))
query("met_rolling_beta", Q.RET + Q.ROLLING_BETA)(lambda s, d: M.rolling_beta(_returns(s, d), _bench(s, d)))
query("met_correlation", Q.RET + "SELECT x.key AS a, y.key AS b, round(corr(x.r,y.r),6) AS corr, round(covar_samp(x.r,y.r),6) AS cov, count(*) AS n FROM ret x JOIN ret y ON x.ts=y.ts AND x.key<y.key GROUP BY 1,2")(lambda s, d: M.correlation(_returns(s, d)))
query("met_tail_correlation", Q.RET + "SELECT x.key AS a, y.key AS b, round(corr(x.r,y.r),6) AS corr, round(covar_samp(x.r,y.r),6) AS cov, count(*) AS n FROM ret x JOIN ret y ON x.ts=y.ts AND x.key<y.key WHERE x.ts IN (SELECT ts FROM ret JOIN (SELECT key, quantile_cont(r,0.05) AS lo, quantile_cont(r,0.95) AS hi FROM ret GROUP BY 1) USING (key) WHERE r<lo OR r>hi) GROUP BY 1,2 HAVING count(*)>=10")(lambda s, d: M.tail_correlation(_returns(s, d)))
query("met_sma_regime", Q.PX + "SELECT ticker AS key, ts, coalesce((CASE WHEN count(*) OVER f=50 THEN avg(close) OVER f END > CASE WHEN count(*) OVER l=200 THEN avg(close) OVER l END)::INTEGER,0) AS regime FROM px WHERE close IS NOT NULL WINDOW f AS (PARTITION BY ticker ORDER BY ts ROWS 49 PRECEDING), l AS (PARTITION BY ticker ORDER BY ts ROWS 199 PRECEDING)")(lambda s, d: M.sma_regime(P.px(s, d)).withColumnRenamed("ticker", "key"))
query("met_drawdown_table", Q.RET + Q.DRAWDOWNS)(lambda s, d: M.drawdown_table(_returns(s, d)).select("key", "valley_date", "depth", "bars_under", F.col("rank").cast("long").alias("rank")))
query("met_decile_returns", Q.RET + Q.DECILE)(lambda s, d: M.decile_returns(_returns(s, d), _bench(s, d)).withColumn("bin", F.col("bin").cast("long")))
query("met_period_returns", Q.RET + "SELECT key, period, round(last/lag(last) OVER (PARTITION BY key ORDER BY period)-1,6) AS r FROM (SELECT ticker AS key, CAST(date_trunc('week',ts) AS DATE) AS period, max_by(close,ts) AS last FROM px WHERE close IS NOT NULL GROUP BY 1,2) QUALIFY lag(last) OVER (PARTITION BY key ORDER BY period) IS NOT NULL")(lambda s, d: M.period_returns(_curve(s, d), "week"))
query("met_bars_per_year", Q.RET + "SELECT ticker AS key, round(count(*)/((max(ts)-min(ts))/365.25),6) AS bars_per_year FROM px WHERE close IS NOT NULL GROUP BY 1")(lambda s, d: M.bars_per_year(_curve(s, d)))
query("met_kde", Q.KDE)(lambda s, d: M.kde(_returns(s, d)))
query("met_curve_hash", Q.CURVE_HASH)(lambda s, d: M.curve_hash(_curve(s, d)))
query("met_bootstrap", Q.BOOTSTRAP)(lambda s, d: RS.bootstrap_stats(_returns(s, d), 200))
query("met_forecast_cone", Q.CONE)(lambda s, d: RS.forecast_cone(_returns(s, d)))
query("met_correlation_blocks", Q.W6 + "SELECT x.ticker AS a, y.ticker AS b, round(corr(x.r,y.r),6) AS corr, round(covar_samp(x.r,y.r),6) AS cov, count(*) AS n FROM ret6 x JOIN ret6 y ON x.ts=y.ts AND x.ticker<y.ticker GROUP BY 1,2")(lambda s, d: M.correlation(_ret6(s, d), names=2, dates=512))
query("met_cumulative_excess", Q.RET + "SELECT key, ts, round(c,6) AS cum, round(e,6) AS cum_bench, round(c-e,6) AS excess FROM (SELECT key, ts, exp(sum(ln(1+r)) OVER w)-1 AS c, exp(sum(ln(1+b)) OVER w)-1 AS e FROM ret JOIN br USING (ts) WINDOW w AS (PARTITION BY key ORDER BY ts))")(lambda s, d: DS.cumulative_excess(_returns(s, d), _bench(s, d)))
query("met_regression", Q.RET + "SELECT key, round(regr_slope(r,b),6) AS beta, round(regr_intercept(r,b)*252,6) AS alpha, round(regr_r2(r,b),6) AS r2, count(*) AS n FROM ret JOIN br USING (ts) GROUP BY 1")(lambda s, d: DS.regression(_returns(s, d), _bench(s, d)))
query("met_period_histogram", Q.PERIOD_HISTOGRAM)(lambda s, d: DS.period_histogram(_curve(s, d), "week", -1.0, 1.0, 8))
query("met_regime_metrics", Q.REGIMES)(lambda s, d: M.regime_metrics(_returns(s, d), M.sma_regime(P.benchmark_px(s, d))))
query("met_rebase", Q.PX + "SELECT ticker AS key, ts, round(close*100/first(close) OVER (PARTITION BY ticker ORDER BY ts),6) AS equity FROM px WHERE close IS NOT NULL AND ts >= DATE '1997-01-01'")(lambda s, d: M.rebase(_curve(s, d), "1997-01-01"))


query("met_stress_published", Q.RET + "SELECT key, name, count(*) AS n, round(exp(sum(ln(1+r)))-1,6) AS total_return FROM ret JOIN " + Q.STRESS_ROWS + " ON ts BETWEEN a AND b GROUP BY 1,2 HAVING count(*)>=5")(lambda s, d: M.stress_windows(_returns(s, d), M.stress_table(s)).select("key", "name", "n", "total_return"))


@query("met_stress_windows", Q.RET + "SELECT key, name, count(*) AS n, round(exp(sum(ln(1+r)))-1,6) AS total_return FROM ret JOIN (VALUES ('w96',DATE '1996-01-01',DATE '1996-06-30'),('w98',DATE '1998-07-01',DATE '1998-10-31'),('w00',DATE '2000-03-01',DATE '2001-03-31')) v(name,a,b) ON ts BETWEEN a AND b GROUP BY 1,2 HAVING count(*)>=5")
def _(spark, d):
    w = spark.sql("SELECT * FROM VALUES ('w96',DATE '1996-01-01',DATE '1996-06-30'),('w98',DATE '1998-07-01',DATE '1998-10-31'),('w00',DATE '2000-03-01',DATE '2001-03-31') AS v(name,start,end)")
    return M.stress_windows(_returns(spark, d), w).select("key", "name", "n", "total_return")


def _trades(spark, d):
    """Trades of the z-score backtest."""
    return DS.trades_of(B.run(SG.zscore_standard(P.series(spark, d))))


query("tr_trades", Q.TRADES + "SELECT pair, trade, entry_ts, exit_ts, bars, round(pnl,6) AS pnl FROM trades")(lambda s, d: _trades(s, d).withColumn("trade", F.col("trade").cast("long")))
query("tr_kpis", Q.TRADES + "SELECT pair, count(*) AS n, round(avg((pnl>0)::INTEGER),6) AS win_rate, round(avg(pnl) FILTER (pnl>0),6) AS mean_win, round(avg(pnl) FILTER (pnl<0),6) AS mean_loss, round(sum(pnl) FILTER (pnl>0)/nullif(-sum(pnl) FILTER (pnl<0),0),6) AS profit_factor, round(avg(pnl),6) AS expectancy, round(avg(bars),6) AS mean_bars, round(max(pnl),6) AS best, round(min(pnl),6) AS worst FROM trades GROUP BY 1")(lambda s, d: DS.trade_kpis(_trades(s, d), ("pair",)))
query("tr_open_positions", Q.TRADES + "SELECT ts, (SELECT count(*) FROM trades t WHERE t.entry_ts <= d.ts AND t.exit_ts > d.ts) AS n_open FROM (SELECT DISTINCT ts FROM s) d")(lambda s, d: DS.open_positions(_trades(s, d), P.series(s, d)))
query("tr_histogram", Q.TRADES + "SELECT bin, CASE WHEN bin > 0 THEN round(-0.1+(bin-1)*0.02,6) END AS low, CASE WHEN bin <= 10 THEN round(-0.1+bin*0.02,6) END AS high, count(*) AS n FROM (SELECT (CASE WHEN pnl < -0.1::DOUBLE THEN 0 WHEN pnl > 0.1::DOUBLE THEN 11 ELSE least(floor((pnl+0.1::DOUBLE)/(0.2::DOUBLE/10))+1,10) END)::INTEGER AS bin FROM trades) GROUP BY 1")(lambda s, d: DS.histogram(_trades(s, d), "pnl", -0.1, 0.1, 10))
query("tr_box", Q.TRADES + "SELECT pair, n, round(q1,6) AS q1, round(md,6) AS median, round(q3,6) AS q3, round(min(pnl) FILTER (ins),6) AS low, round(max(pnl) FILTER (ins),6) AS high, count(*) FILTER (NOT ins) AS outliers FROM (SELECT pair, pnl, n, q1, md, q3, pnl BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) AS ins FROM trades JOIN (SELECT pair, count(*) AS n, quantile_cont(pnl,0.25) AS q1, quantile_cont(pnl,0.5) AS md, quantile_cont(pnl,0.75) AS q3 FROM trades GROUP BY 1) USING (pair)) GROUP BY ALL")(lambda s, d: DS.box(_trades(s, d), "pnl", ("pair",)))

# Weights ----------------------------------------------------------------------------------------


def _ret6(spark, d):
    return M.simple_returns(P.px6(spark, d).filter("close is not null").select(F.col("ticker").alias("key"), "ts", F.col("close").alias("equity"))).select("key", "ts", "r")


def _members(spark, d):
    tier = F.when(F.col("sector") == "A", "TOP_TIER").when(F.col("sector") == "N", "SECOND_TIER").otherwise("REJECT")
    return P.px6(spark, d).select("ticker").distinct().withColumn("sector", F.substring("ticker", 1, 1)).withColumn("tier", tier)


query("w_equal", Q.W6 + "SELECT ticker, round(1.0::DOUBLE/count(*) OVER (),6) AS w FROM st")(lambda s, d: WT.equal_weight(_members(s, d)))
query("w_inverse_vol", Q.W6 + "SELECT ticker, round((1/sd)/sum(1/sd) OVER (),6) AS w FROM st")(lambda s, d: WT.inverse_vol(_members(s, d), _ret6(s, d)))
query("w_sharpe", Q.W6 + "SELECT ticker, round(CASE WHEN sum(greatest(mu/sd,0)) OVER ()>0 THEN greatest(mu/sd,0)/sum(greatest(mu/sd,0)) OVER () ELSE 1.0/count(*) OVER () END,6) AS w FROM st")(lambda s, d: WT.sharpe_weighted(_members(s, d), _ret6(s, d)))
query("w_half_kelly", Q.W6 + "SELECT ticker, round(CASE WHEN sum(greatest(mu/(2*sd*sd),0)) OVER ()>0 THEN greatest(mu/(2*sd*sd),0)/sum(greatest(mu/(2*sd*sd),0)) OVER () ELSE 1.0/count(*) OVER () END,6) AS w FROM st")(lambda s, d: WT.half_kelly(_members(s, d), _ret6(s, d)))
query("w_handcraft", Q.W6 + "SELECT ticker, round(x/sum(x) OVER (),6) AS w FROM (SELECT ticker, (1/sd)/sum(1/sd) OVER (PARTITION BY left(ticker,1)) AS x FROM st)")(lambda s, d: WT.handcraft(_members(s, d), _ret6(s, d)))
query("w_tier_based", Q.W6 + "SELECT ticker, round(x/sum(x) OVER (),6) AS w FROM (SELECT ticker, CASE left(ticker,1) WHEN 'A' THEN 2.0::DOUBLE WHEN 'N' THEN 1.0 ELSE 0.0 END AS x FROM st)")(lambda s, d: WT.tier_based(_members(s, d)))
query("w_dynamic_1k", Q.W6 + "SELECT ticker, round(x/sum(x) OVER (),6) AS w FROM (SELECT ticker, least(1.0::DOUBLE/count(*) OVER (),0.25) AS x FROM st)")(lambda s, d: WT.dynamic_1k(_members(s, d)))
query("w_cap", Q.W6 + "SELECT ticker, round(x/sum(x) OVER (),6) AS w FROM (SELECT ticker, least((1/sd)/sum(1/sd) OVER (),0.2) AS x FROM st)")(lambda s, d: WT.cap_weights(WT.inverse_vol(_members(s, d), _ret6(s, d)), 0.2))
query("w_risk_parity")(lambda s, d: WT.risk_parity(_ret6(s, d)))
query("w_hrp")(lambda s, d: WT.hrp(_ret6(s, d)))
query("w_diversification", Q.DIVERSIFICATION)(lambda s, d: WT.M.diversification(WT.equal_weight(_members(s, d)).withColumnRenamed("ticker", "key"), _ret6(s, d)))
query("w_combine", Q.W6 + "SELECT ts, round(sum(r)/(SELECT count(*) FROM st),6) AS r FROM ret6 GROUP BY 1")(lambda s, d: WT.combine(WT.equal_weight(_members(s, d)), _ret6(s, d)).select("ts", "r"))


@query("w_narrow_sector", Q.W6 + "SELECT ticker, left(ticker,1) AS sector, CASE left(ticker,1) WHEN 'A' THEN 'TOP_TIER' WHEN 'N' THEN 'SECOND_TIER' ELSE 'REJECT' END AS tier, round(mu/sd,6) AS sharpe FROM st QUALIFY row_number() OVER (PARTITION BY left(ticker,1) ORDER BY mu/sd DESC, ticker) <= greatest(2, floor(count(*) OVER ()*0.25))")
def _(spark, d):
    sh = WT.stats_of(_ret6(spark, d)).select("ticker", (F.col("mu") / F.col("sd")).alias("sharpe"))
    return WT.narrow_sector(_members(spark, d).join(sh, "ticker"))


@query("w_narrow_clusters")
def _(spark, d):
    r = _ret6(spark, d)
    sh = {x["ticker"]: x["mu"] / x["sd"] for x in WT.stats_of(r).collect()}
    return spark.createDataFrame([(t,) for t in WT.narrow_clusters(r, sh, per_cluster=1)], "ticker string")


@query("w_narrow_max_div")
def _(spark, d):
    return spark.createDataFrame([(t,) for t in WT.narrow_max_div(_ret6(spark, d))], "ticker string")


# Replay, pipeline, streaming --------------------------------------------------------------------


def replay_input(spark: SparkSession, d: str) -> DataFrame:
    s = SG.zscore_standard(P.series(spark, d))
    b = B.run(s)
    return b.select(F.col("pair").alias("ticker"), "ts", F.col("num_close").alias("close"), (F.col("num_close") * 0.995).alias("low"), (F.col("num_close") * 0.01).alias("atr"), F.col("position").alias("pos_raw"), F.lit(1).alias("stop_code"), F.lit(0.1).alias("stop_param"))


SCHEMES = [*RP.scheme_names(), *(f"{tag}__{s}" for tag in RP.RULE_TAGS for s in ("equal_weight", "flat_1k_cap10", "roll_sr_cap10"))]


@query("rp_schemes", Q.SCHEMES)
def _(spark, d):
    rows = [RP.parse_scheme(n) for n in RP.scheme_names()]
    return spark.createDataFrame([(r.name, r.family, r.base, r.cap, r.rule) for r in rows], "scheme string, family string, base string, cap double, rule string")


@query("rp_days")
def _(spark, d):
    return RP.run_schemes(replay_input(spark, d), SCHEMES, seed=10_000_000.0)


@query("rp_trades")
def _(spark, d):
    return RP.run_schemes(replay_input(spark, d), SCHEMES, seed=10_000_000.0, output="trades")


@query("rp_counts")
def _(spark, d):
    return RP.run_schemes(replay_input(spark, d), SCHEMES, seed=10_000_000.0, output="counts")


@query("rp_concentration")
def _(spark, d):
    return RP.concentration(RP.run_schemes(replay_input(spark, d), SCHEMES, seed=10_000_000.0))


def _summary(spark, d):
    rows = replay_input(spark, d)
    # Several statistics read the days: they are replayed once.
    days, counts = (RP.run_schemes(rows, SCHEMES, seed=10_000_000.0, output=o).persist() for o in ("days", "counts"))
    bench = P.benchmark_px(spark, d).filter("close is not null").select("ts", F.col("close").alias("equity"))
    return RP.summary_rows(days, counts, bench, "1998-01-01", 10_000_000.0, "BENCH")


@query("rp_summary")
def _(spark, d):
    return _summary(spark, d)


@query("rp_beat_benchmark")
def _(spark, d):
    return RP.beat_benchmark(_summary(spark, d).persist(), "BENCH")


@query("rp_collapsed")
def _(spark, d):
    days = RP.run_schemes(replay_input(spark, d), SCHEMES, seed=10_000_000.0)
    hashes = M.curve_hash(days.filter("ts >= date'1998-01-01'").select(F.col("scheme").alias("key"), "ts", F.col("nav").alias("equity"))).withColumnsRenamed({"key": "scheme", "curve_sha1": "curve_hash"})
    return RP.collapse_equal(hashes, "equal_weight")


@query("rp_live_shares", Q.PX + "SELECT ticker, ts, CAST(floor(0.1*100000*0.95/(close*1.0005*1.001)) AS BIGINT) AS shares FROM px WHERE close IS NOT NULL")
def _(spark, d):
    return P.px(spark, d).filter("close is not null").select("ticker", "ts", RP.live_shares(F.lit(0.1), F.col("close"), F.lit(100000.0), F.lit("enter")).alias("shares"))


@query("rp_commission", Q.PX + "SELECT ticker, ts, round(least(greatest(1.0,0.005*10000/close),100.0),6) AS fixed, round(least(greatest(0.35,0.0035*10000/close)+0.0008*10000/close,100.0),6) AS tiered FROM px WHERE close IS NOT NULL")
def _(spark, d):
    n, sh = F.lit(10000.0), 10000.0 / F.col("close")
    return P.px(spark, d).filter("close is not null").select("ticker", "ts", RP.commission_column(sh, n, "ibkr_pro_fixed").alias("fixed"), RP.commission_column(sh, n, "ibkr_pro_tiered").alias("tiered"))


@query("rp_as_of", Q.RET + "SELECT r.key AS ticker, r.ts, round((SELECT max_by(score, b.ts) FROM (SELECT key, CAST(date_trunc('month',ts) AS DATE) AS ts, avg(r) AS score FROM ret GROUP BY 1,2) b WHERE b.key=r.key AND b.ts<=r.ts),6) AS score FROM ret r")
def _(spark, d):
    r = _returns(spark, d).withColumnRenamed("key", "ticker")
    scores = r.groupBy("ticker", F.trunc("ts", "month").alias("ts")).agg(F.avg("r").alias("score"))
    return RP.as_of(r.select("ticker", "ts"), scores)


@query("pl_funnel")
def _(spark, d):
    prices = P.px(spark, d)
    return PL.Pipeline(s1="passthrough", s4=["t_test", "min_trl"], config={"min_is_sharpe": -9.0, "min_oos_sharpe": -9.0, "min_is_trades": 1, "min_oos_trades": 0, "s3_min_oos_sharpe": -9.0}).run(prices, P.universe(prices), stop_after="s4").stages["s4"].select("pair", "tier", "passed", "sig_method")


@query("pl_gates")
def _(spark, d):
    """A signal on a scale of its own through optimiser and validators, with gates that some pairs fail: what each pair's
    chosen settings do out of sample, by the optimiser and by the validators, and what passes."""
    prices = P.px(spark, d)
    made = PL.Pipeline(s1="passthrough", signal="stochastic_k", s3=["chan_is_oos", "sensitivity"], s4="t_test", config={"use_s2_window": True, "min_is_sharpe": 0.0, "min_oos_sharpe": -1.0})
    out = made.run(prices, P.universe(prices), stop_after="s3").stages
    chosen = out["s2"].select("pair", "window", "entry_thresh", "exit_thresh", "stop_pct", "is_sharpe", "oos_sharpe", F.col("passed").alias("optimised"))
    return chosen.join(out["s3"].select("pair", "val_method", "mean_test_sharpe", "baseline_sharpe", "n_test_periods", "passed"), "pair", "left")


@query("ql_anomalies", Q.S + "SELECT 's1_pass_rate' AS \"check\", avg(1.0::DOUBLE) AS value, 0.05::DOUBLE AS low, 0.95::DOUBLE AS high, 'warn' AS severity, avg(1.0::DOUBLE) BETWEEN 0.05 AND 0.95 AS ok FROM (SELECT pair FROM s GROUP BY 1 HAVING count(*)>=252)")
def _(spark, d):
    return PL.anomalies(S1.passthrough(P.series(spark, d)), "s1")


@query("ql_checks", Q.CHECKS)
def _(spark, d):
    """All seven checks on monthly statistics of the pairs, which stand in for the stages' rows."""
    s = P.series(spark, d).withColumn("r", R.change(F.col("ratio"))).withColumn("month", F.trunc("ts", "month"))
    g = s.groupBy("pair", "month").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("mu"), F.coalesce(F.avg((F.col("r") > 0).cast("int")), F.lit(0.0)).alias("fold_win_rate"))
    rows = g.select("pair", "month", (F.col("mu") * 1000).alias("oos_sharpe"), (F.col("mu") > 0).alias("passed"), "fold_win_rate", (F.col("mu") > 0.01).alias("psr_pass"), (F.col("mu") - 1).alias("ir_vs_spy"), (F.col("mu") * 10).alias("oos_sr_haircut"))
    out = None
    for stage in ("s1", "s2", "s3", "s4", "s5"):
        got = PL.anomalies(rows, stage, strict_on=("s5_ir_vs_spy",))
        out = got if out is None else out.unionByName(got)
    return out


def _monthly_s1(spark, d):
    """Screens of each pair and month: some have no half-life, so a window of 0, and some lack a value."""
    s = P.series(spark, d).withColumn("month", F.month("ts").cast("string"))
    h = S1.halflives(s.withColumn("ratio", F.col("ratio")), by=("pair", "month"))
    parts = F.split("pair", "/")
    return h.select("pair", F.when(F.col("month") != "1", parts[0]).alias("numerator"), parts[1].alias("denominator"), F.when(F.col("month") == "2", F.lit("maybe")).otherwise(F.lit("true")).alias("passed"), "halflife", S1.window_of(F.col("halflife")).cast("double").alias("window"), F.when(F.col("month") != "3", F.lit("monthly")).alias("method"), "month")


@query("ql_rows", Q.ROWS)
def _(spark, d):
    """Counts of broken rules, of examples and of good rows, from one pass over the table."""
    root = f"{shared_folder(spark)}/tidemark-rows/{uuid.uuid4().hex}"
    files = Files(spark, root)
    files.make()
    files.delete_on_exit()
    got = RL.split_rows(_monthly_s1(spark, d), "s1", f"{root}/s1")
    shown = got.examples.groupBy("rule").agg(F.count("*").alias("examples"))
    good = got.good.agg(F.lit("good").alias("rule"), F.count("*").alias("n")).withColumn("examples", F.lit(0).cast("long"))
    return got.counts.join(shown, "rule").unionByName(good)


_EV = "SELECT {a}, event_type, count(*) AS n, round({v},6) AS {name} FROM {src} GROUP BY 1,2"
query("ev_tumbling", _EV.format(a="date_trunc('hour', ts) AS start", v="avg(value)", name="mean_value", src="events"))(lambda s, d: EV.tumbling(s.read.parquet(f"{d}/events.parquet")))
query("ev_sliding", _EV.format(a="date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start", v="sum(value)", name="total", src="events, range(2) t(k)"))(lambda s, d: EV.sliding(s.read.parquet(f"{d}/events.parquet")))
query("ev_sessions", "SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true)::INTEGER AS b FROM events)) GROUP BY user_id, g")(lambda s, d: EV.sessions(s.read.parquet(f"{d}/events.parquet")))
