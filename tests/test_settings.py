"""What an optimiser chose is what the validators trade, for every signal and preset."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as B, patterns as PT, pipeline as PL, segments as SG, signals, validation as V


@pytest.fixture(scope="module")
def series(spark):
    """Three pairs that swing around a slow trend, so that most signals trade."""
    rng = np.random.default_rng(8)
    rows = []
    for k, name in enumerate(("a", "b", "c")):
        i = np.arange(700)
        x = (1 + 0.08 * np.sin(i / (6 + 3 * k)) + 0.03 * np.sin(i / 2.3)) * np.exp(np.cumsum(rng.normal(0.0004, 0.006, 700)))
        rows += [(name, n + 1, float(v), float(100 * v), 100.0) for n, v in enumerate(x)]
    return spark.createDataFrame(rows, "pair string, seq int, ratio double, num_close double, den_close double").withColumn("ts", F.date_add(F.lit("2020-01-01").cast("date"), "seq")).persist()


def test_every_signal_has_a_function_of_a_stretch():
    assert set(signals.SIGNALS) == set(SG.SEGMENT_SIGNALS)
    assert set(SG.THRESHOLDS) <= set(SG.SEGMENT_SIGNALS) and set(PL.GRIDS) <= set(SG.SEGMENT_SIGNALS)


@pytest.mark.parametrize("signal", sorted(SG.SEGMENT_SIGNALS))
def test_validators_trade_the_optimisers_row(series, signal):
    """With the optimiser's window, the out-of-sample part of both is one backtest."""
    entries, exits = PL.GRIDS.get(signal, (B.ENTRIES[::2], B.EXITS[:3]))
    window = {"sma_distance": 20, "rsi_simple": 14, "rsi_wilder": 14, "rsi_connors": 4, "cum_rsi": 2, "stochastic_k": 14, "williams_r": 14, "consec_down": 2, "nday_low": 7, "double_bottom": 10, "adx_ema_pullback": 10}.get(signal, 20)
    found = B.grid_search(series, signal, windows=(window,), entries=entries, exits=exits, stops=(0.0, 0.1), least_is=-99.0, least_oos=-99.0, least_oos_trades=0, least_trades=1)
    best = found.select("pair", "window", "entry_thresh", "exit_thresh", "stop_pct", "slope_min", "is_sharpe", "oos_sharpe").persist()
    rows = {r["pair"]: r for r in best.collect()}
    live = series.join(best.drop("oos_sharpe"), "pair")
    split = {r["pair"]: r for r in V.chan_is_oos(live, signal, fixed=True).collect()}
    varied = {r["pair"]: r for r in V.sensitivity(live, signal).collect()}
    assert set(split) == set(rows) == set(varied)
    for pair, r in rows.items():
        assert split[pair]["mean_test_sharpe"] == pytest.approx(r["oos_sharpe"], abs=1e-9)
        assert varied[pair]["baseline_sharpe"] == pytest.approx(r["oos_sharpe"], abs=1e-9)
        settings = [r["entry_thresh"], r["exit_thresh"], r["stop_pct"], r["slope_min"]]
        assert varied[pair]["n_test_periods"] == 2 * sum(s != 0 for s in settings)
        if signal in PL.GRIDS:
            assert r["entry_thresh"] in entries and r["exit_thresh"] in exits
    # Signals that never trade would make this empty.
    assert rows, signal


def test_thresholds_are_the_signals_own(series):
    x, w = np.array([r["ratio"] for r in series.filter("pair = 'a'").orderBy("seq").collect()]), 14
    for signal, (entry, exit_) in SG.THRESHOLDS.items():
        plain, given = (SG.flags(SG.SEGMENT_SIGNALS[signal], x, w, p) for p in ({}, {"entry": entry, "exit_": exit_}))
        assert all((a == b).all() for a, b in zip(plain, given)), signal


def test_sensitivity_needs_a_signal(series):
    with pytest.raises(ValueError):
        V.sensitivity(series, None)


def test_signals_and_optimisers_that_do_not_match():
    for wrong in ({"s2": "grid_ma", "signal": "zscore_standard"}, {"s2": "grid_regime", "signal": "bollinger"}, {"s2": "grid_search", "signal": "obv_pivot"}, {"s2": "grid_search", "signal": "trendline_breakout"}, {"s2": "grid_breakout", "signal": "momentum"}):
        with pytest.raises(ValueError):
            PL.Pipeline(**wrong)
    assert [PL.Pipeline(s2=s).signal for s in ("grid_search", "grid_ma", "optuna_ma", "grid_regime", "grid_breakout")] == ["zscore_standard", "ma_crossover", "ma_crossover", "regime_switch", "trendline_breakout"]

    @signals.register_signal
    def nowhere(s, **_):
        return s

    try:
        with pytest.raises(ValueError):
            PL.Pipeline(signal="nowhere")
    finally:
        del signals.SIGNALS["nowhere"]


def test_breakouts_trade_each_pairs_own_row(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, pair in enumerate(("A/B", "A/C")):
        x = 1 + 0.1 * np.sin(np.arange(500) / (9 + k)) + np.cumsum(rng.normal(0, 0.002, 500))
        rows += [(pair, i, float(v * 1.002), float(v * 0.998), float(v), float(100 * v)) for i, v in enumerate(x)]
    bars = spark.createDataFrame(rows, "pair string, d int, high double, low double, close double, num_close double").selectExpr("pair", "date_add(date'2020-01-01', d) AS ts", "high", "low", "close", "num_close")
    lines = {"least_points": 3, "error_pct": 1.0, "least_period": 10}
    chosen = spark.createDataFrame([("A/B", 1.0, 2.0, 0.1), ("A/C", 2.0, 1.0, 0.0)], "pair string, entry_thresh double, exit_thresh double, stop_pct double")
    grid = {(r["pair"], r["entry_conf"], r["exit_conf"], r["stop_pct"]): r for r in PT.grid_breakout(bars, (1, 2, 3), (1, 2, 3), (0.0, 0.08, 0.1, 0.12), **lines).collect()}
    got = {r["pair"]: r for r in PT.breakout_sensitivity(bars, chosen, V.VALIDATED, **lines).collect()}
    near = {("A/B", 1, 2, 0.1): [(2, 2, 0.1), (1, 1, 0.1), (1, 3, 0.1), (1, 2, 0.08), (1, 2, 0.12)], ("A/C", 2, 1, 0.0): [(1, 1, 0.0), (3, 1, 0.0), (2, 2, 0.0)]}
    for key, others in near.items():
        r = got[key[0]]
        assert r["baseline_sharpe"] == pytest.approx(grid[key]["oos_sharpe"]) and r["n_test_periods"] == len(others)
        assert r["mean_test_sharpe"] == pytest.approx(np.mean([grid[(key[0], a, b, next(s for s in (0.0, 0.08, 0.1, 0.12) if abs(s - c) < 1e-9))]["oos_sharpe"] for a, b, c in others]), abs=1e-6)
    rets = PT.breakout_returns(bars, chosen, **lines)
    assert rets.count() == 1000 and rets.filter("ret <> 0").count() > 0


@pytest.mark.parametrize("name", ["ALT-VFG", "ALT-COINT"])
def test_presets_name_the_signal_they_trade(spark, series, name):
    prices = series.select(F.upper("pair").alias("ticker"), "ts", F.col("num_close").alias("close"))
    pairs = spark.createDataFrame([("A/A", "A", "A"), ("B/B", "B", "B"), ("C/C", "C", "C")], "pair string, numerator string, denominator string")
    loose = {"min_is_sharpe": -99.0, "min_oos_sharpe": -99.0, "min_oos_trades": 0, "min_is_trades": 1, "entry_grid": [-1.5, -1.0], "exit_grid": [0.0, 0.5], "use_s2_window": True}
    preset = PL.PRESETS[name] | {"s1": "passthrough", "s3": ["chan_is_oos", "sensitivity"], "s4": "t_test"}
    made = PL.Pipeline(name=name, **preset)
    out = made.run(prices, pairs, loose, stop_after="s3").stages
    s2 = {r["pair"]: r for r in out["s2"].collect()}
    s3 = {(r["pair"], r["val_method"]): r for r in out["s3"].collect()}
    assert s2 and {r["signal_method"] for r in s2.values()} == {preset["signal"]}
    for pair, r in s2.items():
        assert s3[pair, "chan_is_oos"]["mean_test_sharpe"] == pytest.approx(r["oos_sharpe"], abs=1e-9)
        assert s3[pair, "sensitivity"]["baseline_sharpe"] == pytest.approx(r["oos_sharpe"], abs=1e-9) and s3[pair, "sensitivity"]["n_test_periods"] > 0
