"""The staged funnel, its registry, presets, quality gates, bridge and comparison."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources import panel as P
from . import backtest as B, metrics as M, patterns as PT, rules as RL, screens, segments as SG, signals, significance as S, validation as V, weights as WT

STAGES = ("s0", "s1", "s2", "s3", "s4", "s5")
REGISTRY: dict[str, dict[str, Callable]] = {s: {} for s in STAGES}

# The columns each stage's table must have.
REQUIRED = {
    "s1": ("pair", "numerator", "denominator", "passed", "halflife", "window", "method"),
    "s2": ("pair", "numerator", "denominator", "halflife", "window", "entry_thresh", "exit_thresh", "stop_pct", "slope_min", "is_sharpe", "is_penalized_sharpe", "is_trades", "oos_sharpe", "oos_trades", "passed", "signal_method", "optim_method"),
    "s3": ("pair", "numerator", "denominator", "mean_test_sharpe", "std_test_sharpe", "n_test_periods", "baseline_sharpe", "degradation", "passed", "val_method"),
    "s4": ("pair", "numerator", "denominator", "passed", "tier"),
    "s5": ("scheme_name", "cohort", "oos_sr_full", "oos_cagr", "oos_max_dd", "n_units"),
}


def register_stage(stage: str) -> Callable[[Callable], Callable]:
    if stage not in REGISTRY:
        raise KeyError(f"no stage {stage!r}; there are {', '.join(STAGES)}")

    def put(fn: Callable) -> Callable:
        REGISTRY[stage][fn.__name__] = fn
        return fn

    return put


def method(stage: str, name: str) -> Callable:
    try:
        return REGISTRY[stage][name]
    except KeyError:
        raise KeyError(f"no {stage} method {name!r}; there are {', '.join(sorted(REGISTRY.get(stage, {})))}") from None


for _f in (screens.chan_halflife, screens.chan_hurst, screens.kaufman_er, screens.variance_ratio, screens.kpss, screens.cadf, screens.cadf_rolling, screens.johansen, screens.vol_cone, screens.passthrough, screens.chan_combined, screens.trend_combined, screens.regime_aware):
    register_stage("s1")(_f)
for _f in (screens.kaufman_kama, screens.cadf_rolling_kalman):
    register_stage("s1")(_f)
REGISTRY["s1"] |= {"chan_hurst_trend": lambda series: screens.chan_hurst(series, trend=True), "kaufman_er_trend": lambda series: screens.kaufman_er(series, trend=True)}
for _f in (B.grid_search, B.grid_regime, B.grid_ma, B.optuna_tpe, B.optuna_ma, PT.grid_breakout, PT.grid_obv_pivot):
    register_stage("s2")(_f)
for _f in (V.wfa_expanding, V.wfa_rolling, V.chan_is_oos, V.cpcv, V.bootstrap_ci, V.monte_carlo, V.sensitivity):
    register_stage("s3")(_f)
for _f in (S.t_test, S.carver_2sigma, S.psr, S.dsr, S.min_trl, S.permutation, S.drawdown, S.wfe):
    register_stage("s4")(_f)
for _f in (WT.equal_weight, WT.inverse_vol, WT.sharpe_weighted, WT.half_kelly, WT.risk_parity, WT.hrp, WT.handcraft, WT.tier_based, WT.dynamic_1k):
    register_stage("s5")(_f)


def validate_interface(df: DataFrame, stage: str) -> DataFrame:
    lacking = [c for c in REQUIRED[stage] if c not in df.columns]
    if lacking:
        raise ValueError(f"{stage} table lacks {', '.join(lacking)}")
    return df


def violations(df: DataFrame, stage: str) -> DataFrame:
    """Rows that break each rule of the stage, counted in one pass: (rule, n)."""
    return RL.rule_counts(RL.check_rows(df, stage))


def build_tag(overrides: dict[str, Any], most: int = 40) -> str:
    """A short name of parameter overrides; a digest if it would be long."""
    parts = []
    for k, v in sorted(overrides.items()):
        short = "".join(p[0] for p in k.split("_"))
        parts.append(f"{short}{'on' if v is True else 'off' if v is False else round(v * 100) if isinstance(v, float) else v}")
    tag = "_".join(parts)
    return tag if len(tag) <= most else hashlib.sha256(tag.encode()).hexdigest()[:8]


def stage_name(stage: str, cohort: str | None = None, tag: str = "") -> str:
    return "_".join(x for x in (stage, cohort, tag, "metrics") if x)


def write_stage(df: DataFrame, stage: str, folder: str, cohort: str | None = None, tag: str = "", fmt: str = "parquet", validate: bool = True, rows: str = "off") -> str:
    """``rows``: off; split (good rows are written here, all rows and examples of bad ones go to ``quarantine`` beside
    it); strict (bad rows raise SchemaError and no stage table is written)."""
    if rows not in ("off", "split", "strict"):
        raise ValueError(f"no row check {rows!r}; there are off, split, strict")
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"no format {fmt!r}; there are parquet and csv")
    if validate:
        validate_interface(df, stage)
    path = f"{folder.rstrip('/')}/{stage_name(stage, cohort, tag)}.{fmt}"
    if rows != "off":
        df = RL.split_rows(df, stage, f"{folder.rstrip('/')}/quarantine/{stage_name(stage, cohort, tag)}", rows == "strict").good
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)
    return path


def read_stage(spark, path: str, stage: str, schema=None, validate: bool = True) -> DataFrame:
    fmt = path.rstrip("/").rsplit(".", 1)[-1]
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"no format {fmt!r}; there are parquet and csv")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path) if fmt == "parquet" else reader.option("header", True).csv(path)
    return validate_interface(df, stage) if validate else df


def checkpoint_units(rows: DataFrame, folder: str, key: str = "pair") -> DataFrame:
    """``rows`` appended to a typed Parquet table of finished units, but for those it holds already."""
    held = finished_units(rows.sparkSession, folder)
    fresh = rows if held is None else rows.join(held.select(key).distinct(), key, "left_anti")
    fresh.write.mode("append").parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def finished_units(spark, folder: str) -> DataFrame | None:
    """The table of finished units, or None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(folder) if there else None


def unfinished(units: DataFrame, done: DataFrame, key: str = "pair") -> DataFrame:
    """Resume: the units that no checkpoint row names yet."""
    return units.join(done, key, "left_anti")


# The published checks (stage, statistic, columns it needs, low, high) and those strict by themselves.
CHECKS = {
    "s1_pass_rate": ("s1", "avg(cast({0} as int))", ("passed",), 0.05, 0.95),
    "s2_oos_sr": ("s2", "percentile({0}, 0.5)", ("oos_sharpe",), None, 2.0),
    "s3_fold_win_rate": ("s3", "percentile({0}, 0.5)", ("fold_win_rate",), 0.5, None),
    "s3_cohort_size": ("s3", "coalesce(sum(cast({0} as int)), 0)", ("passed",), 50.0, None),
    "s4_pass_rate": ("s4", "avg(cast({0} as int))", ("psr_pass", "passed"), 0.05, 0.90),
    "s5_ir_vs_spy": ("s5", "max({0})", ("ir_vs_spy",), 0.0, None),
    "s5_locked_sr": ("s5", "max({0})", ("oos_sr_haircut",), 0.5, None),
}
STRICT = ("s2_oos_sr", "s4_pass_rate")


def resolve_severity(check: str, policy: str = "warn", strict_on: tuple[str, ...] = ()) -> str:
    """A check named in ``strict_on`` is strict; else the policy off or strict holds; else the check's own default."""
    if check in strict_on:
        return "strict"
    if policy in ("off", "strict"):
        return policy
    return "strict" if check in STRICT else "warn"


def anomalies(df: DataFrame, stage: str, policy: str = "warn", strict_on: tuple[str, ...] = (), bands: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """(check, value, low, high, severity, ok): all checks of the stage in one aggregate.

    A check reads the first of its columns that there is; without one, and with severity off, it has no row. Where
    there is nothing to measure (no rows, only nulls) a check is ok. ``bands`` changes published bounds.
    """
    if stage not in STAGES:
        raise KeyError(f"no stage {stage!r}; there are {', '.join(STAGES)}")
    mine = {}
    for name, (at, statistic, columns, low, high) in CHECKS.items():
        there = [c for c in columns if c in df.columns]
        severity = resolve_severity(name, policy, strict_on)
        if at == stage and there and severity != "off":
            mine[name] = (statistic.format(there[0]), *(bands or {}).get(name, (low, high)), severity)
    schema = "check string, value double, low double, high double, severity string, ok boolean"
    if not mine:
        return df.sparkSession.createDataFrame([], schema)
    g = df.agg(*[F.expr(v[0]).cast("double").alias(k) for k, v in mine.items()]).unpivot([], list(mine), "check", "value")
    about = F.create_map(*[x for k, v in mine.items() for x in (F.lit(k), F.struct(F.lit(v[1]).cast("double").alias("low"), F.lit(v[2]).cast("double").alias("high"), F.lit(v[3]).alias("severity")))])
    g = g.withColumn("b", about[F.col("check")])
    outside = F.coalesce(F.col("value") < F.col("b.low"), F.lit(False)) | F.coalesce(F.col("value") > F.col("b.high"), F.lit(False))
    return g.select("check", "value", "b.low", "b.high", "b.severity", (~outside).alias("ok"))


EVENTS = ("pipeline_start", "pipeline_end", "stage_start", "stage_end", "stage_error", "anomaly", "write")
_HOOKS: dict[str, list[tuple[dict[str, Any], Callable]]] = {e: [] for e in EVENTS}


def register_hook(event: str, **match: Any) -> Callable[[Callable], Callable]:
    if event not in _HOOKS:
        raise KeyError(f"no event {event!r}; there are {', '.join(EVENTS)}")

    def put(fn: Callable) -> Callable:
        _HOOKS[event].append(({k: v for k, v in match.items() if v is not None}, fn))
        return fn

    return put


def fire(event: str, **context: Any) -> list[Exception]:
    """Calls the hooks that match; an error in one doesn't stop the others."""
    errors = []
    for match, fn in _HOOKS[event]:
        if all(context.get(k) == v for k, v in match.items()):
            try:
                fn(**context)
            except Exception as e:  # a hook is foreign code; its failure is reported, not raised
                errors.append(e)
    return errors


def clear_hooks() -> None:
    for held in _HOOKS.values():
        held.clear()


def record_anomalies(df: DataFrame, path: str) -> None:
    df.filter("not ok").write.mode("append").json(path)


# The published combinations of stage methods, and their settings.
_ALL_S3 = ["wfa_expanding", "wfa_rolling", "cpcv", "bootstrap_ci", "monte_carlo", "sensitivity"]
_TIGHT = {"stop_grid": [0.0, 0.05, 0.08, 0.1, 0.15], "slope_grid": [0.0]}
_RSI = {"default_window": 14, "window_grid": [3, 5, 7, 10, 14, 21], "entry_grid": [15, 20, 25, 30, 35, 40, 45, 50], "exit_grid": [40, 45, 50, 55, 60, 65, 70, 75, 80], **_TIGHT}
_BREAK = {"use_s2_window": True, "entry_confs": [3, 4, 5, 6, 7], "exit_confs": [3, 4, 5, 6, 7], "stop_pcts": [0.0, 0.05, 0.1], "tx_cost_per_side": 0.001, "stop_slippage_bps": 5.0, "is_ratio": 0.7, "min_points": 4, "max_error_pct": 2.0, "min_period_days": 21, "atr_period": 14}
_OBV = {"use_s2_window": True, "tx_cost_per_side": 0.001, "stop_slippage_bps": 5.0, "is_ratio": 0.7, "atr_period": 14, "n_compare": 1}


def _preset(s1: str, signal: str, s2: str, s3: Any, s4: Any, s5: str | None, **config: Any) -> dict[str, Any]:
    return {"s1": s1, "signal": signal, "s2": s2, "s3": s3, "s4": s4, "s5": s5, "config": config}


PRESETS: dict[str, dict[str, Any]] = {
    "P-1": _preset("chan_halflife", "zscore_robust_mad", "grid_search", "chan_is_oos", "t_test", "equal_weight"),
    "P-3": _preset("chan_halflife", "zscore_robust_mad", "grid_search", "wfa_expanding", "wfe", "equal_weight"),
    "P-4": _preset("chan_halflife", "zscore_robust_mad", "grid_search", "bootstrap_ci", "carver_2sigma", "handcraft_carver"),
    "P-5": _preset("chan_halflife", "zscore_robust_mad", "grid_search", "monte_carlo", "carver_2sigma", "equal_weight"),
    "X-1": _preset("chan_combined", "zscore_robust_mad", "grid_search", "cpcv", "dsr", "handcraft_carver"),
    "X-2": _preset("chan_combined", "zscore_robust_mad", "grid_search", "wfa_expanding", "dsr", "hrp"),
    "X-4": _preset("chan_combined", "zscore_robust_mad", "grid_search", "monte_carlo", "carver_2sigma", "handcraft_carver"),
    "X-7": _preset("chan_combined", "zscore_robust_mad", "grid_search", "cpcv", "dsr", "half_kelly"),
    "X-11": _preset("chan_combined", "zscore_robust_mad", "grid_search", ["wfa_expanding", "cpcv"], ["dsr", "wfe"], "handcraft_carver"),
    "SIG-A": _preset("chan_combined", "zscore_robust_mad", "grid_search", "cpcv", "dsr", "handcraft_carver"),
    "SIG-B": _preset("chan_combined", "zscore_standard", "grid_search", "cpcv", "dsr", "handcraft_carver"),
    "SIG-C": _preset("chan_combined", "kalman_hedge", "grid_search", "cpcv", "dsr", "handcraft_carver"),
    "SIG-D": _preset("chan_combined", "bollinger", "grid_search", "wfa_rolling", "dsr", "handcraft_carver"),
    "TRE-1": _preset("passthrough", "ma_crossover", "grid_ma", "chan_is_oos", "t_test", "equal_weight"),
    "TRE-2": _preset("passthrough", "ma_crossover", "grid_ma", "wfa_expanding", "wfe", "equal_weight"),
    "TRE-3": _preset("passthrough", "ma_crossover", "grid_ma", "cpcv", "dsr", "handcraft_carver"),
    "ALT-RSI-S": _preset("passthrough", "rsi_simple", "grid_search", _ALL_S3, ["psr", "wfe", "t_test"], "dynamic_1k", **_RSI),
    "ALT-RSI-W": _preset("passthrough", "rsi_wilder", "grid_search", _ALL_S3, ["psr", "wfe", "t_test"], "dynamic_1k", **_RSI),
    "ALT-VAZ": _preset("chan_halflife", "vol_adaptive_zscore", "grid_search", _ALL_S3, ["psr", "wfe", "t_test"], "dynamic_1k", **_TIGHT),
    "ALT-ADX": _preset("chan_halflife", "adx_regime_gate", "grid_search", _ALL_S3, ["psr", "wfe", "t_test"], "dynamic_1k", **_TIGHT),
    "ALT-DON": _preset("passthrough", "donchian", "grid_search", _ALL_S3, ["psr", "wfe", "t_test"], "dynamic_1k", entry_grid=[15.0, 20.0, 30.0, 40.0, 55.0], exit_grid=[5.0, 10.0, 15.0, 20.0], stop_grid=[0.0], slope_grid=[0.0]),
    "ALT-ATR": _preset("passthrough", "atr_pullback", "grid_search", _ALL_S3, ["psr", "wfe", "t_test"], "dynamic_1k", entry_grid=[1.0, 1.5, 2.0, 2.5, 3.0], exit_grid=[0.0, 0.25, 0.5, 0.75], **_TIGHT),
    "ALT-VFG": _preset("chan_halflife", "vol_forecast_gate", "grid_search", _ALL_S3, ["psr", "wfe", "t_test"], "dynamic_1k", **_TIGHT),
    "ALT-HTD": _preset("chan_halflife", "halflife_time_decay", "grid_search", _ALL_S3, ["psr", "wfe", "t_test"], "dynamic_1k", **_TIGHT),
    "ALT-COINT": _preset("chan_halflife", "cointegration_spread", "grid_search", _ALL_S3, ["psr", "wfe", "t_test"], "dynamic_1k", **_TIGHT),
    "ALT-REG": _preset("passthrough", "regime_switch", "grid_search", _ALL_S3, ["psr", "wfe", "t_test"], "dynamic_1k", **_TIGHT),
    "RB-PROD": _preset("passthrough", "trendline_breakout", "grid_breakout", ["neighborhood", "bootstrap"], ["psr", "t_test", "dsr"], "dynamic_1k", **_BREAK),
    "OBV-PROD": _preset("passthrough", "obv_pivot", "grid_obv_pivot", None, None, None, **_OBV),
}
#: Published names of methods that go by another name here.
SAME = {"handcraft_carver": "handcraft", "neighborhood": "sensitivity", "bootstrap": "bootstrap_ci", "random_search": "optuna_tpe", "is_oos": "chan_is_oos"}


#: The signals of the optimisers that have their own.
OWN = {"grid_ma": ("ma_crossover", "ema_crossover", "dual_ma_crossover", "kama_crossover", "momentum"), "grid_regime": ("regime_switch",), "grid_breakout": ("trendline_breakout",), "grid_obv_pivot": ("obv_pivot",)}
OWN["optuna_ma"] = OWN["grid_ma"]
#: Grids of entry and exit on the scale of signals that aren't z-scores; given grids win over these.
GRIDS = {
    "rsi_simple": (_RSI["entry_grid"], _RSI["exit_grid"]), "rsi_wilder": (_RSI["entry_grid"], _RSI["exit_grid"]), "rsi_connors": ([10.0, 15.0, 20.0, 25.0, 30.0], [50.0, 55.0, 60.0, 65.0, 70.0]), "cum_rsi": ([20.0, 35.0, 50.0, 65.0], [55.0, 65.0, 75.0]),
    "donchian": ([15.0, 20.0, 30.0, 40.0, 55.0], [5.0, 10.0, 15.0, 20.0]), "donchian_midline": ([0.05, 0.1, 0.2, 0.3], [0.4, 0.5, 0.6, 0.8]), "atr_pullback": ([1.0, 1.5, 2.0, 2.5, 3.0], [0.0, 0.25, 0.5, 0.75]),
    "keltner": ([1.0, 1.5, 2.0, 2.5, 3.0], [-0.5, 0.0, 0.5, 1.0]), "sma_distance": ([-0.05, -0.03, -0.02, -0.01], [0.0, 0.01, 0.02]), "stochastic_k": ([10.0, 20.0, 30.0], [70.0, 80.0, 90.0]), "williams_r": ([-95.0, -90.0, -80.0, -70.0], [-30.0, -20.0, -10.0]),
    "consec_down": ([-0.01, -0.005, 0.0], [3.0, 5.0, 8.0, 10.0]), "nday_low": ([100.0, 150.0, 200.0], [5.0, 10.0, 15.0, 20.0]), "double_bottom": ([0.01, 0.02, 0.03, 0.05], [10.0, 20.0, 40.0]), "adx_ema_pullback": ([20.0, 25.0, 30.0, 35.0], [0.0]),
}


@dataclass
class Result:
    name: str
    stages: dict[str, DataFrame] = field(default_factory=dict)
    final: dict[str, DataFrame] = field(default_factory=dict)
    config: dict[str, Any] = field(default_factory=dict)
    seconds: float = 0.0
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Drops the stages' cached rows; the stages can still be read, from their sources."""
        for df in self.held:
            df.unpersist()


# The published defaults, and this library's own below them.
CONFIG = {
    "is_ratio": 0.8, "cost_per_side": 0.001, "slope_window": 2, "entry_grid": list(B.ENTRIES), "exit_grid": list(B.EXITS), "stop_grid": list(B.STOPS), "slope_grid": list(B.SLOPES), "cpcv_n_folds": 10, "cpcv_purge": 20, "cpcv_embargo": 5,
    "wfa_n_folds": 8, "wfa_rolling_is": 504, "wfa_rolling_oos": 180, "min_is_sharpe": 0.5, "min_oos_sharpe": 0.0, "min_is_trades": 5, "min_oos_trades": 5, "s3_min_oos_sharpe": 0.0, "sensitivity_pct": 0.2, "mc_iterations": 10_000, "bootstrap_iterations": 10_000,
    "t_stat_threshold": 2.0, "wfe_threshold": 0.5, "random_state": 42, "use_s2_window": False, "default_window": 20, "window_grid": None,
    "entry_confs": list(PT.CONFIRMATIONS), "exit_confs": list(PT.CONFIRMATIONS), "stop_pcts": list(PT.BREAK_STOPS), "tx_cost_per_side": 0.001, "stop_slippage_bps": 5.0, "min_points": 3, "max_error_pct": 0.1, "min_period_days": 30, "atr_period": 14, "n_compare": 1,
    "n_trials": 46.0, "optuna_trials": 50, "entry": None, "exit_": None, "stop": 0.0,
}
#: Other names of settings.
SETTING = {"fee": "cost_per_side", "window": "default_window", "n_folds": "wfa_n_folds", "is_days": "wfa_rolling_is", "oos_days": "wfa_rolling_oos"}
_S2_EMPTY = ("entry_thresh", "exit_thresh", "stop_pct", "slope_min", "is_sharpe", "is_penalized_sharpe", "is_trades", "oos_sharpe", "oos_trades")


def _list(x: str | list[str] | None) -> list[str]:
    return [] if x is None else [SAME.get(x, x)] if isinstance(x, str) else [SAME.get(v, v) for v in x]


def settings_of(given: dict[str, Any] | None) -> dict[str, Any]:
    """All settings; other names are brought to the published ones, unknown ones are an error."""
    named = {SETTING.get(k, k): v for k, v in (given or {}).items()}
    unknown = set(named) - set(CONFIG)
    if unknown:
        raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
    return CONFIG | named


class Pipeline:
    """Lazy stages: screens, optimiser, validators, significance tests, weights."""

    def __init__(self, s1: str = "chan_halflife", signal: str | None = None, s2: str = "grid_search", s3: str | list[str] | None = "wfa_expanding", s4: str | list[str] | None = "t_test", s5: str | None = "equal_weight", name: str = "pipeline", config: dict[str, Any] | None = None):
        """Without a ``signal`` it is the optimiser's own, or zscore_standard."""
        self.s1, self.s2, self.name, self.config = SAME.get(s1, s1), SAME.get(s2, s2), name, config or {}
        self.signal = signal or OWN.get(self.s2, ("zscore_standard",))[0]
        signal = self.signal
        self.s3, self.s4, self.s5 = _list(s3), _list(s4), SAME.get(s5, s5)
        for stage, chosen in (("s1", [self.s1]), ("s2", [self.s2]), ("s3", self.s3), ("s4", self.s4), ("s5", [self.s5] if self.s5 else [])):
            for m in chosen:
                method(stage, m)
        if signal not in signals.SIGNALS and signal not in ("trendline_breakout", "obv_pivot"):
            raise KeyError(f"no signal {signal!r}; there are {', '.join(sorted(signals.SIGNALS))}")
        if "wfe" in self.s4 and not any(v.startswith("wfa") for v in self.s3):
            raise ValueError("wfe needs a walk-forward validator")
        own = {v for names in OWN.values() for v in names} - {"regime_switch", *OWN["grid_ma"]}
        if signal not in OWN.get(self.s2, (signal,)) or (signal in own and self.s2 not in OWN):
            raise ValueError(f"{self.s2} and {signal} don't go together")
        if signal not in own and signal not in SG.SEGMENT_SIGNALS:
            raise ValueError(f"{signal} has no function of one stretch of bars; put one into segments.SEGMENT_SIGNALS")
        settings_of(self.config)

    def run(self, prices: DataFrame, pairs: DataFrame, config: dict[str, Any] | None = None, stop_after: str | None = None, benchmark: DataFrame | None = None, sectors: DataFrame | None = None, bars: DataFrame | None = None) -> Result:
        """``benchmark`` (ticker, ts, close) is needed by regime_aware; ``sectors`` (ticker, sector) groups the
        weights of handcraft; ``bars`` (ticker, ts, open, high, low, close, volume) feed break-outs and volume pivots."""
        began = time.time()
        given = self.config | (config or {})
        entries, exits = GRIDS.get(self.signal, (CONFIG["entry_grid"], CONFIG["exit_grid"]))
        c = settings_of({"entry_grid": entries, "exit_grid": exits} | given)
        if self.s1 == "regime_aware" and benchmark is None:
            raise ValueError("regime_aware needs a benchmark")
        if self.s2 in ("grid_breakout", "grid_obv_pivot") and bars is None:
            raise ValueError(f"{self.s2} needs bars")
        out, held = Result(self.name, config=c), []
        fire("pipeline_start", name=self.name)
        try:
            self._stages(out, held, prices, pairs, c, stop_after, benchmark, sectors, bars)
        except Exception as e:
            for df in held:
                df.unpersist()
            fire("stage_error", name=self.name, error=e)
            raise
        out.held = held
        out.seconds = time.time() - began
        fire("pipeline_end", name=self.name)
        return out

    def _stages(self, out: Result, held: list[DataFrame], prices: DataFrame, pairs: DataFrame, c: dict[str, Any], stop_after: str | None, benchmark: DataFrame | None, sectors: DataFrame | None, bars: DataFrame | None) -> None:
        legs = pairs.select("pair", "numerator", "denominator")

        def keep(stage: str, df: DataFrame) -> DataFrame:
            out.stages[stage] = df.persist()
            held.append(df)
            fire("stage_end", stage=stage)
            return df

        series = P.compute_ratio(prices, pairs)
        screen = method("s1", self.s1)
        s1 = screen(series, benchmark) if self.s1 == "regime_aware" else screen(series)
        for lacking in ("halflife", "window"):
            if lacking not in s1.columns:
                s1 = s1.withColumn(lacking, F.lit(None).cast("double"))
        s1 = keep("s1", s1.join(legs, "pair").withColumn("method", F.lit(self.s1)))
        if stop_after == "s1":
            return
        kept = series.join(s1.filter("passed").select("pair", F.when(F.col("window") > 0, F.col("window")).otherwise(F.lit(c["default_window"])).cast("double").alias("window")), "pair")
        s2 = keep("s2", self._optimise(kept, s1, legs, c, bars))
        if stop_after == "s2" or not self.s3:
            return
        best = s2.filter("passed").select("pair", "window", "entry_thresh", "exit_thresh", "stop_pct", "slope_min", "is_sharpe")
        live = kept.drop("window").join(best, "pair")
        parts = [self._validate(v, live, c, bars) for v in self.s3]
        s3 = keep("s3", reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).join(legs, "pair"))
        if stop_after == "s3" or not self.s4:
            return
        tests = {m: method("s4", m)(s3, **{"dsr": {"n_trials": c["n_trials"]}, "t_test": {"threshold": c["t_stat_threshold"]}, "wfe": {"threshold": c["wfe_threshold"]}}.get(m, {})) for m in self.s4}
        s4 = keep("s4", S.best_tier(tests).join(legs, "pair"))
        if stop_after == "s4" or not self.s5:
            return
        members = s4.filter("passed").select(F.col("numerator").alias("ticker"), "tier").dropDuplicates(["ticker"])
        members = members.withColumn("sector", F.lit("all")) if sectors is None else members.join(sectors.select("ticker", "sector"), "ticker", "left").fillna("none", ["sector"])
        returns = M.simple_returns(prices.filter("close is not null").select(F.col("ticker").alias("key"), "ts", F.col("close").alias("equity")))
        returns = returns.join(members.select(F.col("ticker").alias("key")), "key", "left_semi")
        fn = method("s5", self.s5)
        w = fn(members) if self.s5 in ("equal_weight", "tier_based", "dynamic_1k") else fn(returns) if self.s5 in ("risk_parity", "hrp") else fn(members, returns)
        out.final[self.s5] = w
        out.stages["s5"] = M.core(WT.combine(w, returns))

    def _optimise(self, series: DataFrame, s1: DataFrame, legs: DataFrame, c: dict[str, Any], bars: DataFrame | None) -> DataFrame:
        """The named optimiser's row per pair; settings it doesn't have are null."""
        half = s1.select("pair", F.col("halflife").cast("double").alias("halflife"))
        gate = {"least_is": c["min_is_sharpe"], "least_oos": c["min_oos_sharpe"], "least_trades": c["min_is_trades"]}
        if self.s2 == "grid_breakout":
            rows = _breakout_rows(bars, legs.join(series.select("pair").distinct(), "pair", "left_semi"))
            found = PT.grid_breakout(rows, tuple(c["entry_confs"]), tuple(c["exit_confs"]), tuple(c["stop_pcts"]), c["is_ratio"], cost=c["tx_cost_per_side"], slip=c["stop_slippage_bps"] / 1e4, full=False, least_points=c["min_points"], error_pct=c["max_error_pct"], least_period=c["min_period_days"], **gate)
            found = found.select("pair", F.col("entry_conf").cast("double").alias("entry_thresh"), F.col("exit_conf").cast("double").alias("exit_thresh"), "stop_pct", "is_sharpe", "is_penalized_sharpe", F.col("is_trades").cast("double").alias("is_trades"), "oos_sharpe", F.col("oos_trades").cast("double").alias("oos_trades"), "passed")
        elif self.s2 == "grid_obv_pivot":
            names = series.select("pair").distinct().join(legs, "pair").select("pair", F.col("numerator").alias("ticker"))
            grid = PT.grid_obv_pivot(bars.join(names.select("ticker").distinct(), "ticker", "left_semi"), c["is_ratio"], c["tx_cost_per_side"], c["stop_slippage_bps"] / 1e4, n_compare=c["n_compare"])
            order = W.partitionBy("ticker").orderBy(F.col("is_sharpe").desc(), "method", "method_param", "mapping", "stop_type")
            top = grid.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
            found = names.join(top, "ticker").select("pair", "is_sharpe", F.col("is_trades").cast("double").alias("is_trades"), "oos_sharpe", F.col("oos_trades").cast("double").alias("oos_trades"), "passed")
        elif self.s2 in ("grid_ma", "optuna_ma"):
            kind = {"ema_crossover": "ema", "dual_ma_crossover": "dual", "kama_crossover": "kama", "momentum": "momentum"}.get(self.signal, "sma")
            found = (B.grid_ma(series, kind, is_ratio=c["is_ratio"]) if self.s2 == "grid_ma" else B.optuna_ma(series, kind, c["optuna_trials"], c["random_state"], is_ratio=c["is_ratio"]))
            found = found.select("pair", F.col("window").cast("double").alias("window"), "is_sharpe", "oos_sharpe", "passed")
        else:
            options = {"signal": self.signal, "entries": c["entry_grid"], "exits": c["exit_grid"], "stops": c["stop_grid"], "slopes": c["slope_grid"], "windows": c["window_grid"], "is_ratio": c["is_ratio"], "fee": c["cost_per_side"], "least_oos_trades": c["min_oos_trades"], **gate}
            if self.s2 == "grid_regime":
                options.pop("signal")
            if self.s2 == "optuna_tpe":
                options |= {"trials": c["optuna_trials"], "seed": c["random_state"]}
            found = method("s2", self.s2)(series, **options)
        for lacking in ("window", *_S2_EMPTY):
            if lacking not in found.columns:
                found = found.withColumn(lacking, F.lit(None).cast("double"))
        found = found.select("pair", "window", *_S2_EMPTY, "passed")
        return found.join(half, "pair").join(legs, "pair").withColumn("signal_method", F.lit(self.signal)).withColumn("optim_method", F.lit(self.s2))

    def _validate(self, name: str, live: DataFrame, c: dict[str, Any], bars: DataFrame | None) -> DataFrame:
        """One validator over the settings that S2 chose for each pair: the bars themselves with the signal as a
        function of a stretch, or for break-outs the returns of each pair's own combination, cut into parts."""
        signal, rows = self.signal, live
        if signal == "trendline_breakout":
            chosen = live.select("pair", "entry_thresh", "exit_thresh", "stop_pct", "is_sharpe").distinct()
            walked = _breakout_rows(bars, chosen.select("pair").join(bars_pairs(bars), "pair"))
            lines = {"cost": c["tx_cost_per_side"], "slip": c["stop_slippage_bps"] / 1e4, "least_points": c["min_points"], "error_pct": c["max_error_pct"], "least_period": c["min_period_days"]}
            if name == "sensitivity":
                return PT.breakout_sensitivity(walked, chosen, V.VALIDATED, c["is_ratio"], c["sensitivity_pct"], least=c["s3_min_oos_sharpe"], **lines)
            signal, rows = None, PT.breakout_returns(walked, chosen, **lines).join(chosen.select("pair", "is_sharpe"), "pair")
        defaults = {k: c[k] for k in ("entry", "exit_") if c[k] is not None} | {"window": c["default_window"], "slope_window": c["slope_window"]}
        common = {"signal": signal, "fee": c["cost_per_side"], **defaults}
        least = {"least": c["s3_min_oos_sharpe"]}
        fixed = {"fixed": c["use_s2_window"] or self.s2 in ("grid_ma", "optuna_ma")}
        if name == "wfa_expanding":
            return V.wfa_expanding(rows, n_folds=c["wfa_n_folds"], **common, **least, **fixed)
        if name == "wfa_rolling":
            return V.wfa_rolling(rows, is_days=c["wfa_rolling_is"], oos_days=c["wfa_rolling_oos"], **common, **least, **fixed)
        if name == "chan_is_oos":
            return V.chan_is_oos(rows, is_ratio=c["is_ratio"], **common, **least, **fixed)
        if name == "cpcv":
            return V.cpcv(rows, n_folds=c["cpcv_n_folds"], purge=c["cpcv_purge"], embargo=c["cpcv_embargo"], **common, **least, **fixed)
        if name == "sensitivity":
            return V.sensitivity(rows, is_ratio=c["is_ratio"], shift=c["sensitivity_pct"], **common, **least)
        later = V.out_of_sample(rows, is_ratio=c["is_ratio"], **common)
        got = V.bootstrap_ci(later, iterations=c["bootstrap_iterations"], seed=c["random_state"]) if name == "bootstrap_ci" else V.monte_carlo(later, iterations=c["mc_iterations"], seed=c["random_state"])
        spread = {"std_test_sharpe": F.coalesce((F.col("ci_upper") - F.col("ci_lower")) / 3.92, F.lit(0.0)) if name == "bootstrap_ci" else F.lit(0.0), "n_test_periods": F.lit(1).cast("long"), "baseline_sharpe": F.lit(None).cast("double"), "degradation": F.lit(None).cast("double"), "wfe": F.lit(None).cast("double"), "val_method": F.lit(name)}
        return got.withColumns({k: v for k, v in spread.items() if k not in got.columns})


def bars_pairs(bars: DataFrame) -> DataFrame:
    return P.universe(bars)


def _breakout_rows(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, ts, high, low, close, num_close) of the ratio's bars."""
    num = bars.select(F.col("ticker").alias("numerator"), "ts", F.col("close").alias("num_close"))
    return P.ratio_ohlc(bars, pairs).join(pairs.select("pair", "numerator"), "pair").join(num, ["numerator", "ts"]).select("pair", "ts", "high", "low", "close", "num_close")


def compare(pipelines: list[Pipeline], prices: DataFrame, pairs: DataFrame, config: dict[str, Any] | None = None) -> dict[str, Result]:
    """Several pipelines on one persisted panel; the results release it with their own rows."""
    held = prices.persist()
    out = {p.name: p.run(held, pairs, config) for p in pipelines}
    for result in out.values():
        result.held.append(held)
    return out


# Tiers from best to worst, and what a portfolio makes of them.
TIER_ORDER = ("TOP_TIER", "SECOND_TIER", "LAST_TIER", "REJECT")
PORTFOLIO = {"TOP_TIER": "GOOD", "SECOND_TIER": "GOOD", "LAST_TIER": "MARGINAL"}


def tier_rank(tier: Column) -> Column:
    """0 is best; an unknown tier is a REJECT."""
    at = F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), tier)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(F.lit(len(TIER_ORDER) - 1)).cast("int")


def downgraded(tier: Column) -> Column:
    """The next worse tier; REJECT stays."""
    return F.element_at(F.array(*[F.lit(t) for t in TIER_ORDER]), F.least(tier_rank(tier) + 2, F.lit(len(TIER_ORDER))))


MODES = ("strictest", "agreement", "any_pass")


def resolve_validators(s3: DataFrame, mode: str = "strictest", methods: list[str] | None = None) -> DataFrame:
    """Several validation rows a pair to one.

    strictest: all must pass; the lowest Sharpe and the highest degradation count then. any_pass: one must, and its best
    one counts. agreement: CONFIRMED (all, the lowest counts), FRAGILE_EDGE (some, the best that passes counts) or
    REJECT. A pair that doesn't pass keeps its best row's numbers. Each validator's own Sharpe is a column
    ``sharpe_{method}``; ``methods`` names them, else they are read from the rows.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
    names = methods or sorted(r[0] for r in s3.select("val_method").distinct().collect())  # a row for each validator
    x, passes = F.col("mean_test_sharpe"), F.coalesce(F.col("passed"), F.lit(False))
    best = lambda c, where: F.max_by(c, F.when(where, F.struct(x, F.hash("val_method"))))
    g = s3.groupBy("pair").agg(
        F.count("*").alias("n_methods"), F.count_if(passes).alias("n_methods_passed"), F.array_join(F.array_sort(F.collect_list("val_method")), ",").alias("val_methods"),
        F.min(x).alias("_low"), F.max("degradation").alias("_worst"), best(x, F.lit(True)).alias("_any"), best(F.col("degradation"), F.lit(True)).alias("_any_d"), best(x, passes).alias("_good"), best(F.col("degradation"), passes).alias("_good_d"),
        *[F.max(F.when(F.col("val_method") == m, x)).alias(f"sharpe_{m}") for m in names],
    )
    every, some = F.col("n_methods_passed") == F.col("n_methods"), F.col("n_methods_passed") > 0
    lowest = (every, "_low", "_worst") if mode != "any_pass" else (F.lit(False), "_low", "_worst")
    good = some if mode != "strictest" else F.lit(False)
    pick = lambda i: F.when(lowest[0], F.col(lowest[i])).when(good, F.col(("_good", "_good_d")[i - 1])).otherwise(F.col(("_any", "_any_d")[i - 1]))
    verdict = [F.when(every, "CONFIRMED").when(some, "FRAGILE_EDGE").otherwise("REJECT").alias("agreement")] if mode == "agreement" else []
    return g.select("pair", (every if mode == "strictest" else some).alias("passed"), pick(1).alias("sharpe"), pick(2).alias("degradation"), "n_methods", "n_methods_passed", "val_methods", *verdict, *[f"sharpe_{m}" for m in names])


def bridge(s2: DataFrame, s3: DataFrame, s4: DataFrame, mode: str = "strictest", one_per_numerator: bool = True) -> DataFrame:
    """Portfolio candidates: validation, the best optimiser row that passed, the tier (one lower for a FRAGILE_EDGE), and
    what a portfolio makes of it; the best by Sharpe of each numerator is selected."""
    best = B.best_first(s2.filter("passed").withColumn("_i", F.lit(0)), "pair", "oos_sharpe", "_i").drop("_i", "passed")
    out = resolve_validators(s3, mode).join(best, "pair", "left").join(s4.filter("passed").select("pair", "tier"), "pair")
    if mode == "agreement":
        out = out.withColumn("tier", F.when(F.col("agreement") == "FRAGILE_EDGE", downgraded(F.col("tier"))).otherwise(F.col("tier")))
    kind = F.create_map(*[F.lit(v) for item in PORTFOLIO.items() for v in item])
    out = out.withColumn("portfolio_tier", F.coalesce(kind[F.col("tier")], F.lit("REJECT")))
    w = W.partitionBy("numerator").orderBy(F.col("sharpe").desc(), "pair")
    return out.withColumn("selected", (F.row_number().over(w) == 1) if one_per_numerator else F.lit(True))


def report(result: Result, rows: int = 20) -> str:
    """A plain page: rows, passed rows and the first rows of each stage."""
    parts = []
    for name, df in result.stages.items():
        n = df.count()
        ok = df.filter("passed").count() if "passed" in df.columns else n
        parts.append(f"<h2>{name}</h2><p>{n} rows, {ok} passed</p>{df.limit(rows).toPandas().to_html(index=False)}")
    return f"<html><body><h1>{result.name}</h1>{''.join(parts)}<pre>{json.dumps(result.config)}</pre></body></html>"
