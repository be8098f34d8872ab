"""Cash-aware portfolio replay: schemes x sizing rules, one task each, over a date-ordered panel.

The walk is sequential in time, so its unit of parallelism is the scheme. Prices come in as date x
ticker matrices; per date all names are handled by array operations, and only exits and entries,
which are few, are handled one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Share of the cash that is spent, cost and slippage a side, cap a name, deepest drawdown of the throttle, commission.
BUFFER, COST, SLIP = 0.95, 0.001, 0.0005
CAP, DD_TOL, COMMISSION = 0.20, 0.25, "ibkr_pro_fixed"
SIZING = ("netliq_clip", "cash_fraction", "cash_fraction_capped", "cash_fraction_seq_capped", "paleologo_strict")
DEFAULT_LEG_PRICE = 50.0


def commission(shares: float, notional: float, model: str = COMMISSION, flat: float = COST, is_ratio: bool = False, leg_price: float = 0.0) -> float:
    """Cost of one side. Ratio positions are charged on the shares of their legs."""
    if is_ratio and model.startswith("ibkr"):
        shares = notional / (leg_price if leg_price > 0 else DEFAULT_LEG_PRICE)
    if model == "flat_10bps":
        return notional * flat
    if model == "ibkr_pro_fixed":
        return min(max(1.0, 0.005 * shares), 0.01 * notional)
    if model == "ibkr_pro_tiered":
        return min(max(0.35, 0.0035 * shares) + 0.0008 * shares, 0.01 * notional)
    if model == "ibkr_lite":
        return 0.0
    raise ValueError(f"no commission model {model!r}")


def commission_column(shares: Column, notional: Column, model: str, flat: float = COST) -> Column:
    if model == "flat_10bps":
        return notional * flat
    if model == "ibkr_pro_fixed":
        return F.least(F.greatest(F.lit(1.0), 0.005 * shares), 0.01 * notional)
    if model == "ibkr_pro_tiered":
        return F.least(F.greatest(F.lit(0.35), 0.0035 * shares) + 0.0008 * shares, 0.01 * notional)
    return F.lit(0.0)


def live_shares(weight: Column, price: Column, cash: Column, action: Column, buffer: float = BUFFER, slip: float = SLIP, cost: float = COST) -> Column:
    """Whole shares of an entry: weight x cash x buffer over the price with slippage and cost."""
    n = F.floor(weight * cash * buffer / F.nullif(price * (1 + slip) * (1 + cost), F.lit(0.0)))
    return F.when(action == "enter", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))).otherwise(F.lit(0)).cast("long")


# The published scheme names, by family.
STATIC = {"equal_weight": "equal", "sharpe_weighted": "sharpe", "inverse_vol": "invvol", "hrp": "hrp"}
DYNAMIC = {"equal_dyn": "equal", "sharpe_wt_dyn": "sharpe", "inv_vol_dyn": "invvol", "hrp": "hrp"}
ROLLING = ("sr", "iv", "sortino", "calmar", "mom", "er")
CAPS = ("05", "10", "20", "30", "50")
RULE_TAGS = {"cf": "cash_fraction", "cfc": "cash_fraction_capped", "seq": "cash_fraction_seq_capped", "plg": "paleologo_strict"}


def scheme_names() -> list[str]:
    """All 59: four static, equal shares of the active names, weighted bases and rolling scores, each with five caps."""
    families = ["flat_1k", *DYNAMIC, *(f"roll_{r}" for r in ROLLING)]
    return [*STATIC, *(f"{f}_cap{c}" for f in families for c in CAPS)]


@dataclass
class Scheme:
    """``family``: static, flat, dynamic or rolling; ``base``: whose weights or scores; ``cap``: of a name, or None."""

    name: str
    rule: str
    family: str
    base: str
    cap: float | None


def parse_scheme(name: str, rule: str = "cash_fraction_seq_capped") -> Scheme:
    """A scheme's name, perhaps with a sizing rule before two underscores and ``conv_`` for a caller's own oracle."""
    if re.search(r"_top\d+$", name):
        raise ValueError(f"{name!r}: top-N schemes are not supported")
    tag, _, rest = name.partition("__")
    if rest:
        if tag not in RULE_TAGS:
            raise ValueError(f"{name!r}: no sizing rule {tag!r}; there are {', '.join(RULE_TAGS)}")
        rule = RULE_TAGS[tag]
    plain = (rest or name).removeprefix("conv_")
    if plain in STATIC:
        return Scheme(name, rule, "static", STATIC[plain], None)
    m = re.fullmatch(r"(.+)_cap(\d\d)", plain)
    if m:
        cap = int(m[2]) / 100
        if m[1] == "flat_1k":
            return Scheme(name, rule, "flat", "equal", cap)
        if m[1] in DYNAMIC:
            return Scheme(name, rule, "dynamic", DYNAMIC[m[1]], cap)
        if m[1].removeprefix("roll_") in ROLLING and m[1].startswith("roll_"):
            return Scheme(name, rule, "rolling", m[1].removeprefix("roll_"), cap)
    raise ValueError(f"no scheme {name!r}")


def strip_rule(scheme: Column) -> Column:
    return F.regexp_replace(scheme, "^(cf|cfc|seq|plg)__", "")


def filter_schemes(names: list[str], cap: str | None = None, wanted: list[str] | None = None) -> list[str]:
    """By list, and by cap suffix; static schemes always stay."""
    out = [n for n in names if wanted is None or n in wanted]
    return out if cap is None else [n for n in out if parse_scheme(n).family == "static" or n.endswith(f"_cap{cap}")]


def renorm_cap(w: np.ndarray, cap: float | None) -> np.ndarray:
    """To a sum of one, cut at the cap, and to a sum of one again; all alike if no weight is above 0."""
    total = w.sum()
    if total <= 0:
        return np.full(len(w), 1 / max(len(w), 1))
    w = w / total
    if cap:
        w = np.minimum(w, cap)
        w = w / w.sum()
    return w


@dataclass
class Panel:
    """Dates x tickers; NaN where a ticker has no bar."""

    dates: np.ndarray
    tickers: list[str]
    close: np.ndarray
    low: np.ndarray
    atr: np.ndarray
    raw: np.ndarray
    stop_code: np.ndarray  # 0 none, 1 percent, 2 ATR trail
    stop_param: np.ndarray
    is_ratio: np.ndarray
    leg_price: np.ndarray
    scores: dict[str, np.ndarray] = field(default_factory=dict)  # family -> dates x tickers, last value strictly before each date


Oracle = Callable[[np.ndarray, int], np.ndarray]


def oracle_for(panel: Panel, scheme: Scheme, base: dict[str, np.ndarray]) -> Oracle:
    """Weights of the active names (indices) on a date: a static base, or the last score before it."""

    def weights(active: np.ndarray, t: int) -> np.ndarray:
        if scheme.family == "rolling":
            w = np.clip(np.nan_to_num(panel.scores[scheme.base][t, active]), 0, None)
        elif scheme.family == "flat":
            w = np.ones(len(active))
        else:
            w = base[scheme.base][active]
        return renorm_cap(w, scheme.cap)

    return weights


def walk(panel: Panel, weights: Oracle, seed: float = 100_000.0, rule: str = "cash_fraction_seq_capped", buffer: float = BUFFER, cost: float = COST, slip: float = SLIP, cap: float = CAP, dd_tol: float = DD_TOL, model: str = COMMISSION) -> dict:
    """One replay. Per date: exits (stop, then signal), entries on 0 to 1 by weight, snapshot.

    The dollars of an entry, with w its weight and c = max(0, cash x buffer): netliq_clip min(w x net value, c);
    cash_fraction w x c of the date's start; cash_fraction_capped min(w, cap) x that; paleologo_strict the same
    times max(0, 1 - drawdown / dd_tol); cash_fraction_seq_capped min(w, cap) x c of the cash that is left.
    """
    if rule not in SIZING:
        raise ValueError(f"no sizing rule {rule!r}")
    n_dates, n = panel.close.shape
    cash, peak = float(seed), float(seed)
    shares = np.zeros(n, dtype=np.int64)
    entry = np.zeros(n)
    trail = np.full(n, -np.inf)
    began = np.full(n, -1)
    best, worst = np.zeros(n), np.zeros(n)
    of_cash, of_nav = np.zeros(n), np.zeros(n)
    trades, failed, days = [], [], []
    bound = entered = 0
    plain = model == "flat_10bps"

    def fee(k: float, notional: float, i: int) -> float:
        return notional * cost if plain else commission(k, notional, model, cost, bool(panel.is_ratio[i]), float(panel.leg_price[i]))

    def leave(i: int, t: int, price: float, why: str) -> None:
        nonlocal cash
        k = int(shares[i])
        charge = fee(k, k * price, i)
        cash += k * price - charge
        trades.append((panel.tickers[i], panel.dates[began[i]], panel.dates[t], float(entry[i]), float(price), k, float(price / entry[i] - 1), float(k * (price - entry[i]) - charge), why, float(worst[i]), float(best[i]), int(t - began[i]), float(of_cash[i]), float(of_nav[i]), float(charge)))
        shares[i] = 0

    traded = np.isfinite(panel.close)
    # Names that turn from 0 to 1, date by date.
    turning = np.zeros(panel.raw.shape, dtype=bool)
    turning[1:] = (panel.raw[1:] == 1) & (panel.raw[:-1] == 0) & traded[1:]
    for t in range(n_dates):
        close, low, here = panel.close[t], panel.low[t], traded[t]
        holding = np.flatnonzero(shares)
        on = holding[here[holding]]
        if len(on):
            best[on] = np.maximum(best[on], close[on] / entry[on] - 1)
            worst[on] = np.minimum(worst[on], low[on] / entry[on] - 1)
            code, p = panel.stop_code[on], panel.stop_param[on]
            floor = entry[on] * (1 - p)
            cut = (code == 1) & (p > 0) & (low[on] <= floor)
            atr = panel.atr[t, on]
            trailing = (code == 2) & (p > 0) & (atr == atr)
            trail[on] = np.where(trailing, np.fmax(trail[on], close[on] - p * atr), trail[on])
            fell = trailing & (close[on] <= trail[on])
            gone = ~cut & ~fell & (panel.raw[t, on] == 0)
            for j in np.flatnonzero(cut | fell | gone):
                i = on[j]
                if cut[j]:
                    leave(i, t, floor[j] * (1 - slip), "stop_pct")
                elif fell[j]:
                    leave(i, t, trail[i] * (1 - slip), "stop_atr")
                else:
                    leave(i, t, close[i] * (1 - slip), "signal")
        fresh = np.flatnonzero(turning[t] & (shares == 0))
        if len(fresh):
            held = np.flatnonzero(shares)
            active = np.concatenate([held, fresh])
            w = np.zeros(n)
            w[active] = weights(active, t)
            nav = cash + float((shares[held] * np.where(here[held], close[held], 0.0)).sum())
            peak = max(peak, nav)
            throttle = max(0.0, 1 - (1 - nav / peak) / dd_tol) if rule == "paleologo_strict" and dd_tol > 0 else 1.0
            pool = max(0.0, cash * buffer)
            for i in fresh[np.argsort(-w[fresh], kind="stable")]:
                if w[i] <= 0:
                    continue
                entered += 1
                capped = min(w[i], cap)
                if rule == "netliq_clip":
                    target = min(w[i] * nav, max(0.0, cash * buffer))
                elif rule == "cash_fraction":
                    target = w[i] * pool
                else:
                    bound += capped < w[i] - 1e-12
                    target = capped * (pool if rule == "cash_fraction_capped" else pool * throttle if rule == "paleologo_strict" else max(0.0, cash * buffer))
                price = close[i] * (1 + slip)
                k = int(target / (price * (1 + cost))) if price > 0 else 0
                if k <= 0:
                    failed.append((panel.tickers[i], panel.dates[t], float(target), "no_cash" if rule == "netliq_clip" and cash * buffer <= price else "too_small"))
                    continue
                charge = fee(k, k * price, i)
                if k * price + charge > cash:
                    k -= 1
                    charge = fee(k, k * price, i)
                    if k <= 0 or k * price + charge > cash:
                        failed.append((panel.tickers[i], panel.dates[t], float(target), "no_cash"))
                        continue
                of_cash[i], of_nav[i] = 100 * k * price / cash, 100 * k * price / nav if nav > 0 else 0.0
                cash -= k * price + charge
                shares[i], entry[i], began[i] = k, price, t
                trail[i], best[i], worst[i] = -np.inf, 0.0, 0.0
        held = np.flatnonzero(shares)
        value = np.where(here[held], close[held], entry[held]) * shares[held]
        nav = cash + float(value.sum())
        peak = max(peak, nav)
        wt = value / nav if nav > 0 else np.zeros(len(held))
        days.append((panel.dates[t], nav, cash, len(held), nav / peak - 1, float((wt * wt).sum())))
    for i in np.flatnonzero(shares):
        last = np.flatnonzero(traded[:, i])
        leave(i, n_dates - 1, panel.close[last[-1], i] * (1 - slip), "force_eow")
    if days:
        days[-1] = (days[-1][0], cash, cash, 0, cash / max(peak, cash) - 1, 0.0)
    return {"trades": trades, "failed": failed, "days": days, "n_entries_total": entered, "n_cap_bound": int(bound)}


def panel_of(rows: pd.DataFrame, scores: bool = True, look: int = 126) -> Panel:
    """A panel from long rows (ticker, ts, close, low, atr, pos_raw, stop_code, stop_param)."""
    wide = {c: rows.pivot_table(index="ts", columns="ticker", values=c, aggfunc="first", dropna=False) for c in ("close", "low", "atr", "pos_raw")}
    close = wide["close"]
    one = rows.groupby("ticker").first().reindex(close.columns)
    get = lambda c, d: one[c].to_numpy() if c in one else np.full(len(one), d)
    p = Panel(close.index.to_numpy(), list(close.columns), close.to_numpy(float), wide["low"].to_numpy(float), wide["atr"].to_numpy(float), wide["pos_raw"].fillna(0).to_numpy(int), get("stop_code", 0), get("stop_param", 0.0), get("is_ratio", False), get("leg_price", 0.0))
    if scores:
        r = close.pct_change(fill_method=None)
        m, sd = r.rolling(look, min_periods=20).mean(), r.rolling(look, min_periods=20).std()
        down = r.where(r < 0).rolling(look, min_periods=5).std()
        mom = close / close.shift(look) - 1
        dd = (close / close.rolling(look, min_periods=20).max() - 1).rolling(look, min_periods=20).min().abs()
        path = close.diff().abs().rolling(look, min_periods=20).sum()
        table = {"sr": m / sd, "iv": 1 / sd, "sortino": m / down, "calmar": m * 252 / dd, "mom": mom, "er": close.diff(look).abs() / path}
        p.scores = {k: v.replace([np.inf, -np.inf], np.nan).shift(1).ffill().to_numpy(float) for k, v in table.items()}
    return p


def static_bases(p: Panel) -> dict[str, np.ndarray]:
    from .weights import hrp_weights

    r = pd.DataFrame(p.close).pct_change(fill_method=None)
    sd = r.std().to_numpy()
    sr = np.nan_to_num(r.mean().to_numpy() / np.where(sd > 0, sd, np.nan))
    iv = 1 / np.where(sd > 0, sd, np.nan)
    iv = np.where(np.isfinite(iv), iv, np.nanmedian(iv) if np.isfinite(iv).any() else 1.0)
    n = len(p.tickers)
    equal = np.full(n, 1 / max(n, 1))
    full = r.dropna()
    hrp = hrp_weights(np.nan_to_num(full.cov().to_numpy()), np.nan_to_num(full.corr().to_numpy())) if len(full) >= 100 else equal
    return {"equal": equal, "sharpe": np.clip(sr, 0, None), "invvol": iv, "hrp": hrp}


DAYS = "scheme string, ts date, nav double, cash double, n_held int, drawdown double, hhi double"
TRADES = "scheme string, ticker string, entry_date date, exit_date date, entry_price double, exit_price double, shares long, pnl_pct double, pnl_dollars double, exit_reason string, mae double, mfe double, bars_held int, entry_pct_cash double, entry_pct_nav double, commission double"
COUNTS = "scheme string, n_trades long, n_failed_entries long, n_too_small long, n_entries_total long, n_cap_bound long, max_entry_pct_cash double, p95_entry_pct_cash double, max_entry_pct_nav double"
#: Cells, names x dates, of the largest panel that goes to every task.
MOST_CELLS = 20_000_000


def _counts(got: dict) -> tuple:
    cash, nav = [x[12] for x in got["trades"]], [x[13] for x in got["trades"]]
    top = (float(max(cash)), float(np.percentile(cash, 95)), float(max(nav))) if cash else (None, None, None)
    why = [f[3] for f in got["failed"]]
    return len(got["trades"]), why.count("no_cash"), why.count("too_small"), got["n_entries_total"], got["n_cap_bound"], *top


def run_schemes(cache: DataFrame, schemes: list[str], seed: float = 100_000.0, output: str = "days", oracle: Callable[[Panel, Scheme], Oracle] | None = None, most_cells: int = MOST_CELLS, cap: float = CAP, **rules) -> DataFrame:
    """Every scheme over the same rows, a task for each. ``output``: days, trades or counts.

    A scheme's cap is that of its name, else ``cap``. The panel is one portfolio's history: names x dates,
    counted before anything is sent. Up to ``most_cells`` it is broadcast; a larger one is dealt to the
    schemes' tasks as rows, one copy for each scheme, and never passes through the driver.
    """
    spark = cache.sparkSession
    columns = [c for c in ("ticker", "ts", "close", "low", "atr", "pos_raw", "stop_code", "stop_param", "is_ratio", "leg_price") if c in cache.columns]
    schema = {"days": DAYS, "trades": TRADES, "counts": COUNTS}[output]
    rows = cache.select(*columns)

    def replay(panel: Panel, base: dict, name: str) -> pd.DataFrame:
        s = parse_scheme(name)
        limits = {"rule": s.rule, "cap": s.cap if s.cap is not None else cap} | rules
        got = walk(panel, oracle(panel, s) if oracle else oracle_for(panel, s, base), seed, **limits)
        lines = [_counts(got)] if output == "counts" else got[output]
        return pd.DataFrame([(name, *d) for d in lines], columns=[c.split()[0] for c in schema.split(", ")])

    names = spark.createDataFrame([(s,) for s in schemes], "scheme string")
    if rows.count() <= most_cells:
        held = spark.sparkContext.broadcast(rows.toPandas())

        def go(batches):
            panel = base = None
            for batch in batches:
                for name in batch["scheme"]:
                    if panel is None:
                        panel = panel_of(held.value)
                        base = static_bases(panel)
                    yield replay(panel, base, name)

        return names.repartition(max(1, len(schemes)), "scheme").mapInPandas(go, schema)

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        panel = panel_of(group.drop(columns="scheme"))
        return replay(panel, static_bases(panel), key[0])

    copies = rows.withColumn("scheme", F.explode(F.array(*[F.lit(s) for s in schemes])))
    return copies.groupBy("scheme").applyInPandas(one, schema)


def summary_rows(days: DataFrame, counts: DataFrame, bench: DataFrame, start: str, seed: float = 100_000.0, name: str = "SPY") -> DataFrame:
    """A row for each scheme, and one for the benchmark (ts, equity): metrics from ``start`` on and of the
    whole period, against the benchmark, and of the execution."""
    from . import metrics as M

    curve = days.select(F.col("scheme").alias("key"), "ts", F.col("nav").alias("equity"))
    both = curve.unionByName(bench.select(F.lit(name).alias("key"), "ts", "equity"))
    late = M.rebase(both, start, seed)
    after = F.col("ts") >= F.lit(start).cast("date")
    parts = []
    for prefix, c in (("oos", late), ("full", both)):
        last = c.groupBy("key").agg(F.max_by("equity", "ts").alias("end_value"))
        m = M.equity_metrics(M.simple_returns(c)).join(last, "key")
        names = {"sharpe": "sharpe", "cagr": "cagr", "max_dd": "max_dd", "calmar": "calmar", "sortino": "sortino", "ulcer": "ulcer", "martin": "martin", "volatility": "vol_ann", "win_rate": "hit_rate", "skew": "skew", "kurtosis": "kurtosis", "max_dd_run": "dd_dur_days", "pct_invested": "pct_invested"}
        end = "oos_end_value" if prefix == "oos" else "end_value"
        parts.append(m.select("key", *[F.col(k).alias(f"{prefix}_{v}") for k, v in names.items()], F.col("end_value").alias(end)))
    returns = M.simple_returns(curve.filter(after))
    against = M.vs_benchmark(returns, M.simple_returns(bench.filter(after).select(F.lit(name).alias("key"), "ts", "equity")))
    against = against.select("key", F.col("information_ratio").alias("ir_vs_spy"), F.col("alpha").alias("alpha_ann"), "beta", F.col("correlation").alias("corr_spy"), "tracking_error", "up_capture", "down_capture", "excess_cagr")
    held = concentration(days).withColumnsRenamed({"scheme": "key", "hhi_mean": "mean_hhi", "hhi_max": "max_hhi", "enb_mean": "mean_enb"}).withColumn("min_enb", 1 / F.col("max_hhi")).drop("hhi_min")
    made = counts.withColumnRenamed("scheme", "key").withColumn("cap_bound_rate", F.col("n_cap_bound") / F.nullif(F.col("n_entries_total"), F.lit(0)))
    out = parts[0].join(parts[1], "key").join(against, "key", "left").join(made, "key", "left").join(held, "key", "left")
    # The benchmark against itself.
    own = {"ir_vs_spy": 0.0, "alpha_ann": 0.0, "beta": 1.0, "corr_spy": 1.0, "tracking_error": 0.0, "up_capture": 1.0, "down_capture": 1.0, "excess_cagr": 0.0}
    for k, v in own.items():
        out = out.withColumn(k, F.when(F.col("key") == name, F.lit(v)).otherwise(F.col(k)))
    return out.withColumnRenamed("key", "scheme")


def beat_benchmark(summary: DataFrame, name: str = "SPY", most: int | None = None) -> DataFrame:
    """(scheme, oos_sharpe, beats): the schemes with a higher Sharpe and end value than the benchmark and a
    positive information ratio, best Sharpe first; if there are none, or no benchmark, all of them. ``most``: of those so many."""
    bench = summary.filter(F.col("scheme") == name).select(F.col("oos_sharpe").alias("b_sharpe"), F.col("oos_end_value").alias("b_end"))
    rows = summary.filter(F.col("scheme") != name).join(F.broadcast(bench), F.lit(True), "left")  # one row
    beats = F.coalesce((F.col("oos_sharpe") > F.col("b_sharpe")) & (F.col("ir_vs_spy") > 0) & (F.col("oos_end_value") > F.col("b_end")), F.lit(False))
    rows = rows.withColumn("beats", beats).select("scheme", "oos_sharpe", "beats")
    some = rows.agg(F.max("beats").alias("some")).select(F.coalesce("some", F.lit(False)).alias("some"))
    out = rows.join(F.broadcast(some), (F.col("beats") == F.col("some"))).select("scheme", "oos_sharpe", "beats").orderBy(F.col("oos_sharpe").desc_nulls_last(), "scheme")
    return out if most is None else out.limit(most)


def collapse_equal(hashes: DataFrame, deployed: str | None = None) -> DataFrame:
    """(scheme, n_aliases, aliases) from (scheme, curve_hash): schemes with one curve become one row, named
    by the deployed scheme, else one without a cap, a shorter name, a lower cap, the first in order. A null hash is unique."""
    plain = strip_rule(F.col("scheme"))
    capped = plain.contains("_cap")
    cap = F.when(capped & F.substring(plain, -2, 2).rlike("^[0-9]{2}$"), F.substring(plain, -2, 2).cast("int")).otherwise(F.lit(100))
    order = F.struct((F.col("scheme") != F.lit(deployed)).alias("a") if deployed else F.lit(True).alias("a"), capped.alias("b"), F.length(plain).alias("c"), cap.alias("d"), F.col("scheme").alias("e"))
    same = F.coalesce("curve_hash", F.concat(F.lit("own "), F.col("scheme")))
    g = hashes.groupBy(same.alias("same")).agg(F.array_sort(F.collect_list(order)).alias("all"))  # a few dozen schemes
    others = F.transform(F.slice("all", 2, F.size("all")), lambda x: x["e"])
    return g.select(F.col("all")[0]["e"].alias("scheme"), F.size(others).alias("n_aliases"), F.array_join(others, ", ").alias("aliases"))


OUTPUTS = ("days", "trades", "counts")


def save_replay(cache: DataFrame, schemes: list[str], folder: str, seed: float = 100_000.0, **rules) -> dict[str, str]:
    """Replays into ``folder``: a Parquet table for each output, split by scheme. A scheme whose replay is there
    already is not walked again, so a stopped run goes on where it ended."""
    spark, out = cache.sparkSession, {}
    for name in OUTPUTS:
        path = f"{folder.rstrip('/')}/{name}"
        held = load_replay(spark, folder, name)
        done = set() if held is None else {r["scheme"] for r in held.select("scheme").distinct().collect()}  # names of schemes
        left = [s for s in schemes if s not in done]
        if left:
            run_schemes(cache, left, seed, name, **rules).write.mode("append").partitionBy("scheme").parquet(path)
        out[name] = path
    return out


def load_replay(spark, folder: str, output: str = "days") -> DataFrame | None:
    """The saved table of an output, or None if there is none."""
    path = f"{folder.rstrip('/')}/{output}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.option("basePath", path).parquet(path)


def concentration(days: DataFrame) -> DataFrame:
    """Herfindahl index and effective number of bets by scheme."""
    h = F.when(F.col("hhi") > 0, F.col("hhi"))
    return days.groupBy("scheme").agg(F.avg(h).alias("hhi_mean"), F.max(h).alias("hhi_max"), F.min(h).alias("hhi_min"), F.avg(1 / h).alias("enb_mean"))


def as_of(left: DataFrame, scores: DataFrame, key: str = "ticker", ts: str = "ts") -> DataFrame:
    """The last score strictly before each row's date, or the score of that very date if there is one."""
    from pyspark.sql import Window as W

    a = left.withColumn("_s", F.lit(None).cast("double")).withColumn("_o", F.lit(1))
    b = scores.select(key, ts, F.col("score").alias("_s")).withColumn("_o", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(ts, "_o").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("score", F.last("_s", ignorenulls=True).over(w)).filter("_o = 1").drop("_s", "_o")
