"""Trade and distribution data sets, correlations in blocks and resampled paths, by plain code."""

import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import datasets as DS, metrics as M, resampling as RS

DAY = dt.date(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(int(i))


@pytest.fixture(scope="module")
def curves():
    rng = np.random.default_rng(6)
    rows = []
    for k in range(7):
        days = np.sort(rng.choice(500, 300 if k else 3, replace=False)) if k != 6 else np.arange(600, 640)
        rows += [(f"k{k}", day(i), float(r)) for i, r in zip(days, rng.normal(0.001, 0.02, len(days)) + 0.01 * np.sin(days))]
    return rows


@pytest.mark.parametrize("names, dates", [(64, 4096), (2, 100), (1, 7)])
@pytest.mark.parametrize("kind", ["date", "timestamp", "int"])
def test_correlation_by_pandas(spark, curves, names, dates, kind):
    df = spark.createDataFrame(curves + [("k1", day(999), None)], "key string, ts date, r double")
    if kind == "timestamp":
        df = df.withColumn("ts", F.col("ts").cast("timestamp") + F.expr("interval 5 hours"))
    elif kind == "int":
        df = df.withColumn("ts", F.unix_date("ts"))
    if kind != "date" and names == 64:
        pytest.skip("one layout is enough")
    got = {(r["a"], r["b"]): r for r in M.correlation(df, names=names, dates=dates).collect()}
    wide = pd.DataFrame(curves, columns=["key", "ts", "r"]).pivot(index="ts", columns="key", values="r")
    wanted = {(a, b): wide[[a, b]].dropna() for i, a in enumerate(wide) for b in list(wide)[i + 1 :]}
    assert set(got) == {p for p, v in wanted.items() if len(v)}
    for pair, r in got.items():
        v = wanted[pair]
        assert r["n"] == len(v)
        if len(v) > 2:
            assert r["corr"] == pytest.approx(v.corr().iloc[0, 1], abs=1e-9) and r["cov"] == pytest.approx(v.cov().iloc[0, 1], abs=1e-12)
    assert M.correlation(df.limit(0)).count() == 0


def test_open_positions_by_counting(spark):
    rng = np.random.default_rng(1)
    trades = [(str(i % 2), day(a), day(a + n)) for i, (a, n) in enumerate(zip(rng.integers(0, 80, 200), rng.integers(1, 30, 200)))]
    df = spark.createDataFrame(trades, "book string, entry_ts date, exit_ts date")
    days = spark.createDataFrame([(day(i),) for i in range(5, 100, 3)] * 2, "ts date")
    got = DS.open_positions(df, days).collect()
    assert len(got) == 32 and all(r["n_open"] == sum(a <= r["ts"] < b for _, a, b in trades) for r in got)
    got = DS.open_positions(df, days, ("book",)).collect()
    assert len(got) == 64 and all(r["n_open"] == sum(k == r["book"] and a <= r["ts"] < b for k, a, b in trades) for r in got)


def test_histogram_and_box(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 500), [-9.0, 9.0, -2.0, 2.0, 0.0]])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None)], "key string, v double")
    got = {r["bin"]: r for r in DS.histogram(df, "v", -2.0, 2.0, 8).collect()}
    counts, edges = np.histogram(x, bins=8, range=(-2, 2))
    assert [got[i + 1]["n"] for i in range(8)] == counts.tolist() and got[0]["n"] == (x < -2).sum() and got[9]["n"] == (x > 2).sum()
    assert [got[i + 1]["low"] for i in range(8)] == edges[:-1].tolist() and got[0]["low"] is None and got[9]["high"] is None and got[9]["low"] == 2
    b = DS.box(df, "v", ("key",)).first()
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert (b["n"], b["outliers"]) == (505, 505 - len(inside)) and (b["low"], b["high"]) == (inside.min(), inside.max()) and b["median"] == pytest.approx(q2)


def test_trades_of_positions(spark):
    rows = [("p", i + 1, day(i), pos, pnl) for i, (pos, pnl) in enumerate([(0, None), (1, None), (1, None), (0, 0.1), (1, None), (0, -0.2), (0, None), (1, 0.3)])]
    got = DS.trades_of(spark.createDataFrame(rows, "pair string, seq int, ts date, position int, trade_ret double")).orderBy("trade").collect()
    assert [(r["entry_ts"], r["exit_ts"], r["bars"], r["pnl"]) for r in got] == [(day(1), day(3), 2, 0.1), (day(4), day(5), 1, -0.2), (day(7), day(7), 0, 0.3)]
    k = DS.trade_kpis(spark.createDataFrame([("a", 0.2, 3), ("a", -0.1, 1), ("b", 0.5, 2)], "reason string, pnl double, bars int"), ("reason",)).orderBy("reason").collect()
    assert k[0]["profit_factor"] == pytest.approx(2) and k[0]["win_rate"] == 0.5 and k[1]["profit_factor"] is None and k[1]["mean_loss"] is None


def plain_draw(seed, key, path, step):
    return int(hashlib.md5(f"{seed}|{key}|{path}|{step // 4}".encode()).hexdigest()[8 * (step % 4) :][:8], 16)


def test_paths_by_plain_code(spark):
    rng = np.random.default_rng(3)
    held = {"a": rng.normal(0, 0.01, 37), "b|": rng.normal(0, 0.03, 5)}
    df = spark.createDataFrame([(k, day(i), float(v)) for k, x in held.items() for i, v in enumerate(x)], "key string, ts date, r double").orderBy(F.rand(1))
    got = {(r["key"], r["path"], r["step"]): r["r"] for r in RS.paths(df, 60, 9, seed=7).collect()}
    assert len(got) == 2 * 60 * 9
    assert all(v == held[k][plain_draw(7, k, p, s) % len(held[k])] for (k, p, s), v in got.items())
    paths = np.array([[got["a", p, s] for s in range(9)] for p in range(60)])
    cone = {r["step"]: r for r in RS.forecast_cone(df.filter("key = 'a'"), 9, 60, 7).collect()}
    for s in range(9):
        q = np.percentile(np.cumprod(1 + paths, axis=1)[:, s], [5, 25, 50, 75, 95])
        assert [cone[s + 1][c] for c in RS.QUANTILES] == pytest.approx(q.tolist())
    samples = {r["path"]: r for r in RS.metric_samples(df.filter("key = 'a'"), 30, 7).collect()}
    for p in range(30):
        r = np.array([held["a"][plain_draw(7, "a", p, s) % 37] for s in range(37)])
        eq = np.cumprod(1 + r)
        g = samples[p]
        assert g["sharpe"] == pytest.approx(r.mean() / r.std(ddof=1) * math.sqrt(252)) and g["cagr"] == pytest.approx(eq[-1] ** (252 / 37) - 1) and g["max_dd"] == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min())


def test_paths_do_not_depend_on_partitions(spark, curves):
    df = spark.createDataFrame(curves, "key string, ts date, r double")
    a, b = (RS.bootstrap_stats(df.repartition(n), 30).orderBy("key", "metric").collect() for n in (1, 6))
    assert [tuple(r) for r in a] == [tuple(r) for r in b] and len(a) == 35
    uniform = [plain_draw(42, "k", p, s) / 2**32 for p in range(100) for s in range(40)]
    assert abs(np.mean(uniform) - 0.5) < 0.02 and abs(np.corrcoef(uniform[:-1], uniform[1:])[0, 1]) < 0.05
