"""Kernels called from SQL against the same kernels called on data frames."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import backtest as B, kernels as K, signals as SG, table_functions as TF


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = [(p, i + 1, float(v), float(v * 10)) for p in "abc" for i, v in enumerate(1 + np.cumsum(rng.normal(0, 0.01, 300)))]
    df = spark.createDataFrame(rows, "pair string, seq int, ratio double, num_close double").withColumn("den_close", F.lit(10.0)).withColumn("ts", F.date_add(F.lit("2020-01-01").cast("date"), "seq")).orderBy(F.rand(3))
    df.createOrReplaceTempView("tf_series")
    TF.register(spark)
    return df


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select("pair", "seq", *columns).collect())


def test_named_signals(spark, series):
    for name, options in (("keltner", {"window": 15, "entry": 1.0, "exit_": 0.5}), ("rsi_wilder", {"window": 10}), ("consec_down", {"window": 2})):
        given = "".join(f", {k} => {v}" for k, v in options.items())
        got = spark.sql(f"SELECT * FROM signal(TABLE(tf_series) PARTITION BY pair ORDER BY seq, name => '{name}'{given})")
        wanted = rows(SG.SIGNALS[name](series, **options), "entry", "exit")
        assert rows(got, "entry", "exit") == wanted and any(r[2] for r in wanted), name


def test_positions(spark, series):
    SG.zscore_standard(series).createOrReplaceTempView("tf_flags")
    got = spark.sql("SELECT * FROM positions(TABLE(tf_flags) PARTITION BY pair ORDER BY seq, stop => 0.05, fee => 0.002)")
    wanted = B.run(SG.zscore_standard(series), 0.05, 0.002)
    assert rows(got, "ret", "position", "trade_ret") == rows(wanted, "ret", "position", "trade_ret")
    assert dict(got.dtypes) == {"pair": "string", "seq": "int", "ret": "double", "position": "bigint", "trade_ret": "double"}


@pytest.mark.parametrize("name, settings, plain", [("ema", "span => 12", lambda x: K.ema(x, 12)), ("kama", "", K.kama), ("rsi_wilder", "n => 9", lambda x: K.rsi_wilder(x, 9)), ("kalman_mean", "q => 0.1", lambda x: K.kalman_mean(x, 0.1)), ("trailing_rank", "n => 20, need => 5", lambda x: K.percent_rank(x, 20, 5)), ("adx_close", "", K.adx_close), ("atr_close", "period => 5", lambda x: K.atr_close(x, 5))])
def test_kernels_of_one_column(spark, series, name, settings, plain):
    # Without an ORDER BY the function sorts by the declared place.
    got = {(r["pair"], r["seq"]): r["y"] for r in spark.sql(f"SELECT * FROM {name}(TABLE(SELECT pair, seq, ratio AS x FROM tf_series) PARTITION BY pair{', ' + settings if settings else ''})").collect()}
    for p in "abc":
        x = np.array([r["ratio"] for r in series.filter(F.col("pair") == p).orderBy("seq").collect()])
        for i, v in enumerate(plain(x)):
            assert got[p, i + 1] is None if not np.isfinite(v) else got[p, i + 1] == pytest.approx(v)


def test_own_kernels_and_signals(spark, series):
    TF.register_kernel(spark, "tf_peak", lambda c, scale=1: {"peak": np.maximum.accumulate(c["ratio"]) * scale, "falls": np.concatenate([[False], np.diff(c["ratio"]) < 0])}, ["ratio"], {"peak": "double", "falls": "boolean"}, "name string", "day date")
    got = spark.sql("SELECT * FROM tf_peak(TABLE(SELECT pair AS name, ts AS day, ratio FROM tf_series) PARTITION BY name ORDER BY day, scale => 2)")
    from pyspark.sql import Window as W

    wanted = series.select("pair", "ts", (2 * F.max("ratio").over(W.partitionBy("pair").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))).alias("peak"))
    assert sorted(map(tuple, got.select("name", "day", "peak").collect())) == sorted(map(tuple, wanted.collect()))
    TF.register_signal(spark, "tf_high", lambda x, w, p: (x > p.get("level", 1.0), x < 1.0))
    flags = rows(spark.sql("SELECT * FROM tf_high(TABLE(tf_series) PARTITION BY pair ORDER BY seq, level => 1.02)"), "entry")
    held = {(r["pair"], r["seq"]): r["ratio"] for r in series.collect()}
    assert flags == [(p, s, s > 1 and held[p, s - 1] > 1.02) for p, s, _ in flags]


def test_nulls_and_empty_tables(spark):
    TF.register(spark)
    spark.createDataFrame([("a", 1, 1.0, True, None), ("a", 2, 2.0, None, False), ("a", 3, 3.0, False, True)], "pair string, seq int, num_close double, entry boolean, exit boolean").createOrReplaceTempView("tf_holes")
    assert [r["position"] for r in spark.sql("SELECT * FROM positions(TABLE(tf_holes) PARTITION BY pair ORDER BY seq)").collect()] == [0, 0, 0]
    assert spark.sql("SELECT * FROM positions(TABLE(SELECT * FROM tf_holes WHERE pair = 'z') PARTITION BY pair ORDER BY seq)").count() == 0


def test_mistakes_are_named(spark, series):
    for text, said in (("SELECT * FROM ema(TABLE(SELECT pair, seq, ratio FROM tf_series) PARTITION BY pair, span => 3)", "needs the columns x"), ("SELECT * FROM ema(TABLE(SELECT pair, seq, ratio AS x FROM tf_series) WITH SINGLE PARTITION, span => 3)", "PARTITION BY pair"), ("SELECT * FROM signal(TABLE(tf_series) PARTITION BY pair, name => 'nothing')", "no segment signal")):
        with pytest.raises(PySparkException, match=said):
            spark.sql(text).collect()
    for wrong in ({"outputs": {"y": "tensor"}}, {"key": "pair"}):
        with pytest.raises(ValueError):
            TF.register_kernel(spark, "tf_wrong", lambda c: c, ["x"], **({"outputs": {"y": "double"}} | wrong))
