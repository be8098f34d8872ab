"""Range joins and the panel without nested loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.intervals import range_join
from tidemark.operators import patterns as PT
from tidemark.plans import catalog
from tidemark.sources import panel as P

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_range_join_by_plain_loops(spark, width):
    rng = np.random.default_rng(width)
    points = [(str(k), int(x), i) for i, (k, x) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(-200, 200, 400)))] + [("0", None, 999)]
    ranges = [(str(k), int(a), int(a + n), i) for i, (k, a, n) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-220, 220, 60), rng.integers(-2, 90, 60)))] + [("0", None, 5, 98), ("0", -5, None, 99)]
    wanted = sorted((p, r) for k, x, p in points for q, a, b, r in ranges if k == q and None not in (x, a, b) and a <= x <= b)
    got = range_join(spark.createDataFrame(points, "k string, x int, p int"), spark.createDataFrame(ranges, "k string, a int, b int, r int"), F.col("x"), F.col("a"), F.col("b"), width, ("k",))
    assert sorted(map(tuple, got.select("p", "r").collect())) == wanted and got.columns == ["k", "x", "p", "a", "b", "r"]
    with pytest.raises(ValueError):
        range_join(got, got, F.col("x"), F.col("a"), F.col("b"), 0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["met_stress_published", "met_stress_windows", "pat_live_lines", "bt_zscore_summary", "panel_ratio"])
def test_no_nested_loops(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_panel_of_odd_cells(spark):
    """Dates and tickers without a value, null tickers' prices, and a ticker that appears late."""
    cells = spark.createDataFrame([("a", f"2020-01-{i:02d}", float(i)) for i in range(1, 21)] + [("b", f"2020-01-{i:02d}", 1.0 if i % 2 else None) for i in range(1, 31)], "ticker string, ts string, p double").withColumn("ts", F.col("ts").cast("date"))
    rows = {(r["ticker"], r["ts"].day): r["close"] for r in P.smoothed(cells).collect()}
    assert len(rows) == 60 and rows["a", 9] is None and rows["a", 10] == 5.5 and rows["a", 30] == 10.5 and rows["b", 18] is None and rows["b", 19] == 1.0
    assert P.smoothed(cells.limit(0)).count() == 0
    pairs = P.universe(spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "ticker string")).orderBy("pair").collect()
    assert [tuple(r) for r in pairs] == [("a/b", "a", "b"), ("a/c", "a", "c"), ("b/c", "b", "c")]
    assert P.universe(spark.createDataFrame([("b",)], "ticker string")).count() == 0


def test_live_lines_of_found_lines(spark):
    """Lines that a detector found are live from their end to the last bar."""
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(0, 1, 200))
    lines = [("p", "support", 0, int(e), float(s), float(c)) for e, s, c in zip(rng.integers(5, 200, 30), rng.normal(0, 0.1, 30), rng.normal(0, 1, 30))]
    bars = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate(x)], "pair string, seq int, close double")
    got = {r["seq"]: r for r in PT.live_lines(bars, spark.createDataFrame(lines, "pair string, kind string, start_idx long, end_idx long, slope double, intercept double"), 16).collect()}
    for t in range(200):
        live = [s * t + c for _, _, _, e, s, c in lines if t > e]
        assert (t in got) == bool(live)
        if live:
            assert got[t]["n_live"] == len(live) and got[t]["lowest"] == pytest.approx(min(live)) and got[t]["highest"] == pytest.approx(max(live))
