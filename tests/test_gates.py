"""Splits by date, the Friday gate, tiers and resolved validators by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pipeline as PL, validation as V
from tidemark.sources import panel as P


def test_friday_gate():
    friday, monday = dt.date(2024, 1, 5), dt.date(2024, 1, 8)
    assert P.require_friday("x", friday)["forced"] is False
    assert P.require_friday("x", monday, True, " late data ") == {"name": "x", "day": "2024-01-08", "weekday": "Monday", "forced": True, "reason": "late data"}
    for force, reason in ((False, None), (False, "why"), (True, None), (True, "  ")):
        with pytest.raises(P.NotFriday):
            P.require_friday("x", monday, force, reason)


def _series(spark, n=300):
    return spark.createDataFrame([(p, i + 1, float(100 + (i * 7) % 13 + i / 50)) for p in "ab" for i in range(n)], "pair string, seq int, num_close double").withColumn("ratio", F.col("num_close") / 100).withColumn("ts", F.date_add(F.lit("2020-01-01").cast("date"), "seq"))


def test_split_by_share_and_date(spark):
    s = _series(spark)
    by_share = V.split(s, 0.75)
    assert by_share.groupBy("pair").agg(F.sum(F.col("in_sample").cast("int"))).orderBy("pair").collect() == [("a", 225), ("b", 225)]
    last = s.filter("pair = 'a' and seq = 225").first()["ts"]
    by_date = V.split(s, cutoff=str(last))
    assert by_date.filter("in_sample").agg(F.max("ts")).first()[0] == last and by_date.filter("not in_sample").agg(F.min("ts")).first()[0] == last + dt.timedelta(1)
    wanted = V.chan_is_oos(s, is_ratio=0.75).orderBy("pair").collect()
    assert V.chan_is_oos(by_date).orderBy("pair").collect() == wanted and len(wanted) == 2 and wanted[0]["n_oos_bars"] == 75
    # A cutoff before or after all dates leaves nothing to compare.
    assert V.chan_is_oos(V.split(s, cutoff="2000-01-01")).count() == 0 and V.chan_is_oos(V.split(s, cutoff="2030-01-01")).count() == 0


def test_tiers(spark):
    rows = spark.createDataFrame([(t,) for t in ("TOP_TIER", "SECOND_TIER", "LAST_TIER", "REJECT", "what", None)], "t string")
    got = rows.select(PL.tier_rank(F.col("t")).alias("r"), PL.downgraded(F.col("t")).alias("d")).collect()
    assert [r["r"] for r in got] == [0, 1, 2, 3, 3, 3]
    assert [r["d"] for r in got] == ["SECOND_TIER", "LAST_TIER", "REJECT", "REJECT", "REJECT", "REJECT"]


S3 = "pair string, val_method string, mean_test_sharpe double, degradation double, passed boolean"
ROWS = [("all", "cpcv", 1.0, 0.1, True), ("all", "wfa", 2.0, 0.3, True), ("some", "cpcv", 3.0, 0.5, False), ("some", "wfa", 1.5, 0.2, True), ("some", "mc", 1.2, 0.9, True), ("none", "cpcv", 0.5, None, False), ("none", "wfa", -1.0, 0.7, False), ("one", "cpcv", 0.7, 0.0, True)]


def test_resolved_validators(spark):
    df = spark.createDataFrame(ROWS, S3)
    got = {m: {r["pair"]: (r["passed"], r["sharpe"], r["degradation"]) for r in PL.resolve_validators(df, m).collect()} for m in PL.MODES}
    assert got["strictest"] == {"all": (True, 1.0, 0.3), "some": (False, 3.0, 0.5), "none": (False, 0.5, None), "one": (True, 0.7, 0.0)}
    assert got["any_pass"] == {"all": (True, 2.0, 0.3), "some": (True, 1.5, 0.2), "none": (False, 0.5, None), "one": (True, 0.7, 0.0)}
    assert got["agreement"] == {"all": (True, 1.0, 0.3), "some": (True, 1.5, 0.2), "none": (False, 0.5, None), "one": (True, 0.7, 0.0)}
    some = PL.resolve_validators(df, "agreement").filter("pair = 'some'").first()
    assert (some["agreement"], some["n_methods"], some["n_methods_passed"], some["val_methods"]) == ("FRAGILE_EDGE", 3, 2, "cpcv,mc,wfa")
    assert (some["sharpe_cpcv"], some["sharpe_mc"], some["sharpe_wfa"]) == (3.0, 1.2, 1.5)
    with pytest.raises(ValueError):
        PL.resolve_validators(df, "loudest")


def test_bridge_downgrades_fragile_edges(spark):
    s2 = spark.createDataFrame([("all", "X", 1.0, True), ("all", "X", 2.0, False), ("some", "X", 1.0, True), ("one", "Y", 1.0, True)], "pair string, numerator string, oos_sharpe double, passed boolean")
    s4 = spark.createDataFrame([("all", "TOP_TIER", True), ("some", "SECOND_TIER", True), ("one", "SECOND_TIER", True), ("none", "TOP_TIER", False)], "pair string, tier string, passed boolean")
    got = {r["pair"]: (r["tier"], r["portfolio_tier"], r["selected"], r["oos_sharpe"]) for r in PL.bridge(s2, spark.createDataFrame(ROWS, S3), s4, "agreement").collect()}
    assert got == {"all": ("TOP_TIER", "GOOD", False, 1.0), "some": ("LAST_TIER", "MARGINAL", True, 1.0), "one": ("SECOND_TIER", "GOOD", True, 1.0)}
