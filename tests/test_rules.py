"""Row rules, quarantine, strict mode and the published checks."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pipeline as PL, rules as RL

S4 = "pair string, numerator string, denominator string, passed boolean, tier string, psr_value double, psr_pass string, note string"
ROWS = [
    ("A/B", "A", "B", True, "TOP_TIER", 0.5, "true", "x"),
    ("A/C", "A", None, True, "GREAT", 0.5, None, "x"),
    ("A/D", "A", "D", None, "REJECT", 1.5, "perhaps", "x"),
    ("A/E", "A", "E", False, "REJECT", float("nan"), "false", None),
    ("A/F", "A", "F", False, None, None, "0", None),
]


def broken(spark, rows, schema, stage):
    return [r["broken"] for r in RL.check_rows(spark.createDataFrame(rows, schema), stage).collect()]


def test_rules_by_hand(spark):
    assert broken(spark, ROWS, S4, "s4") == [
        [],
        ["denominator: null", "tier: value"],
        ["passed: null", "psr_value: high", "psr_pass: type"],
        ["psr_value: low", "psr_value: high"],
        ["tier: null"],
    ]


def test_kinds(spark):
    schema = "pair string, numerator string, denominator string, passed string, halflife string, window double, method string"
    rows = [("p", "a", "b", "yes", "1.5", 10.0, "m"), ("p", "a", "b", "1", "long", 10.5, "m"), ("p", "a", "b", "so", None, 0.0, "m"), ("p", "a", "b", "t", "nan", float("nan"), ""), ("p", "a", "b", "t", "", None, "m")]
    assert broken(spark, rows, schema, "s1") == [[], ["halflife: type", "window: type"], ["passed: type", "window: low"], ["window: type", "window: low"], ["halflife: type"]]


def test_columns(spark):
    assert broken(spark, [("p", "a", "b", True)], "pair string, numerator string, denominator string, passed boolean", "s4") == [["tier: missing"]]
    with pytest.raises(KeyError):
        RL.check_rows(spark.createDataFrame([("p",)], "pair string"), "s9")
    with pytest.raises(ValueError):
        RL.check_rows(spark.createDataFrame([("p",)], "broken string"), "s4")


def test_every_field_of_the_interface_has_rules():
    for stage, names in PL.REQUIRED.items():
        there = {f.name for f in RL.FIELDS[stage]}
        assert set(names) <= there, stage


def test_split_in_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(ROWS * 4, S4)
    got = RL.split_rows(df.mapInArrow(count, df.schema), "s4", f"file://{tmp_path}/s4", most=3)
    assert seen.value == 4 * len(ROWS)
    assert got.good.columns == df.columns and got.good.count() == 4 and got.bad.count() == 16
    assert {r["rule"]: r["n"] for r in got.counts.collect()} == {k: 4 for k in ("denominator: null", "tier: value", "passed: null", "psr_value: high", "psr_pass: type", "psr_value: low", "tier: null")} | {"psr_value: high": 8}
    shown = got.examples.groupBy("rule").count().collect()
    assert {r["count"] for r in shown} == {3} and len(shown) == 7
    assert json.loads(got.examples.filter("rule = 'tier: value'").first()["row"])["tier"] == "GREAT"
    assert seen.value == 4 * len(ROWS)


def test_strict_raises_with_examples(spark, tmp_path):
    with pytest.raises(RL.SchemaError) as e:
        RL.split_rows(spark.createDataFrame(ROWS, S4), "s4", f"file://{tmp_path}/s4", strict=True)
    assert e.value.counts["tier: value"] == 1 and "GREAT" in str(e.value) and e.value.stage == "s4" and len(e.value.examples) == 8
    good = spark.createDataFrame(ROWS[:1], S4)
    assert RL.split_rows(good, "s4", f"file://{tmp_path}/good", strict=True).good.count() == 1
    assert RL.split_rows(good.limit(0), "s4", f"file://{tmp_path}/none", strict=True).good.count() == 0
    assert RL.validate_rows(good, "s4") is good
    with pytest.raises(RL.SchemaError) as e:
        RL.validate_rows(spark.createDataFrame(ROWS, S4), "s4", strict=True)
    assert len(e.value.examples) == 1


def test_stage_writer(spark, tmp_path):
    df, place = spark.createDataFrame(ROWS, S4), f"file://{tmp_path}/out"
    path = PL.write_stage(df, "s4", place, rows="split")
    assert PL.read_stage(spark, path, "s4").count() == 1
    assert spark.read.parquet(f"{place}/quarantine/s4_metrics-examples").count() == 8
    with pytest.raises(RL.SchemaError):
        PL.write_stage(df, "s4", f"{place}2", rows="strict")
    assert not (tmp_path / "out2" / "s4_metrics.parquet").exists()
    with pytest.raises(ValueError):
        PL.write_stage(df, "s4", place, rows="loose")


def test_checks(spark):
    one = lambda stage, df, **o: {r["check"]: (r["value"], r["severity"], r["ok"]) for r in PL.anomalies(df, stage, **o).collect()}
    df = spark.range(100).select((F.col("id") < 97).alias("passed"), (F.col("id") / 10).alias("oos_sharpe"), F.lit(0.4).alias("fold_win_rate"), F.lit(-0.1).alias("ir_vs_spy"), F.lit(0.5).alias("oos_sr_haircut"))
    assert one("s1", df) == {"s1_pass_rate": (0.97, "warn", False)} and one("s2", df) == {"s2_oos_sr": (4.95, "strict", False)}
    assert one("s3", df) == {"s3_fold_win_rate": (0.4, "warn", False), "s3_cohort_size": (97.0, "warn", True)}
    assert one("s4", df) == {"s4_pass_rate": (0.97, "strict", False)} and one("s4", df.withColumn("psr_pass", F.lit(True)).filter("id is null" if "id" in df.columns else "passed is null")) == {"s4_pass_rate": (None, "strict", True)}
    assert one("s5", df) == {"s5_ir_vs_spy": (-0.1, "warn", False), "s5_locked_sr": (0.5, "warn", True)}
    assert one("s2", df, policy="off") == {} and one("s2", df, policy="off", strict_on=("s2_oos_sr",))["s2_oos_sr"][1] == "strict"
    assert one("s1", df, bands={"s1_pass_rate": (0.0, 1.0)})["s1_pass_rate"][2] and one("s5", df.select("passed")) == {} and one("s0", df) == {}
    with pytest.raises(KeyError):
        PL.anomalies(df, "s7")
