"""The command line from files to files."""

import json

import numpy as np
import pytest

from tidemark import cli


def test_lists(capsys):
    assert cli.main(["list-methods", "s2"]) == 0
    assert "grid_regime" in capsys.readouterr().out.split()
    assert cli.main(["list-schemes"]) == 0 and len(capsys.readouterr().out.split()) == 59


def test_wrong_arguments(tmp_path):
    with pytest.raises(SystemExit) as e:
        cli.main(["run"])
    assert e.value.code == 2
    wrong = ["run", "--preset", "TRE-2", "--prices", "x", "--pairs", "y", "--out", str(tmp_path), "--set", "nothing=1"]
    assert cli.main(wrong) == 2


def test_run(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(t, d, float(v)) for t in "ABC" for d, v in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 400))))]
    spark.createDataFrame(rows, "ticker string, d int, close double").selectExpr("ticker", "date_add(date'2020-01-01', d) AS ts", "close").write.parquet(f"{tmp_path}/prices")
    spark.createDataFrame([("A/B", "A", "B"), ("A/C", "A", "C")], "pair string, numerator string, denominator string").write.parquet(f"{tmp_path}/pairs")
    args = ["run", "--preset", "TRE-2", "--prices", f"{tmp_path}/prices", "--pairs", f"{tmp_path}/pairs", "--out", f"{tmp_path}/out", "--stop-after", "s2", "--set", "fee=0.0005"]
    assert cli.main(args) == 0
    tag = "f0"
    assert spark.read.parquet(f"{tmp_path}/out/s1_{tag}_metrics.parquet").count() == 2
    held = [f for f in (tmp_path / "out").iterdir() if f.name.startswith("run_") and f.suffix == ".json"]
    about = json.loads(held[0].read_text())
    assert len(held) == 1 and about["meta"]["preset"] == "TRE-2" and about["config"]["cost_per_side"] == 0.0005 and about["config"]["cpcv_n_folds"] == 10
    assert "oos_sharpe" in spark.read.parquet(f"{tmp_path}/out/s2_{tag}_metrics.parquet").columns


def test_replay(spark, tmp_path):
    rng = np.random.default_rng(6)
    close, on = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, (120, 3)), axis=0)), (rng.random((120, 3)) < 0.5).astype(int)
    rows = [("ABC"[i], t, float(close[t, i]), int(on[t, i])) for t in range(120) for i in range(3)]
    df = spark.createDataFrame(rows, "ticker string, t int, close double, pos_raw int").selectExpr("ticker", "date_add(date'2020-01-01', t) AS ts", "close", "close * 0.99 AS low", "1.0D AS atr", "pos_raw", "0 AS stop_code", "0.0D AS stop_param")
    df.write.parquet(f"{tmp_path}/cache")
    df.filter("ticker = 'A'").selectExpr("ts", "close AS equity").write.parquet(f"{tmp_path}/bench")
    args = ["replay", "--cache", f"{tmp_path}/cache", "--out", f"{tmp_path}/out", "--schemes", "equal_weight", "hrp_cap10", "--bench", f"{tmp_path}/bench"]
    assert cli.main(args) == 2
    assert cli.main([*args, "--start", "2020-02-01"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/summary").count() == 3 and spark.read.parquet(f"{tmp_path}/out/days").count() == 240
    more = [*args[:5], "--schemes", "equal_weight", "flat_1k_cap05"]
    assert cli.main(more) == 0 and spark.read.parquet(f"{tmp_path}/out/days").count() == 360
    assert cli.main([*args[:5], "--schemes", "no_such"]) == 2
