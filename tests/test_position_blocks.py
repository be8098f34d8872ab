"""Blocks of positions against plain matrices."""

import numpy as np
import pytest

from tidemark.operators import position_blocks as PB


def plainly(close, high, low, kernel, combos, cost=0.001, is_ratio=0.8):
    """By all pairs of combinations."""
    n = len(close)
    r = np.concatenate([[0.0], close[1:] / close[:-1] - 1])
    nets = []
    for c in combos:
        try:
            p = np.asarray(kernel(close, high, low, **c), float)
        except ZeroDivisionError:
            p = np.zeros(n)
        last = np.concatenate([p[:1], p[:-1]])
        nets.append(last * r - cost * np.abs(p - last))
    nets = [x for x in nets if x.std() > 1e-10]
    if len(nets) < 2:
        return len(nets), None, None, None
    corr = np.corrcoef(nets)[np.triu_indices(len(nets), 1)].mean()
    cut = int(n * is_ratio)
    sr = np.array([x[:cut].mean() / x[:cut].std() * np.sqrt(252) for x in nets if x[:cut].std() > 1e-10])
    return len(nets), corr, sr.var(ddof=1) if len(sr) > 1 else None, sr.max() if len(sr) > 1 else None


def _kernel():
    """Made in a function, so that workers get it by value and don't need this module."""

    def kernel(close, high, low, share, window):
        if window == 0:
            raise ZeroDivisionError
        mean = np.convolve(close, np.ones(window) / window)[: len(close)]
        return np.where((close - low) < share * (high - low), 1.0, np.where(close > 1.1 * mean, -1.0, 0.0))

    return kernel


kernel = _kernel()
COMBOS = [{"share": s, "window": w} for s in (0.2, 0.5, 0.8) for w in (5, 20)] + [{"share": -1.0, "window": 1}, {"share": 0.5, "window": 0}]


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(4)
    rows = []
    for name, n in (("a", 700), ("b", 256), ("c", 257), ("short", 249), ("still", 300)):
        x = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n))) if name != "still" else np.full(n, 5.0)
        spread = np.abs(rng.normal(0, 0.5, (n, 2))) if name != "still" else np.zeros((n, 2))
        rows += [(name, i, float(v), float(v + a), float(v - b)) for i, (v, (a, b)) in enumerate(zip(x, spread))]
    return spark.createDataFrame(rows, "unit string, ts int, close double, high double, low double").repartition(5)


@pytest.mark.parametrize("block", [1, 100, 256])
def test_inputs_by_plain_matrices(bars, block):
    got = {r["unit"]: tuple(r)[1:] for r in PB.dsr_inputs(PB.position_blocks(bars, kernel, COMBOS, block=block)).collect()}
    assert set(got) == {"a", "b", "c", "still"}
    for unit, values in got.items():
        rows = sorted(tuple(r)[1:] for r in bars.filter(f"unit = '{unit}'").collect())
        wanted = plainly(*(np.array(c) for c in list(zip(*rows))[1:]), kernel, COMBOS)
        assert values[0] == wanted[0]
        for a, b in zip(values[1:], wanted[1:]):
            assert a is None if b is None else a == pytest.approx(b, rel=1e-7, abs=1e-9)


def test_rows_are_units_times_blocks(bars):
    blocks = PB.position_blocks(bars, kernel, COMBOS * 10)
    assert blocks.groupBy("unit").count().orderBy("unit").collect() == [("a", 3), ("b", 1), ("c", 2), ("still", 2)]
    assert PB.position_blocks(bars.limit(0), kernel, COMBOS).count() == 0
