"""Inputs of the deflated Sharpe ratio from many position series a unit, kept as dense blocks.

A unit's positions under all combinations of a grid are one matrix, bars x combinations. It is kept in blocks of
``BLOCK`` bars: a row is (unit, block) with the bars' returns, one byte a position, and the positions before the block. So
a table has units x blocks rows, whatever the number of combinations, and a row knows all it needs.

Two passes over the blocks give the mean correlation of all pairs of combinations without forming a pair: the
first sums net returns and their squares for each combination, as arrays that are added across a unit's blocks; the
second sums the standardised returns over combinations for each bar, whose square has k + k (k - 1) times the mean
correlation as its mean.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 256
YEAR = 252
PositionKernel = Callable[..., np.ndarray]
BLOCKS = "unit string, block int, first long, n_bars long, n_combos int, r array<double>, positions binary, before binary"


def position_blocks(bars: DataFrame, kernel: PositionKernel, combos: Sequence[dict[str, Any]], inputs: Sequence[str] = ("close", "high", "low"), price: str = "close", unit: str = "unit", order: str = "ts", least: int = 250, block: int = BLOCK) -> DataFrame:
    """Blocks of the positions that ``kernel(*inputs, **combo)`` returns for each combination, -127 .. 127.

    A unit's bars meet in one task, since kernels follow paths; units with fewer than ``least`` bars have no row.
    A combination whose kernel fails has no positions (0) and so counts as one that never trades.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_o", kind="stable")
        n = len(rows)
        if n < least:
            return pd.DataFrame([], columns=[c.split()[0] for c in BLOCKS.split(", ")])
        columns = [rows[c].to_numpy(float) for c in inputs]
        x = rows[price].to_numpy(float)
        held = np.zeros((n, len(combos)), np.int8)
        for i, combo in enumerate(combos):
            try:
                held[:, i] = np.clip(np.nan_to_num(np.asarray(kernel(*columns, **combo), float)), -127, 127)
            except Exception:  # a user's kernel; its combination doesn't trade
                held[:, i] = 0
        r = np.zeros(n)
        with np.errstate(divide="ignore", invalid="ignore"):
            r[1:] = np.nan_to_num(x[1:] / x[:-1] - 1, posinf=0.0, neginf=0.0)
        name, none = rows["unit"].iloc[0], np.zeros(len(combos), np.int8)
        return pd.DataFrame([(name, at // block, at, n, len(combos), r[at : at + block], held[at : at + block].tobytes(), (held[at - 1] if at else none).tobytes()) for at in range(0, n, block)], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    columns = dict.fromkeys((*inputs, price))
    return bars.select(F.col(unit).alias("unit"), F.col(order).alias("_o"), *columns).groupBy("unit").applyInPandas(one, BLOCKS)


def _net(row: dict[str, Any], cost: float) -> np.ndarray:
    """Net returns of a block, bars x combinations; the first bar of all has none."""
    k = row["n_combos"]
    held = np.frombuffer(row["positions"], np.int8).reshape(-1, k).astype(float)
    last = np.concatenate([np.frombuffer(row["before"], np.int8).reshape(1, k).astype(float), held[:-1]])
    if row["first"] == 0:
        last[0] = held[0]
    return last * np.asarray(row["r"])[:, None] - cost * np.abs(held - last)


def _added(name: str) -> Column:
    """Arrays of a group added element by element; a unit has few blocks."""
    parts = F.collect_list(name)
    return F.aggregate(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias(name)


_SUMMED = "unit string, n_bars long, s array<double>, q array<double>, n_in long, si array<double>, qi array<double>"


def dsr_inputs(blocks: DataFrame, cost: float = 0.001, is_ratio: float = 0.8) -> DataFrame:
    """(unit, n_combos, mean_correlation, sr_variance, max_sharpe) as ``significance.dsr_inputs`` has them: n_combos
    are those whose returns move; the rest is null where fewer than two do. ``blocks`` are read twice."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                net = _net(row, cost)
                inside = max(0, min(len(net), math.floor(row["n_bars"] * is_ratio) - row["first"]))
                part = net[:inside]
                yield pa.RecordBatch.from_pylist([{"unit": row["unit"], "n_bars": row["n_bars"], "s": net.sum(axis=0), "q": (net * net).sum(axis=0), "n_in": inside, "si": part.sum(axis=0), "qi": (part * part).sum(axis=0)}], schema=pa.schema([("unit", pa.string()), ("n_bars", pa.int64()), ("s", pa.list_(pa.float64())), ("q", pa.list_(pa.float64())), ("n_in", pa.int64()), ("si", pa.list_(pa.float64())), ("qi", pa.list_(pa.float64()))]))

    sums = blocks.mapInArrow(first, _SUMMED).groupBy("unit").agg(F.max("n_bars").alias("n"), F.sum("n_in").alias("n_in"), *[_added(c) for c in ("s", "q", "si", "qi")])
    deviation = lambda s, q, n: F.zip_with(s, q, lambda a, b: F.sqrt(F.greatest(b / n - (a / n) * (a / n), F.lit(0.0))))
    scaled = sums.select(
        "unit", "n", F.transform("s", lambda a: a / F.col("n")).alias("mu"), deviation("s", "q", F.col("n")).alias("sd"),
        F.transform("si", lambda a: a / F.col("n_in")).alias("mi"), deviation("si", "qi", F.col("n_in")).alias("di"),
    )
    moves = F.arrays_zip("sd", "mi", "di")
    sharpes = F.transform(F.filter(moves, lambda x: (x["sd"] > 1e-10) & (x["di"] > 1e-10)), lambda x: x["mi"] / x["di"] * math.sqrt(YEAR))
    stats = scaled.withColumn("k", F.size(F.filter("sd", lambda d: d > 1e-10)).cast("long")).withColumn("sr", sharpes)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mu, sd = np.array(row["mu"]), np.array(row["sd"])
                live = sd > 1e-10
                z = ((_net(row, cost)[:, live] - mu[live]) / sd[live]).sum(axis=1)
                out.append((row["unit"], float(z @ z)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["unit", "zz"])

    both = blocks.join(stats.select("unit", "mu", "sd"), "unit")
    spread = both.mapInArrow(second, "unit string, zz double").groupBy("unit").agg(F.sum("zz").alias("zz"))
    k, n = F.col("k"), F.size("sr")
    mean = F.aggregate("sr", F.lit(0.0), lambda a, x: a + x) / n
    variance = F.aggregate("sr", F.lit(0.0), lambda a, x: a + x * x) - n * mean * mean
    two = k >= 2
    return stats.join(spread, "unit").select(
        "unit", k.alias("n_combos"), F.when(two, (F.col("zz") / F.col("n") - k) / (k * (k - 1))).alias("mean_correlation"),
        F.when(two & (n >= 2), F.greatest(variance, F.lit(0.0)) / (n - 1)).alias("sr_variance"), F.when(two & (n >= 2), F.array_max("sr")).alias("max_sharpe"),
    )
