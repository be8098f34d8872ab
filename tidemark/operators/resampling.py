"""Resampled paths from counter-based random numbers, as columns.

A draw is a function of (seed, key, path, step): the md5 of these as text, 32 bits of it a draw, so four steps share
one digest. No generator has a state, so the paths of one key are made by many tasks, a lost task makes the same
paths again, and any engine with md5 repeats them. A key's returns are one array, in the order of their dates.

Paths are dealt in blocks of ``BLOCK``; a path's steps stay together in one task, where its running sums are windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .metrics import YEAR

BLOCK = 25
QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}


def draw(seed: int, key: Column, path: Column, step: Column) -> Column:
    """An unsigned 32-bit number of the path's step (from 0)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key, path.cast("string"), F.floor(step / 4).cast("long").cast("string")).cast("binary"))
    return F.conv(F.substring(digest, (F.pmod(step, F.lit(4)) * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long")


def paths(returns: DataFrame, samples: int, steps: int | None, seed: int = 42, key: str = "key") -> DataFrame:
    """(key, block, path, step, r): ``samples`` paths a key of ``steps`` draws, or of as many as the key has returns."""
    held = returns.filter("r is not null").groupBy(F.col(key).alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "r"))), lambda x: x["r"]).alias("values"))
    blocks = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // BLOCK)))).repartition("key", "block")
    each = blocks.withColumn("path", F.explode(F.sequence(F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK, F.lit(samples)) - 1)))
    last = (F.size("values") if steps is None else F.lit(steps)) - 1
    drawn = each.withColumn("step", F.explode(F.sequence(F.lit(0), last)))
    at = F.pmod(draw(seed, F.col("key").cast("string"), F.col("path"), F.col("step")), F.size("values").cast("long"))
    return drawn.select("key", "block", "path", "step", F.element_at("values", (at + 1).cast("int")).alias("r"))


def with_equity(drawn: DataFrame) -> DataFrame:
    """The paths with their equity from 1; a loss of everything leaves next to nothing."""
    w = W.partitionBy("key", "block", "path").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return drawn.withColumn("equity", F.exp(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-12)))).over(w)))


def forecast_cone(returns: DataFrame, forward: int = 252, samples: int = 1000, seed: int = 42, key: str = "key") -> DataFrame:
    """(key, step from 1, p05 .. p95): quantiles of resampled paths ``forward`` bars ahead, from 1."""
    curves = with_equity(paths(returns, samples, forward, seed, key))
    return curves.groupBy("key", (F.col("step") + 1).cast("long").alias("step")).agg(*[F.percentile("equity", q).alias(n) for n, q in QUANTILES.items()])


def metric_samples(returns: DataFrame, samples: int = 1000, seed: int = 42, key: str = "key") -> DataFrame:
    """(key, path, sharpe, cagr, volatility, max_dd, calmar) of each resampled history."""
    curves = with_equity(paths(returns, samples, None, seed, key))
    w = W.partitionBy("key", "block", "path").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    under = curves.withColumn("dd", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(0.0)) - 1)
    sd = F.stddev_samp("r")
    g = under.groupBy("key", "block", "path").agg(
        F.coalesce(F.when(sd > 1e-10, F.avg("r") / sd * math.sqrt(YEAR)), F.lit(0.0)).alias("sharpe"), (F.pow(F.max_by("equity", "step"), YEAR / F.count("*")) - 1).alias("cagr"),
        F.coalesce(sd * math.sqrt(YEAR), F.lit(0.0)).alias("volatility"), F.min("dd").alias("max_dd"),
    )
    return g.select("key", "path", "sharpe", "cagr", "volatility", "max_dd", F.coalesce(F.col("cagr") / F.nullif(-F.col("max_dd"), F.lit(0.0)), F.lit(0.0)).alias("calmar"))


METRICS = ("sharpe", "cagr", "volatility", "max_dd", "calmar")


def bootstrap_stats(returns: DataFrame, samples: int = 1000, seed: int = 42, key: str = "key") -> DataFrame:
    """(key, metric, p05, p50, p95) over the resampled histories of each key."""
    long = metric_samples(returns, samples, seed, key).unpivot(["key", "path"], list(METRICS), "metric", "value")
    return long.groupBy("key", "metric").agg(*[F.percentile("value", QUANTILES[n]).alias(n) for n in ("p05", "p50", "p95")])
