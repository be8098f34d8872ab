"""Portfolio weights, narrowing and the combination of weighted returns.

Inputs: ``members(ticker[, tier, sector, sharpe])`` and ``returns(key = ticker, ts, r)``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import metrics as M

def _all():
    return W.partitionBy()

#: Matrix methods run on the driver; their members are bounded.
MOST_MEMBERS = 2_000


def _normal(df: DataFrame, raw: Column) -> DataFrame:
    """Raw weights over their sum; equal where the sum is not positive. One row per member."""
    df = df.withColumn("_raw", F.coalesce(raw, F.lit(0.0)))
    total = F.sum("_raw").over(_all())
    return df.withColumn("w", F.when(total > 0, F.col("_raw") / F.nullif(total, F.lit(0.0))).otherwise(1.0 / F.count("*").over(_all()))).drop("_raw")


def stats_of(returns: DataFrame) -> DataFrame:
    return returns.groupBy(F.col("key").alias("ticker")).agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"))


def equal_weight(members: DataFrame) -> DataFrame:
    return _normal(members.select("ticker").distinct(), F.lit(1.0)).select("ticker", "w")


def inverse_vol(members: DataFrame, returns: DataFrame) -> DataFrame:
    j = members.select("ticker").distinct().join(stats_of(returns), "ticker", "left")
    return _normal(j, 1 / F.nullif(F.col("sd") * math.sqrt(252), F.lit(0.0))).select("ticker", "w")


def sharpe_weighted(members: DataFrame, returns: DataFrame) -> DataFrame:
    j = members.select("ticker").distinct().join(stats_of(returns), "ticker", "left")
    return _normal(j, F.greatest(F.col("mu") / F.nullif(F.col("sd"), F.lit(0.0)) * math.sqrt(252), F.lit(0.0))).select("ticker", "w")


def half_kelly(members: DataFrame, returns: DataFrame) -> DataFrame:
    j = members.select("ticker").distinct().join(stats_of(returns), "ticker", "left")
    return _normal(j, F.greatest(F.col("mu") / F.nullif(2 * F.col("sd") * F.col("sd"), F.lit(0.0)), F.lit(0.0))).select("ticker", "w")


def handcraft(members: DataFrame, returns: DataFrame) -> DataFrame:
    """Inverse volatility within a sector, sectors equal."""
    j = members.select("ticker", "sector").distinct().join(stats_of(returns), "ticker", "left").withColumn("_iv", F.coalesce(1 / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(0.0)))
    within = F.col("_iv") / F.nullif(F.sum("_iv").over(W.partitionBy("sector")), F.lit(0.0))
    return _normal(j, within).select("ticker", "w")


def tier_based(members: DataFrame) -> DataFrame:
    raw = F.when(F.col("tier") == "TOP_TIER", 2.0).when(F.col("tier") == "REJECT", 0.0).otherwise(1.0)
    return _normal(members, raw).select("ticker", "w")


def dynamic_1k(members: DataFrame, most: float = 0.25) -> DataFrame:
    return _normal(members.select("ticker").distinct(), F.least(1.0 / F.count("*").over(_all()), F.lit(most))).select("ticker", "w")


def cap_weights(weights: DataFrame, cap: float, renormalise: bool = True) -> DataFrame:
    """Normalise, cap, and normalise again; or leave what was cut off in cash."""
    w = F.col("w") / F.nullif(F.sum("w").over(_all()), F.lit(0.0))
    cut = weights.withColumn("w", F.least(w, F.lit(cap)))
    return cut.withColumn("w", F.col("w") / F.nullif(F.sum("w").over(_all()), F.lit(0.0))) if renormalise else cut


def matrix(returns: DataFrame, tickers: list[str] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tickers, covariance, correlation): the sums are made in Spark; a bounded matrix is collected."""
    sd = {r["ticker"]: r["sd"] for r in stats_of(returns).orderBy("ticker").limit(MOST_MEMBERS + 1).collect()}
    if len(sd) > MOST_MEMBERS:
        raise ValueError(f"more than {MOST_MEMBERS} members; narrow them first")
    names = [t for t in (tickers or sorted(sd)) if sd.get(t)]
    at = {t: i for i, t in enumerate(names)}
    cov, cor = np.diag([sd[t] ** 2 for t in names]), np.eye(len(names))
    for r in M.correlation(returns).collect():
        if r["a"] in at and r["b"] in at:
            i, j = at[r["a"]], at[r["b"]]
            cov[i, j] = cov[j, i] = r["cov"] or 0.0
            cor[i, j] = cor[j, i] = r["corr"] or 0.0
    return names, cov, cor


def _frame(spark, names: list[str], w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(n, float(x)) for n, x in zip(names, w, strict=True)], "ticker string, w double")


def erc(cov: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Equal risk contributions by repeated rescaling; by the square root of the ratio, as the whole
    ratio swings between two answers forever where assets are uncorrelated."""
    n = len(cov)
    w = np.full(n, 1 / n)
    for _ in range(rounds):
        total = w @ cov @ w
        part = w * (cov @ w)
        if total <= 0 or (part <= 0).any():
            break
        w = w * np.sqrt(total / n / part)
        w /= w.sum()
    return w


def risk_parity(returns: DataFrame) -> DataFrame:
    names, cov, _ = matrix(returns)
    return _frame(returns.sparkSession, names, np.round(erc(cov), 6) if names else np.empty(0))


def single_linkage_order(distance: np.ndarray) -> list[int]:
    """Leaves in the order of a single-linkage tree."""
    groups = {i: [i] for i in range(len(distance))}
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive = list(groups)
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(np.argmin(sub)), len(alive))
        a, b = sorted((alive[i], alive[j]))
        groups[a] = groups[a] + groups.pop(b)
        d[a] = np.minimum(d[a], d[b])
        d[:, a] = d[a]
        d[a, a] = np.inf
        alive.remove(b)
    return groups[alive[0]] if alive else []


def hrp_weights(cov: np.ndarray, cor: np.ndarray) -> np.ndarray:
    n = len(cov)
    if n == 0:
        return np.empty(0)
    order = single_linkage_order(np.sqrt(np.clip(0.5 * (1 - cor), 0, None)))

    def variance(items: list[int]) -> float:
        sub = cov[np.ix_(items, items)]
        iv = 1 / np.maximum(np.diag(sub), 1e-18)
        iv /= iv.sum()
        return float(iv @ sub @ iv)

    w = np.ones(n)
    todo = [order]
    while todo:
        items = todo.pop()
        if len(items) < 2:
            continue
        left, right = items[: len(items) // 2], items[len(items) // 2 :]
        vl, vr = variance(left), variance(right)
        a = 1 - vl / (vl + vr) if vl + vr > 0 else 0.5
        w[left] *= a
        w[right] *= 1 - a
        todo += [left, right]
    return w / w.sum()


def hrp(returns: DataFrame) -> DataFrame:
    names, cov, cor = matrix(returns)
    return _frame(returns.sparkSession, names, hrp_weights(cov, cor))


def narrow_sector(members: DataFrame, share: float = 0.25) -> DataFrame:
    """The best by Sharpe of each sector: at least two, at most a share of all."""
    most = F.greatest(F.lit(2), F.floor(F.count("*").over(_all()) * share))
    ranked = members.withColumn("_m", most).withColumn("_r", F.row_number().over(W.partitionBy("sector").orderBy(F.col("sharpe").desc(), "ticker")))
    return ranked.filter("_r <= _m").drop("_m", "_r")


def narrow_clusters(returns: DataFrame, sharpe: dict[str, float], most_clusters: int = 80, per_cluster: int = 3) -> list[str]:
    """Ward clusters on correlation distance, their number by silhouette; the best by Sharpe of each."""
    names, _, cor = matrix(returns)
    d = np.sqrt(np.clip(0.5 * (1 - cor), 0, None))
    n = len(names)
    if n <= 2:
        return names
    groups, dist2 = {i: [i] for i in range(n)}, d**2
    np.fill_diagonal(dist2, np.inf)
    best, chosen = -np.inf, [[i] for i in range(n)]
    while len(groups) > 2:
        keys = list(groups)
        sub = dist2[np.ix_(keys, keys)]
        i, j = divmod(int(np.argmin(sub)), len(keys))
        a, b = sorted((keys[i], keys[j]))
        na, nb = len(groups[a]), len(groups[b])
        for k in keys:
            if k not in (a, b):
                nk = len(groups[k])
                dist2[a, k] = dist2[k, a] = ((na + nk) * dist2[a, k] + (nb + nk) * dist2[b, k] - nk * dist2[a, b]) / (na + nb + nk)
        groups[a] += groups.pop(b)
        if len(groups) <= most_clusters:
            label = np.empty(n, dtype=int)
            for c, g in enumerate(groups.values()):
                label[g] = c
            score = []
            for i in range(n):
                own = label == label[i]
                inner = d[i, own].sum() / max(own.sum() - 1, 1)
                outer = min(d[i, label == c].mean() for c in set(label) - {label[i]})
                score.append((outer - inner) / max(outer, inner, 1e-12) if own.sum() > 1 else 0.0)
            if np.mean(score) > best:
                best, chosen = float(np.mean(score)), [list(g) for g in groups.values()]
    return sorted(t for g in chosen for t in sorted((names[i] for i in g), key=lambda t: (-sharpe.get(t, 0.0), t))[:per_cluster])


def narrow_max_div(returns: DataFrame, most: int = 100, gain: float = 0.005) -> list[str]:
    """Greedy choice by diversification ratio; stops after five members at gains below ``gain``."""
    names, cov, _ = matrix(returns)
    sd = np.sqrt(np.diag(cov))

    def ratio(items: list[int]) -> float:
        w = np.full(len(items), 1 / len(items))
        return float(w @ sd[items] / np.sqrt(max(w @ cov[np.ix_(items, items)] @ w, 1e-18)))

    held: list[int] = [int(np.argmin(sd))] if names else []
    now = 1.0
    while len(held) < min(most, len(names)):
        rest = [i for i in range(len(names)) if i not in held]
        scores = [ratio([*held, i]) for i in rest]
        top = int(np.argmax(scores))
        if len(held) >= 5 and scores[top] / now - 1 < gain:
            break
        held.append(rest[top])
        now = scores[top]
    return [names[i] for i in held]


def combine(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Weighted returns summed by date; missing members add nothing that day."""
    j = returns.join(weights, returns["key"] == weights["ticker"])
    return j.groupBy("ts").agg(F.sum(F.col("w") * F.col("r")).alias("r")).withColumn("key", F.lit("portfolio"))
