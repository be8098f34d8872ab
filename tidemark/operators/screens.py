"""Pair screens: one row per pair with enough bars, a statistic and ``passed``.

Every screen is windows and aggregates by pair over ``series(pair, ts, seq, ratio, num_close,
den_close)``, so a pair's rows meet in one partition once and the planner reuses that partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rolling as R, stats, unitroot
from . import kernels as K

LEAST_ROWS = 252


def halflife(slope: Column) -> Column:
    """Half-life of an AR(1) difference slope; null unless it reverts."""
    return F.when((slope < 0) & (slope > -1), -math.log(2) / F.log1p(slope))


def window_of(hl: Column) -> Column:
    """A look-back window from a half-life; 0 without one."""
    return F.coalesce(F.least(F.greatest((hl * 0.5).cast("int"), F.lit(10)), F.lit(252)), F.lit(0))


def halflives(series: DataFrame, value: str = "ratio", by: tuple[str, ...] = ("pair",), least: int = 30) -> DataFrame:
    x = F.col(value)
    steps = series.withColumn("_p", R.lag(x)).withColumn("_d", x - F.col("_p"))
    slope = F.regr_slope("_d", "_p")
    return steps.groupBy(*by).agg(F.when(F.count("*") >= least, halflife(slope)).alias("halflife"), F.count("*").alias("n_rows"))


def chan_halflife(series: DataFrame, low: float = 2, high: float = 756, alpha: float = 0.05, least: int = LEAST_ROWS) -> DataFrame:
    """Half-life in range and a unit root rejected at ``alpha``, with no lag or one, whichever has the lower AIC."""
    hl = halflives(series)
    both = hl.join(adf_auto(series, most=1), "pair").filter(F.col("n_rows") >= least)
    ok = F.col("halflife").between(low, high) & (F.col("adf_p") < alpha)
    return both.select("pair", "halflife", window_of(F.col("halflife")).alias("window"), "adf_t", "adf_p", F.coalesce(ok, F.lit(False)).alias("passed"))


def adf(series: DataFrame, value: str = "ratio", by: tuple[str, ...] = ("pair",), order: str = "seq") -> DataFrame:
    """t and p of the augmented Dickey-Fuller regression with a constant and one lag.

    Closed form from sums: the regressors are centred, so the 3 x 3 problem is a 2 x 2 one.
    """
    w = W.partitionBy(*by).orderBy(order)
    x = F.col(value)
    steps = series.withColumn("_x", F.lag(x).over(w)).withColumn("_y", x - F.col("_x"))
    steps = steps.withColumn("_z", F.lag("_y").over(w)).filter("_z is not null")
    return _adf_from(steps, by)


def _adf_from(steps: DataFrame, by: tuple[str, ...]) -> DataFrame:
    c = lambda a, b: F.covar_pop(a, b)
    g = steps.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), c("_x", "_x").alias("xx"), c("_z", "_z").alias("zz"), c("_x", "_z").alias("xz"), c("_x", "_y").alias("xy"), c("_z", "_y").alias("zy"), c("_y", "_y").alias("yy")
    )
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    b1 = (F.col("zz") * F.col("xy") - F.col("xz") * F.col("zy")) / F.nullif(det, F.lit(0.0))
    b2 = (F.col("xx") * F.col("zy") - F.col("xz") * F.col("xy")) / F.nullif(det, F.lit(0.0))
    g = g.withColumn("det", det).withColumn("b1", b1).withColumn("b2", b2)
    rss = F.col("n") * (F.col("yy") - F.col("b1") * F.col("xy") - F.col("b2") * F.col("zy"))
    se = F.sqrt(F.greatest(rss, F.lit(0.0)) / (F.col("n") - 3) * F.col("zz") / (F.col("n") * F.nullif(F.col("det"), F.lit(0.0))))
    t = F.when((F.col("n") >= 10) & (F.abs("det") > 1e-18), F.col("b1") / F.nullif(se, F.lit(0.0)))
    out = g.withColumn("adf_t", F.coalesce(t, F.lit(0.0)))
    return out.select(*by, "adf_t", stats.adf_pvalue(F.col("adf_t")).alias("adf_p"))


def adf_auto(series: DataFrame, value: str = "ratio", by: tuple[str, ...] = ("pair",), order: str = "seq", most: int | None = None) -> DataFrame:
    """(by, adf_t, adf_p, lag) with a constant and the lag of least AIC, up to ``most`` or the usual bound.

    One aggregate a key sums the lagged products; no row is multiplied, and what goes to Python is one row a
    key with a few numbers for each lag. Without ``most`` the longest key decides how many lags are summed.
    """
    given = series.select(*by, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    if most is None:
        longest = given.groupBy(*by).count().agg(F.max("count")).first()[0]
        lags = max(unitroot.most_lags(longest or 0), 0)
    else:
        lags = most
    keys, k = W.partitionBy(*by), 2 * lags + 3
    w = keys.orderBy("_o")
    # Differences don't change, and sums stay small, when the first value is taken off.
    rows = given.withColumn("_x", F.col("_v") - F.first("_v").over(w)).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(keys))
    rows = rows.withColumn("_p", F.lag("_x").over(w)).withColumn("_d0", F.col("_x") - F.col("_p"))
    rows = rows.withColumns({f"_d{h}": F.lag("_d0", h).over(w) for h in range(1, lags + 1)})
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    ends = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("_i", "_x")))), lambda r: r["_x"])
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("_x").alias("x"), F.sum(F.col("_x") * F.col("_x")).alias("xx"),
        F.array(*[total(F.col("_d0") * F.col(f"_d{h}")) for h in range(lags + 1)]).alias("dd"),
        F.array(total(F.col("_p") * F.col("_d0")), *[total(F.col("_x") * F.col(f"_d{h}")) for h in range(lags)]).alias("xd"),
        ends(F.col("_i") <= k).alias("head"), ends(F.col("_i") > F.col("_n") - k).alias("tail"),
    )

    @F.pandas_udf("adf_t double, lag int")
    def test(n: pd.Series, x: pd.Series, xx: pd.Series, dd: pd.Series, xd: pd.Series, head: pd.Series, tail: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unitroot.adf(unitroot.Sums(*r), most) for r in zip(n, x, xx, dd, xd, head, tail, strict=True)], columns=["adf_t", "lag"])

    found = sums.withColumn("_t", test("n", "x", "xx", "dd", "xd", "head", "tail"))
    return found.select(*by, "_t.adf_t", stats.adf_pvalue(F.col("_t.adf_t")).alias("adf_p"), "_t.lag")


def hurst(series: DataFrame, num_lags: int = 50, least: int = 50) -> DataFrame:
    """Rescaled-range exponent: mean range / deviation over chunks of each lag, slope in logs.

    Lags come from each pair's own length, so they are a table joined by pair; the chunks are groups.
    """
    steps = series.withColumn("_r", F.ln(F.col("ratio") / F.nullif(R.lag(F.col("ratio")), F.lit(0.0)))).filter("_r is not null")
    steps = steps.withColumn("_i", F.row_number().over(R.ordered()) - 1)
    sizes = steps.groupBy("pair").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    top = F.log10(F.col("n") / 2.0)
    spaced = F.transform(F.sequence(F.lit(0), F.lit(num_lags - 1)), lambda i: F.pow(F.lit(10.0), 0.5 + i * (top - 0.5) / (num_lags - 1)).cast("int"))
    lags = sizes.select("pair", "n", F.explode(F.array_distinct(spaced)).alias("lag")).filter("lag >= 2")
    chunks = steps.select("pair", "_i", "_r").join(lags, "pair").withColumn("chunk", F.expr("_i div lag")).filter("(chunk + 1) * lag <= n")
    w = W.partitionBy("pair", "lag", "chunk")
    dev = chunks.withColumn("_m", F.avg("_r").over(w)).withColumn("_s", F.stddev_samp("_r").over(w))
    cum = dev.withColumn("_c", F.sum(F.col("_r") - F.col("_m")).over(w.orderBy("_i").rowsBetween(W.unboundedPreceding, 0)))
    rs = cum.groupBy("pair", "lag", "chunk").agg(((F.max("_c") - F.min("_c")) / F.nullif(F.max("_s"), F.lit(0.0))).alias("rs"))
    means = rs.filter("rs > 0").groupBy("pair", "lag").agg(F.avg("rs").alias("rs"))
    return means.groupBy("pair").agg(F.when(F.count("*") >= 5, F.regr_slope(F.log10("rs"), F.log10("lag"))).alias("hurst"))


def chan_hurst(series: DataFrame, threshold: float = 0.5, trend: bool = False) -> DataFrame:
    h = hurst(series)
    ok = F.col("hurst") > threshold if trend else F.col("hurst") < threshold
    both = h.join(halflives(series).filter(F.col("n_rows") >= LEAST_ROWS), "pair")
    window = F.lit(0) if trend else window_of(F.col("halflife"))
    return both.select("pair", "hurst", "halflife", window.alias("window"), F.coalesce(ok, F.lit(False)).alias("passed"))


def with_efficiency(series: DataFrame, n: int = 10, still: float = 1.0, to: str = "er") -> DataFrame:
    x = F.col("ratio")
    steps = series.withColumn("_a", F.abs(x - R.lag(x)))
    path = R.total(F.col("_a"), n)
    er = F.when(path == 0, F.lit(still)).otherwise(F.abs(x - R.lag(x, n)) / F.nullif(path, F.lit(0.0)))
    return steps.withColumn(to, er).drop("_a")


def kaufman_er(series: DataFrame, n: int = 10, threshold: float = 0.30, trend: bool = False) -> DataFrame:
    er = with_efficiency(series, n)
    g = er.groupBy("pair").agg(F.percentile("er", 0.5).alias("median_er"), F.count("*").alias("n_rows")).filter(F.col("n_rows") >= LEAST_ROWS)
    ok = F.col("median_er") > threshold if trend else F.col("median_er") < threshold
    return g.select("pair", "median_er", F.coalesce(ok, F.lit(False)).alias("passed"))


def variance_ratio(series: DataFrame, lags: tuple[int, ...] = (2, 5, 10, 20), threshold: float = 0.95) -> DataFrame:
    """Variance of q-bar log returns against q times that of one-bar returns; the median over q."""
    x = F.col("ratio")
    logs = series.withColumn("_l", F.ln(x))
    one = F.col("_l") - R.lag(F.col("_l"))
    steps = logs.withColumns({"_1": one} | {f"_{q}": F.col("_l") - R.lag(F.col("_l"), q) for q in lags})
    g = steps.groupBy("pair").agg(F.count("*").alias("n_rows"), F.var_samp("_1").alias("v1"), *[F.var_samp(f"_{q}").alias(f"v{q}") for q in lags]).filter(F.col("n_rows") >= LEAST_ROWS)
    n = F.col("n_rows")
    vrs = [F.col(f"v{q}") / F.nullif(F.col("v1"), F.lit(0.0)) * (n - 1) / (q * (n - q)) for q in lags]
    ordered = F.array_sort(F.array(*vrs))
    k = len(lags)
    median = (F.element_at(ordered, (k + 1) // 2) + F.element_at(ordered, k // 2 + 1)) / 2
    return g.select("pair", *[v.alias(f"vr_{q}") for v, q in zip(vrs, lags)], median.alias("median_vr")).withColumn("passed", F.coalesce(F.col("median_vr") < threshold, F.lit(False)))


def kpss(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Level stationarity with the automatic bandwidth of Hobijn and others; passes if not rejected.

    The bandwidth follows from the pair's own autocovariances, so they are summed in the pair's task.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("seq")["ratio"].to_numpy(float)
        n, e = len(x), x - x.mean()
        if n < LEAST_ROWS:
            return pd.DataFrame([], columns=["pair", "lags", "kpss_stat"])
        s = lambda k: float(e[k:] @ e[: n - k]) / n
        first = [s(k) for k in range(int(n ** (2 / 9)) + 1)]
        s0, s1 = first[0] + 2 * sum(first[1:]), 2 * sum(k * v for k, v in enumerate(first))
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
        longrun = first[0] + 2 * sum(s(k) * (1 - k / (lags + 1)) for k in range(1, lags + 1))
        stat = float((np.cumsum(e) ** 2).sum()) / n**2 / longrun if longrun else None
        return pd.DataFrame([(rows["pair"].iloc[0], lags, stat)], columns=["pair", "lags", "kpss_stat"])

    g = series.select("pair", "seq", "ratio").groupBy("pair").applyInPandas(one, "pair string, lags int, kpss_stat double")
    return g.withColumn("kpss_p", stats.kpss_pvalue(F.col("kpss_stat"))).withColumn("passed", F.col("kpss_p") >= alpha)


def cadf(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Unit-root test on numerator - beta x denominator (the intercept stays in the residual)."""
    whole = W.partitionBy("pair")
    e = series.withColumn("_b", F.regr_slope("num_close", "den_close").over(whole)).withColumn("resid", F.col("num_close") - F.col("_b") * F.col("den_close"))
    beta = e.groupBy("pair").agg(F.max("_b").alias("beta"), F.count("*").alias("n_rows"))
    out = adf_auto(e, "resid", most=1).join(beta, "pair").join(halflives(e, "resid").select("pair", "halflife"), "pair").filter(F.col("n_rows") >= LEAST_ROWS)
    return out.select("pair", "beta", "adf_t", "adf_p", "halflife", window_of(F.col("halflife")).alias("window"), F.coalesce(F.col("adf_p") < alpha, F.lit(False)).alias("passed"))


def anchored(series: DataFrame, window: int, step: int) -> DataFrame:
    """Rows once for each look-back window that holds them: the window before anchor t, t = window,
    window + step, ... A row belongs to few anchors, so it lists them instead of a range join."""
    rows = series.withColumn("_n", F.count("*").over(W.partitionBy("pair"))).withColumn("_i", F.col("seq") - 1)
    lowest = F.greatest(F.lit(0), F.ceil((F.col("_i") + 1 - window) / F.lit(float(step))))
    highest = F.least(F.floor(F.col("_i") / F.lit(float(step))), F.floor((F.col("_n") - window) / F.lit(float(step))))
    return rows.filter(highest >= lowest).withColumn("anchor", F.explode(F.sequence(lowest.cast("int"), highest.cast("int")))).withColumn("anchor", F.col("anchor") * step + window)


def cadf_rolling(series: DataFrame, window: int = 252, step: int = 60, alpha: float = 0.05, pass_rate: float = 0.5, least_windows: int = 4, least: int = 756) -> DataFrame:
    rows = anchored(series, window, step).filter(F.col("_n") >= least)
    by = W.partitionBy("pair", "anchor")
    e = rows.withColumn("_b", F.regr_slope("num_close", "den_close").over(by)).withColumn("resid", F.col("num_close") - F.col("_b") * F.col("den_close"))
    tests = adf(e, "resid", ("pair", "anchor"), "_i").join(e.groupBy("pair", "anchor").agg(F.max("_b").alias("beta")), ["pair", "anchor"])
    g = tests.filter("beta is not null").groupBy("pair").agg(F.count("*").alias("n_windows"), F.avg((F.col("adf_p") < alpha).cast("int")).alias("pass_rate"), F.avg("beta").alias("mean_beta"), F.stddev_pop("beta").alias("std_beta"))
    return g.withColumn("passed", (F.col("n_windows") >= least_windows) & (F.col("pass_rate") >= pass_rate))


def johansen(series: DataFrame, critical: float = stats.JOHANSEN_TRACE_95) -> DataFrame:
    """Trace statistic of no cointegration, one lagged difference, no deterministic part.

    The moment matrices are sums; the two eigenvalues of the 2 x 2 problem are in closed form.
    """
    w = R.ordered()
    rows = series
    for c, n in (("num_close", "a"), ("den_close", "b")):
        rows = rows.withColumn(f"l{n}", F.lag(c).over(w)).withColumn(f"d{n}", F.col(c) - F.col(f"l{n}")).withColumn(f"e{n}", F.lag(F.col(f"d{n}")).over(w))
    rows = rows.filter("ea is not null")
    names = ("da", "db", "la", "lb", "ea", "eb")
    prods = {f"{p}_{q}": F.sum(F.col(p) * F.col(q)) for i, p in enumerate(names) for q in names[i:]}
    g = rows.groupBy("pair").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in prods.items()]).filter(F.col("n") >= LEAST_ROWS - 2)
    s = lambda p, q: F.col(f"{p}_{q}" if names.index(p) <= names.index(q) else f"{q}_{p}")
    det = s("ea", "ea") * s("eb", "eb") - s("ea", "eb") * s("ea", "eb")

    def part(p: str, q: str) -> Column:
        """Sum of products after both are cleaned of the lagged differences."""
        u, v = (s(p, "ea"), s(p, "eb")), (s(q, "ea"), s(q, "eb"))
        return s(p, q) - (u[0] * (s("eb", "eb") * v[0] - s("ea", "eb") * v[1]) + u[1] * (s("ea", "ea") * v[1] - s("ea", "eb") * v[0])) / F.nullif(det, F.lit(0.0))

    g = g.select("pair", "n", *[part(p, q).alias(f"r_{p}{q}") for i, p in enumerate(names[:4]) for q in names[i:4]])
    r = lambda p, q: F.col(f"r_{p}{q}" if names.index(p) <= names.index(q) else f"r_{q}{p}")
    det0 = F.nullif(r("da", "da") * r("db", "db") - r("da", "db") * r("da", "db"), F.lit(0.0))
    det1 = F.nullif(r("la", "la") * r("lb", "lb") - r("la", "lb") * r("la", "lb"), F.lit(0.0))
    k = {(i, j): r(i, j) for i in ("la", "lb") for j in ("da", "db")}
    inv0 = {("da", "da"): r("db", "db") / det0, ("db", "db"): r("da", "da") / det0, ("da", "db"): -r("da", "db") / det0}
    inv0["db", "da"] = inv0["da", "db"]
    m = {(i, j): sum((k[i, p] * inv0[p, q] * k[j, q] for p in ("da", "db") for q in ("da", "db")), F.lit(0.0)) for i in ("la", "lb") for j in ("la", "lb")}
    trace = (r("lb", "lb") * m["la", "la"] - r("la", "lb") * m["lb", "la"] - r("la", "lb") * m["la", "lb"] + r("la", "la") * m["lb", "lb"]) / det1
    product = (m["la", "la"] * m["lb", "lb"] - m["la", "lb"] * m["lb", "la"]) / det1
    g = g.select("pair", "n", trace.alias("t"), product.alias("d"))
    root = F.sqrt(F.greatest(F.col("t") * F.col("t") / 4 - F.col("d"), F.lit(0.0)))
    g = g.withColumn("eig_1", F.col("t") / 2 + root).withColumn("eig_2", F.col("t") / 2 - root)
    stat = -F.col("n") * (F.ln(1 - F.col("eig_1")) + F.ln(1 - F.col("eig_2")))
    return g.select("pair", "eig_1", "eig_2", stat.alias("trace_stat")).withColumn("passed", F.coalesce(F.col("trace_stat") > critical, F.lit(False)))


def vol_cone(series: DataFrame, window: int = 63, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Share of the rolling volatilities below the latest one."""
    x = F.col("ratio")
    vols = series.withColumn("_r", R.change(x)).withColumn("vol", R.std(F.col("_r"), window) * math.sqrt(252))
    vols = vols.withColumn("_last", F.max_by("vol", F.when(F.col("vol").isNotNull(), F.col("seq"))).over(W.partitionBy("pair")))
    g = vols.groupBy("pair").agg(F.max("_last").alias("current_vol"), F.avg((F.col("vol") < F.col("_last")).cast("int")).alias("share_below"), F.count("*").alias("n_rows")).filter(F.col("n_rows") >= LEAST_ROWS)
    return g.select("pair", "current_vol", "share_below", F.coalesce(F.col("share_below").between(low, high), F.lit(False)).alias("passed"))


def passthrough(series: DataFrame) -> DataFrame:
    h = halflives(series).filter(F.col("n_rows") >= LEAST_ROWS)
    w = window_of(F.col("halflife"))
    return h.select("pair", "halflife", F.when(w > 0, w).otherwise(20).alias("window"), F.lit(True).alias("passed"))


def regime_aware(series: DataFrame, benchmark: DataFrame, low: float = 2, high: float = 756, least: int = 126, seed: int = 42, starts: int = 5) -> DataFrame:
    """Half-life valid in both the bull and the bear regime of a three-component Gaussian mixture on
    the benchmark's returns; of several starts the one with the highest likelihood counts."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    r = benchmark.withColumn("r", F.col("close") / F.nullif(F.lag("close").over(W.partitionBy("ticker").orderBy("ts")), F.lit(0.0)) - 1).filter("r is not null")
    vec = VectorAssembler(inputCols=["r"], outputCol="v").transform(r)
    vec = vec.persist()
    models = [GaussianMixture(k=3, featuresCol="v", seed=seed + i, maxIter=50).fit(vec) for i in range(starts)]
    model = max(models, key=lambda m: m.summary.logLikelihood)
    vec.unpersist()
    means = sorted((float(g.mean[0]), i) for i, g in enumerate(model.gaussians))
    names = {means[0][1]: "bear", means[1][1]: "neutral", means[2][1]: "bull"}
    label = F.lit("neutral")
    for i, name in names.items():
        label = F.when(F.col("prediction") == i, F.lit(name)).otherwise(label)
    labels = model.transform(vec).select("ts", label.alias("regime"))
    x = F.col("ratio")
    steps = series.withColumn("_p", R.lag(x)).withColumn("_d", x - F.col("_p")).join(labels, "ts")
    hl = steps.groupBy("pair", "regime").agg(F.count("*").alias("n"), halflife(F.regr_slope("_d", "_p")).alias("hl"))
    fine = (F.col("n") >= least) & F.col("hl").between(low, high)
    g = hl.groupBy("pair").agg(F.max(F.when(F.col("regime") == "bull", fine)).alias("bull"), F.max(F.when(F.col("regime") == "bear", fine)).alias("bear"))
    return g.select("pair", F.coalesce(F.col("bull") & F.col("bear"), F.lit(False)).alias("passed"))


def combined(base: DataFrame, others: dict[str, DataFrame], mode: str = "intersect") -> DataFrame:
    """Left joins on pair; a screen without a row for the pair fails it."""
    out = base.withColumnRenamed("passed", "passed_base")
    flags = [F.col("passed_base")]
    for name, other in others.items():
        out = out.join(other.select("pair", F.col("passed").alias(f"passed_{name}")), "pair", "left").fillna({f"passed_{name}": False})
        flags.append(F.col(f"passed_{name}"))
    both = flags[0]
    for f in flags[1:]:
        both = both & f if mode == "intersect" else both | f
    return out.withColumn("passed", both)


def chan_combined(series: DataFrame, mode: str = "intersect") -> DataFrame:
    return combined(chan_halflife(series).select("pair", "halflife", "window", "passed"), {"hurst": chan_hurst(series), "er": kaufman_er(series)}, mode)


def trend_combined(series: DataFrame) -> DataFrame:
    return combined(kaufman_er(series, trend=True), {"hurst": chan_hurst(series, trend=True)})


def kaufman_kama(series: DataFrame, most_er: float = 0.15, least_crossings: float = 4.0, slope_bars: int = 10) -> DataFrame:
    """Mean efficiency, crossings of the adaptive mean a year, and its mean relative slope."""
    s = K.per_key(with_efficiency(series, still=0.0), lambda c: {"kama": K.kama(c["ratio"])}, {"kama": "double"}, ["ratio"])
    s = s.withColumn("above", (F.col("ratio") > F.col("kama")).cast("int")).withColumn("crossed", (F.col("above") != R.lag(F.col("above"))).cast("int"))
    s = s.withColumn("slope", F.col("kama") / F.nullif(R.lag(F.col("kama"), slope_bars), F.lit(0.0)) - 1)
    g = s.groupBy("pair").agg(F.avg("er").alias("mean_er"), F.sum("crossed").alias("crossings"), (F.sum("crossed") / F.count("kama") * 252).alias("per_year"), F.avg("slope").alias("kama_slope"))
    return g.withColumn("passed", F.coalesce((F.col("mean_er") < most_er) & (F.col("per_year") >= least_crossings), F.lit(False)))


def cadf_rolling_kalman(series: DataFrame, window: int = 252, step: int = 60, alpha: float = 0.05, least_windows: int = 4, least_rate: float = 0.5) -> DataFrame:
    """Unit-root tests in rolling windows of the filter's innovations, and statistics of its slope."""

    def run(c):
        slope, _, e = K.kalman_hedge(c["num_close"], c["den_close"])
        return {"ratio": e, "beta": slope}

    s = K.per_key(series.drop("ratio"), run, {"ratio": "double", "beta": "double"}, ["num_close", "den_close"])
    g = adf(anchored(s, window, step), "ratio", ("pair", "anchor"), "_i").groupBy("pair").agg(F.count("*").alias("n_windows"), F.avg((F.col("adf_p") < alpha).cast("int")).alias("pass_rate"))
    beta = s.groupBy("pair").agg(F.avg("beta").alias("beta_mean"), F.stddev_samp("beta").alias("beta_std"), F.max_by("beta", "seq").alias("beta_last"))
    return g.join(halflives(s).select("pair", "halflife"), "pair").join(beta, "pair").withColumn("passed", (F.col("n_windows") >= least_windows) & (F.col("pass_rate") >= least_rate))
