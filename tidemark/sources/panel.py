"""Price panels in long form, and their build from the test tables.

``prices(ticker, ts, close)``, ``bars(ticker, ts, open, high, low, close, volume)`` and
``series(pair, ts, seq, ratio, num_close, den_close)``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

SMOOTH, LEAST = 63, 10


def daily(spark: SparkSession, sf_dir: str, ticker: Column | None = None) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_shipdate").cast("date").alias("ts"), (F.col("l_returnflag") if ticker is None else ticker).alias("ticker")).agg(F.avg(F.col("l_extendedprice").cast("double")).alias("p"))


def smoothed(cells: DataFrame) -> DataFrame:
    """(ticker, ts, close): the trailing mean on the full date and ticker grid, quoted to six places.

    An average that doesn't change is then the same number on both days, whatever order it was summed
    in, so such days have a return of exactly 0.
    """
    # A row a date holds its cells; the tickers are one array, so the grid needs no join at all.
    tickers = cells.agg(F.array_sort(F.collect_set("ticker")).alias("t")).scalar()
    held = cells.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "p"))).alias("held"))
    laid = held.select("ts", "held", F.explode(tickers).alias("ticker")).select("ts", "ticker", F.try_element_at("held", F.col("ticker")).alias("p"))
    w = W.partitionBy("ticker").orderBy("ts").rowsBetween(-(SMOOTH - 1), 0)
    return laid.select("ticker", "ts", F.when(F.count("p").over(w) >= LEAST, F.round(F.avg("p").over(w), 6)).alias("close"))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothed(daily(spark, sf_dir))


def px6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothed(daily(spark, sf_dir, F.concat("l_returnflag", "l_linestatus")))


def px_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("ts"), F.col("o_orderpriority").alias("ticker")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("close"))


def benchmark_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return smoothed(orders.groupBy(F.col("o_orderdate").cast("date").alias("ts"), F.lit("BENCH").alias("ticker")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("p")))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("x", F.col("l_extendedprice").cast("double"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "x")
    return lines.groupBy(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("date").alias("ts")).agg(
        F.min_by("x", order).alias("open"), F.max("x").alias("high"), F.min("x").alias("low"), F.max_by("x", order).alias("close"), F.sum(F.col("l_quantity").cast("double")).alias("volume")
    )


def universe(prices: DataFrame) -> DataFrame:
    """All ordered pairs of tickers: (pair, numerator, denominator)."""
    # One array of all tickers, which the panel's grid shares where both come from one table.
    every = prices.agg(F.array_sort(F.collect_set("ticker")).alias("t")).scalar()
    each = prices.sparkSession.range(1).select(F.explode(every).alias("numerator"), every.alias("all"))
    pairs = each.select("numerator", F.explode(F.filter("all", lambda b: b > F.col("numerator"))).alias("denominator"))
    return pairs.select(F.concat_ws("/", "numerator", "denominator").alias("pair"), "numerator", "denominator")


def compute_ratio(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ratio of each pair on the dates both legs have; a single (both legs the same) is its price."""
    given = prices.filter("close is not null")
    n = given.select(F.col("ticker").alias("numerator"), "ts", F.col("close").alias("num_close"))
    d = given.select(F.col("ticker").alias("denominator"), "ts", F.col("close").alias("den_close"))
    both = pairs.select("pair", "numerator", "denominator").join(n, "numerator").join(d, ["denominator", "ts"])
    value = F.when(F.col("numerator") == F.col("denominator"), F.col("num_close")).otherwise(F.col("num_close") / F.nullif(F.col("den_close"), F.lit(0.0)))
    return both.select("pair", "ts", F.row_number().over(W.partitionBy("pair").orderBy("ts")).alias("seq"), value.alias("ratio"), "num_close", "den_close")


def ratio_ohlc(bar: DataFrame, pairs: DataFrame, least: int = 504) -> DataFrame:
    """Bounds of the ratio in each bar: its high is high over low, its low is low over high."""
    fields = ("open", "high", "low", "close")
    n = bar.select(F.col("ticker").alias("numerator"), "ts", *[F.col(c).alias(f"n_{c}") for c in fields])
    d = bar.select(F.col("ticker").alias("denominator"), "ts", *[F.col(c).alias(f"d_{c}") for c in fields])
    both = pairs.join(n, "numerator").join(d, ["denominator", "ts"])
    over = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    out = both.select("pair", "ts", over("n_open", "d_open").alias("open"), over("n_high", "d_low").alias("high"), over("n_low", "d_high").alias("low"), over("n_close", "d_close").alias("close")).dropna()
    return out.withColumn("n", F.count("*").over(W.partitionBy("pair"))).filter(F.col("n") >= least).drop("n")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = daily(spark, sf_dir)
    return compute_ratio(smoothed(cells), universe(cells))


def parse_universe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A universe file {"ratios": [{pair, numerator, denominator}]}: its tickers and its pairs."""
    pairs = spark.read.option("multiLine", True).json(path).select(F.explode("ratios").alias("r")).select("r.*")
    tickers = pairs.select(F.explode(F.array("numerator", "denominator")).alias("ticker")).distinct().orderBy("ticker")
    return tickers, pairs


def coverage(prices: DataFrame, expected: DataFrame) -> DataFrame:
    """First and last date with a price and the number of bars, also for tickers without any."""
    given = prices.filter("close is not null").groupBy("ticker").agg(F.min("ts").alias("first_date"), F.max("ts").alias("last_date"), F.count("*").alias("n_bars"))
    return expected.select("ticker").distinct().join(given, "ticker", "left").fillna({"n_bars": 0})


def freshness(prices: DataFrame, expected: DataFrame, as_of: str, most_behind: int = 0) -> DataFrame:
    """Days from the last price to ``as_of``; -1 for tickers without prices; fresh if not too many."""
    last = prices.filter("close is not null").groupBy("ticker").agg(F.max("ts").alias("last_date"))
    behind = F.coalesce(F.datediff(F.lit(as_of).cast("date"), "last_date"), F.lit(-1))
    return expected.select("ticker").distinct().join(last, "ticker", "left").select("ticker", behind.alias("days_behind"), ((behind >= 0) & (behind <= most_behind)).alias("fresh"))


def filter_fresh(prices: DataFrame, report: DataFrame) -> DataFrame:
    return prices.join(report.filter("fresh"), "ticker", "left_semi")


def stale(prices: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    last = prices.filter("close is not null").groupBy("ticker").agg(F.max("ts").alias("last_date"))
    return last.filter(F.col("last_date") < F.date_sub(F.lit(as_of).cast("date"), days))


def missing(prices: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.select("ticker").distinct().join(prices.filter("close is not null"), "ticker", "left_anti")


def last_business_day(day: Column) -> Column:
    """The latest Monday to Friday before ``day``."""
    w = F.weekday(F.date_sub(day, 1))
    return F.date_sub(F.date_sub(day, 1), F.greatest(w - 4, F.lit(0)))


def is_friday(day: Column) -> Column:
    return F.weekday(day) == 4


class NotFriday(PermissionError):
    """A run for Fridays only, on another day, without leave to run."""


def require_friday(name: str, day: dt.date, force: bool = False, reason: str | None = None) -> dict[str, object]:
    """What to log of a run for ``day``, its own and not today's date: (name, day, weekday, forced, reason).

    On other days NotFriday is raised, unless the run is forced with a reason that isn't blank.
    """
    about = {"name": name, "day": day.isoformat(), "weekday": day.strftime("%A"), "forced": day.weekday() != 4, "reason": None}
    if not about["forced"]:
        return about
    if not force:
        raise NotFriday(f"{name} runs for Fridays, {day} is a {about['weekday']}; force it with a reason, or give a Friday")
    if not (reason or "").strip():
        raise NotFriday(f"{name} was forced for {day}, a {about['weekday']}, without a reason")
    return about | {"reason": reason.strip()}


def weekdays_only(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.filter(F.weekday(ts) <= 4)


def between(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def to_wide(prices: DataFrame, value: str = "close", tickers: list[str] | None = None) -> DataFrame:
    """A column for each ticker, for the edges of the library only."""
    by = prices.groupBy("ts")
    return (by.pivot("ticker", tickers) if tickers else by.pivot("ticker")).agg(F.first(value))


def to_long(wide: DataFrame, value: str = "close") -> DataFrame:
    return wide.unpivot(["ts"], [c for c in wide.columns if c != "ts"], "ticker", value)


def cache_key(tickers: list[str], period: str, day: str, adjusted: bool = False) -> str:
    import hashlib

    return hashlib.sha1("|".join([period, day, str(adjusted), ",".join(sorted(tickers))]).encode()).hexdigest()[:16]
