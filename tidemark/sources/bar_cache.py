"""A cache of bars that fetches through: what it holds and is fresh is read, the rest comes from the feed.

A cache is a folder. Each fetch that succeeded whole is a part of it, published by one rename:

    parts/<name>/bars/           Parquet, sorted by ticker and date
    parts/<name>/manifest.json   the tickers of the part, their source, last date and bars, and when it was fetched

A later part replaces the tickers it holds. Source and time of the fetch are also metadata of the columns
``source`` and ``ts``, which Spark keeps in the footers of the files. A ticker is fresh if its bars reach the
wanted date. Only tickers that are absent or stale are fetched; where any of them fails, nothing is published and
the next run asks again; the bars that did come are returned all the same.

Reads go to the parts that hold a wanted ticker, prune columns and push the tickers down to the files.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import feed, panel
from .shared import Files

FIELDS = feed.FIELDS


@dataclass
class Held:
    """What the parts of a cache say of each ticker."""

    part: dict[str, str] = field(default_factory=dict)
    last: dict[str, str] = field(default_factory=dict)
    source: dict[str, str] = field(default_factory=dict)
    fetched_at: dict[str, str] = field(default_factory=dict)


@dataclass
class Loaded:
    """The bars of a load, and what it did: hit, stale, absent, failed tickers; whether a part was published."""

    bars: DataFrame
    hit: list[str]
    stale: list[str]
    absent: list[str]
    failed: dict[str, str]
    published: bool


class BarCache:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)

    def held(self) -> Held:
        out = Held()
        for number in self.files.names("parts"):
            manifest = self.files.read_json(f"parts/{number}/manifest.json")
            for ticker, about in manifest["tickers"].items():
                out.part[ticker], out.last[ticker], out.source[ticker] = number, about["last"], about["source"]
                out.fetched_at[ticker] = manifest["fetched_at"]
        return out

    def read(self, tickers: Sequence[str] | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
        """(ticker, ts, fields) of the newest parts; a ticker without the only field that is asked for has no row."""
        return self._read(self.held(), tickers, fields)

    def _read(self, held: Held, tickers: Sequence[str] | None, fields: Sequence[str]) -> DataFrame:
        unknown = set(fields) - set(FIELDS)
        if unknown:
            raise KeyError(f"no field {', '.join(sorted(unknown))}; there are {', '.join(FIELDS)}")
        wanted = [t for t in held.part if tickers is None or t in set(tickers)]
        out = None
        for number in sorted({held.part[t] for t in wanted}):
            mine = sorted(t for t in wanted if held.part[t] == number)
            part = self.spark.read.parquet(f"{self.folder}/parts/{number}/bars").filter(F.col("ticker").isin(mine)).select("ticker", "ts", *fields)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], "ticker string, ts date, " + ", ".join(f"{f} double" for f in fields))
        return out.filter(F.coalesce(*[F.col(f) for f in fields]).isNotNull())

    def close(self, tickers: Sequence[str] | None = None) -> DataFrame:
        """(ticker, ts, close): the files' other columns are not read."""
        return self.read(tickers, ("close",))

    def publish(self, rows: DataFrame, tickers: Sequence[str], now: dt.datetime) -> str:
        """Where fetched ``rows`` are now: a part if all ``tickers`` have bars, else a trial that no read sees.

        The rows are written once, whole, under another name; what the files hold then decides.
        """
        trial = f"_trial-{uuid.uuid4().hex}"
        at = now.isoformat(timespec="seconds")
        about = {"fetched_at": at}
        marked = rows.select("ticker", F.col("ts").alias("ts", metadata=about), *FIELDS, F.col("source").alias("source", metadata=about), "requests", "error")
        marked.repartitionByRange("ticker", "ts").sortWithinPartitions("ticker", "ts").write.parquet(f"{self.folder}/{trial}/bars")
        written = self.spark.read.parquet(f"{self.folder}/{trial}/bars")
        given = written.filter(F.col("source") != feed.MISSING).groupBy("ticker").agg(F.max("ts").alias("last"), F.count("close").alias("n"), F.first("source").alias("source")).filter("n > 0")
        there = {r["ticker"]: {"last": str(r["last"]), "bars": r["n"], "source": r["source"]} for r in given.collect()}  # a row for each ticker
        if not there or set(tickers) - set(there):
            return trial
        self.files.write_json(f"{trial}/manifest.json", {"fetched_at": at, "tickers": there})
        self.files.make("parts")
        # Names grow with time and are never used twice, so a rename replaces nothing and two writers don't meet.
        taken = self.files.names("parts")
        number = int(taken[-1].partition("-")[0]) + 1 if taken else 0
        place = f"parts/{number:08d}-{uuid.uuid4().hex[:8]}"
        if not self.files.rename(trial, place):
            raise OSError(f"{self.folder}/{trial} could not be renamed to {place}")
        return place

    def load(self, tickers: Sequence[str], fetcher: str, cutoff: str, refresh: bool = False, fields: Sequence[str] = FIELDS, now: dt.datetime | None = None, **options: object) -> Loaded:
        """The bars of ``tickers`` up to ``cutoff``, fetched where the cache doesn't reach it."""
        names = sorted(set(tickers))
        held = Held() if refresh else self.held()
        absent = [t for t in names if t not in held.part]
        stale = [t for t in names if t in held.part and held.last[t] < cutoff]
        hit = [t for t in names if t in held.part and t not in stale]
        last = F.col("ts") <= F.lit(cutoff).cast("date")
        if not absent and not stale:
            return Loaded(self._read(held, hit, fields).filter(last), hit, [], [], {}, False)
        asked = sorted(absent + stale)
        rows = feed.read_bars(self.spark, asked, fetcher, cutoff=cutoff, **options)
        place = self.publish(rows, asked, now or dt.datetime.now())
        published = place.startswith("parts/")
        written = self.spark.read.parquet(f"{self.folder}/{place}/bars")
        failed = {} if published else {r["ticker"]: r["error"] for r in feed.missing_of(written).collect()}
        fresh = feed.bars_of(written).select("ticker", "ts", *fields).filter(F.coalesce(*[F.col(f) for f in fields]).isNotNull())
        # A stale ticker that failed keeps the bars it had.
        kept = self._read(held, hit + [t for t in stale if t in failed], fields)
        return Loaded(kept.unionByName(fresh).filter(last), hit, stale, absent, failed, published)

    def sources(self, tickers: Sequence[str]) -> DataFrame:
        """(ticker, source, fetched_at, last): missing for tickers the cache doesn't hold."""
        held = self.held()
        rows = [(t, held.source.get(t, feed.MISSING), held.fetched_at.get(t), held.last.get(t)) for t in sorted(set(tickers))]
        return self.spark.createDataFrame(rows, "ticker string, source string, fetched_at string, last string")

    def clear(self) -> int:
        """Deletes all parts and unpublished trials; how many parts there were."""
        parts = self.files.names("parts")
        for name in self.files.names():
            if name == "parts" or name.startswith("_trial-"):
                self.files.delete(name)
        return len(parts)


def get_prices(spark: SparkSession, tickers: Sequence[str], period: str, day: str, folder: str, fetcher: str, refresh: bool = False, adjusted: bool = False, **options: object) -> Loaded:
    """Bars of one request, kept under the request's key."""
    cache = BarCache(spark, f"{folder.rstrip('/')}/{panel.cache_key(list(tickers), period, day, adjusted)}")
    # A key names one request, so whatever was published under it is an answer to it, however old its last bar.
    held = cache.held()
    names = sorted(set(tickers))
    if names and not refresh and all(t in held.part for t in names):
        return Loaded(cache.read(names), names, [], [], {}, False)
    return cache.load(names, fetcher, day, refresh=True, period=period, adjusted=adjusted, **options)


def clear_requests(spark: SparkSession, folder: str) -> int:
    """Deletes every request's cache; how many there were."""
    files = Files(spark, folder)
    names = [n for n in files.names() if files.exists(f"{n}/parts")]
    for n in names:
        files.delete(n)
    return len(names)


@dataclass
class Universe:
    """Bars, pairs and sources of a universe file."""

    bars: DataFrame
    pairs: DataFrame
    sources: DataFrame
    loaded: Loaded

    def series(self) -> DataFrame:
        return panel.compute_ratio(self.bars.select("ticker", "ts", "close"), self.pairs)

    def coverage(self) -> DataFrame:
        """First and last date, bars and source of each ticker, also of those without bars."""
        return panel.coverage(self.bars.select("ticker", "ts", "close"), self.sources).join(self.sources.select("ticker", "source"), "ticker")


def load_universe(spark: SparkSession, universe: str, folder: str, fetcher: str, today: str, refresh: bool = False, **options: object) -> Universe:
    """All tickers of a universe file, up to the business day before ``today``, through the cache in ``folder``."""
    tickers, pairs = panel.parse_universe(spark, universe)
    names = [r["ticker"] for r in tickers.collect()]  # the file's own tickers
    cutoff = spark.range(1).select(panel.last_business_day(F.lit(today).cast("date")).cast("string")).first()[0]
    cache = BarCache(spark, folder)
    loaded = cache.load(names, fetcher, cutoff, refresh, **options)
    return Universe(loaded.bars, pairs, cache.sources(names), loaded)
