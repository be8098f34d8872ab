"""Daily bars from a remote feed: ``spark.read.format("bars")``, a Python data source.

Options: ``tickers`` (comma-separated), ``fetcher`` (``module:function``), ``batch`` (tickers a request),
``retries``, ``backoff`` (seconds, doubled from one retry to the next), ``cutoff`` (last date, inclusive), ``source``
(name of the feed in the rows); all options are handed to the fetcher.

Each batch of tickers is a partition, so batches are fetched side by side and a lost executor repeats only its
own. A task asks for its batch; tickers that are missing from the answer, or have no close, are asked for again
after a pause, by themselves, up to ``retries`` times; an error counts as an answer without any of them. Pauses
happen in the tasks. What is still missing then is a row of its own, with the ticker, the source ``missing``, the
number of requests and the last error, and nothing else; one bad ticker never fails the load.

A fetcher is ``f(tickers, options, attempt) -> rows``; rows are (ticker, ts, open, high, low, close, volume), None
for what is unknown. ``ts`` may be a date, a datetime (its time zone is dropped, not converted) or ISO text.
With the option ``pushdown`` (``read_bars`` sets it where ``spark.sql.python.filterPushdown.enabled`` is on) filters
on ticker reach the reader, and other tickers are not asked for.
"""

from __future__ import annotations

import csv
import datetime as dt
import importlib
import io
import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.error import HTTPError

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "ticker string, ts date, open double, high double, low double, close double, volume double, source string, requests int, error string"
FIELDS = ("open", "high", "low", "close", "volume")
BATCH, RETRIES, BACKOFF = 50, 3, 1.0
MISSING = "missing"
Bar = tuple
Fetcher = Callable[[Sequence[str], dict[str, str], int], Iterable[Bar]]


def day_of(ts: object) -> dt.date:
    if isinstance(ts, dt.datetime):
        return ts.date()
    return ts if isinstance(ts, dt.date) else dt.date.fromisoformat(str(ts)[:10])


def named(path: str) -> Fetcher:
    """The function that ``module:function`` names."""
    module, _, name = path.partition(":")
    if not name:
        raise ValueError(f"a fetcher is module:function, not {path!r}")
    return getattr(importlib.import_module(module), name)


def lacking(rows: Iterable[Bar], tickers: Sequence[str]) -> list[str]:
    """The tickers without a single close."""
    there = {r[0] for r in rows if r[5] is not None and r[5] == r[5]}
    return [t for t in tickers if t not in there]


def fetched(fetch: Fetcher, tickers: Sequence[str], options: dict[str, str], retries: int = RETRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> tuple[list[Bar], dict[str, int], dict[str, str]]:
    """(rows, requests by ticker, last errors of the tickers still missing), after retries of what is missing."""
    rows: list[Bar] = []
    asked = dict.fromkeys(tickers, 0)
    errors: dict[str, str] = {}
    wanted = list(tickers)
    for attempt in range(retries + 1):
        if attempt:
            sleep(backoff * 2 ** (attempt - 1))
        for t in wanted:
            asked[t] += 1
        try:
            got = [tuple(r) for r in fetch(wanted, options, attempt)]
            errors.clear()
        except Exception as e:  # a feed is foreign: whatever it raises is an answer without rows
            got, errors = [], {t: f"{type(e).__name__}: {e}" for t in wanted}
        still = lacking(got, wanted)
        good = set(wanted) - set(still)
        rows += [r for r in got if r[0] in good]
        wanted = still
        if not wanted:
            break
    return rows, asked, {t: errors.get(t, "no data") for t in wanted}


class Batch(InputPartition):
    def __init__(self, tickers: list[str]):
        self.tickers = tickers


class BarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k: str(v) for k, v in options.items()}
        self.tickers = sorted({t.strip() for t in self.options.get("tickers", "").split(",")} - {""})
        self.batch = int(self.options.get("batch", BATCH))
        if self.batch < 1:
            raise ValueError("a batch has one ticker at least")
        named(self.options.get("fetcher", "tidemark.sources.feed:http_csv"))

    def partitions(self) -> Sequence[InputPartition]:
        return [Batch(self.tickers[i : i + self.batch]) for i in range(0, len(self.tickers), self.batch)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # Spark reads once without a partition where there are none
            return
        o = self.options
        fetch = named(o.get("fetcher", "tidemark.sources.feed:http_csv"))
        rows, asked, failed = fetched(fetch, partition.tickers, o, int(o.get("retries", RETRIES)), float(o.get("backoff", BACKOFF)))
        last = dt.date.fromisoformat(o["cutoff"]) if "cutoff" in o else dt.date.max
        source, kept = o.get("source", "feed"), set()
        for ticker, ts, *values in rows:
            day = day_of(ts)
            if day <= last:
                values = [None if v is None or v != v else float(v) for v in values]
                if values[3] is not None:
                    kept.add(ticker)
                yield (ticker, day, *values, source, asked[ticker], None)
        for ticker in partition.tickers:
            # Also what has bars, but none of them up to the cutoff.
            if ticker not in kept:
                yield (ticker, None, None, None, None, None, None, MISSING, asked[ticker], failed.get(ticker, "no data up to the cutoff"))


class NarrowingReader(BarReader):
    """Spark refuses a reader with this method where the push-down of filters is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the tickers; every filter is applied to the rows as well."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ticker",):
                self.tickers = [t for t in self.tickers if t == f.value]
            elif isinstance(f, In) and f.attribute == ("ticker",):
                self.tickers = [t for t in self.tickers if t in f.value]
            yield f


class BarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (NarrowingReader if options.get("pushdown") == "true" else BarReader)(options)


def read_bars(spark: SparkSession, tickers: Sequence[str], fetcher: str, **options: object) -> DataFrame:
    """The bars of the tickers, and a row for each ticker that the feed doesn't give."""
    spark.dataSource.register(BarSource)
    options.setdefault("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    return spark.read.format("bars").options(tickers=",".join(tickers), fetcher=fetcher, **options).load()


def bars_of(rows: DataFrame) -> DataFrame:
    """The bars alone."""
    return rows.filter(f"source <> '{MISSING}'").select("ticker", "ts", *FIELDS)


def missing_of(rows: DataFrame) -> DataFrame:
    """(ticker, requests, error) of the tickers that the feed doesn't give."""
    return rows.filter(f"source = '{MISSING}'").select("ticker", "requests", "error")


# Fetchers ---------------------------------------------------------------------------------------


def http_csv(tickers: Sequence[str], options: dict[str, str], attempt: int) -> Iterator[Bar]:
    """A CSV file a ticker with the columns date, open, high, low, close, volume, in any case and order.

    ``url`` holds ``{ticker}``, and ``{key}`` for any other option. A ticker that isn't found is left out.
    """
    for t in tickers:
        fields = {k: urllib.parse.quote(str(v)) for k, v in options.items()} | {"ticker": urllib.parse.quote(t)}
        try:
            with urllib.request.urlopen(options["url"].format(**fields), timeout=float(options.get("timeout", 30))) as answer:
                text = answer.read().decode()
        except HTTPError as e:
            if e.code == 404:
                continue
            raise
        for row in csv.DictReader(io.StringIO(text)):
            row = {k.strip().lower(): v for k, v in row.items() if k}
            yield (t, row["date"], *[float(row[f]) if row.get(f) not in (None, "", "null", "NaN") else None for f in FIELDS])


def folder(tickers: Sequence[str], options: dict[str, str], attempt: int) -> Iterator[Bar]:
    """A feed kept as Parquet files with a folder ``ticker=...`` for each ticker, at the option ``path``.

    To stand in for a feed that fails, it raises in the first ``failing`` requests of a batch, and leaves the
    tickers in ``absent`` (JSON, ticker to number of requests) out of their first answers.
    """
    import pyarrow.dataset as ds
    from pyarrow import fs

    if attempt < int(options.get("failing", 0)):
        raise ConnectionError(f"request {attempt + 1} failed")
    absent = json.loads(options.get("absent", "{}"))
    place, root = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", options["path"]))
    for t in tickers:
        at = f"{root}/ticker={urllib.parse.quote(t, safe='')}"
        if attempt < absent.get(t, 0) or place.get_file_info(at).type == fs.FileType.NotFound:
            continue
        held = ds.dataset(at, filesystem=place, format="parquet").to_table(columns=["ts", *FIELDS])
        for row in zip(*(c.to_pylist() for c in held.columns), strict=True):
            yield (t, *row)
