"""The feed of bars and the cache before it."""

import datetime as dt
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import bar_cache as BC, feed as FD, panel as P

FOLDER = "tidemark.sources.feed:folder"
DAYS = [dt.date(2024, 1, 2) + dt.timedelta(i) for i in range(8)]


@pytest.fixture
def place(spark, tmp_path):
    """A feed of A and B up to 2024-01-09, C up to 2024-01-05, and D without a close."""
    rows = [(t, d, 1.0, 2.0, 0.5, float(i) if t != "D" else None, 10.0) for t in "ABCD" for i, d in enumerate(DAYS) if t != "C" or i < 4]
    df = spark.createDataFrame(rows, "ticker string, ts date, open double, high double, low double, close double, volume double")
    df.repartition(1).write.partitionBy("ticker").parquet(f"{tmp_path}/feed")
    return f"file://{tmp_path}"


def read(spark, place, tickers, **options):
    return FD.read_bars(spark, tickers, FOLDER, path=f"{place}/feed", **({"backoff": 0} | options))


def test_batches_are_partitions_and_missing_tickers_are_rows(spark, place):
    rows = read(spark, place, ["B", "A", "D", "X"], batch=2)
    assert rows.rdd.getNumPartitions() == 2
    assert FD.bars_of(rows).groupBy("ticker").count().orderBy("ticker").collect() == [("A", 8), ("B", 8)]
    gone = {r["ticker"]: (r["requests"], r["error"]) for r in FD.missing_of(rows).collect()}
    assert gone == {"D": (4, "no data"), "X": (4, "no data")}
    assert read(spark, place, []).count() == 0


def test_cutoff(spark, place):
    rows = read(spark, place, ["A", "B"], cutoff="2024-01-04")
    assert rows.agg(F.max("ts")).first()[0] == dt.date(2024, 1, 4) and rows.count() == 6
    early = read(spark, place, ["A"], cutoff="2020-01-01").collect()
    assert len(early) == 1 and early[0]["source"] == "missing" and early[0]["error"] == "no data up to the cutoff"


@pytest.mark.parametrize("failing, there", [(0, True), (2, True), (3, True), (4, False)])
def test_failures_are_retried(spark, place, failing, there):
    """With three retries the fourth request is the last."""
    rows = read(spark, place, ["A"], failing=failing).collect()
    if there:
        assert len(rows) == 8 and {r["requests"] for r in rows} == {failing + 1} and {r["source"] for r in rows} == {"feed"}
    else:
        assert [(r["ticker"], r["source"], r["requests"], r["error"]) for r in rows] == [("A", "missing", 4, "ConnectionError: request 4 failed")]


def test_two_retries_and_a_third_failure(spark, place):
    assert FD.missing_of(read(spark, place, ["A"], failing=3, retries=2)).first()["requests"] == 3
    assert FD.missing_of(read(spark, place, ["A"], failing=2, retries=2)).count() == 0


def test_only_what_is_missing_is_asked_again(spark, place):
    rows = read(spark, place, ["A", "B"], absent=json.dumps({"B": 2})).groupBy("ticker").agg(F.max("requests"), F.count("*")).orderBy("ticker").collect()
    assert [tuple(r) for r in rows] == [("A", 1, 8), ("B", 3, 8)]


def test_pauses_double():
    pauses, asked = [], []

    def never(tickers, options, attempt):
        asked.append(list(tickers))
        return [("A", "2024-01-02", None, None, None, 1.0, None), ("B", "2024-01-02", 1.0, 1.0, 1.0, float("nan"), None)]

    rows, requests, failed = FD.fetched(never, ["A", "B"], {}, sleep=pauses.append)
    assert pauses == [1.0, 2.0, 4.0] and asked == [["A", "B"], ["B"], ["B"], ["B"]]
    assert [r[0] for r in rows] == ["A"] and requests == {"A": 1, "B": 4} and failed == {"B": "no data"}


def test_filters_narrow_the_requests(spark, place):
    from pyspark.sql.datasource import EqualTo, In

    reader = FD.NarrowingReader({"tickers": "A,B,C,D", "fetcher": FOLDER, "batch": "1"})
    assert len(reader.partitions()) == 4
    assert len(list(reader.pushFilters([In(("ticker",), ("A", "C", "Z")), EqualTo(("ts",), 1)]))) == 2
    assert [p.tickers for p in reader.partitions()] == [["A"], ["C"]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        only = read(spark, place, ["A", "B", "X"], batch=1).filter("ticker = 'A'")
        assert only.count() == 8 and only.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_wrong_options():
    for wrong in ({"batch": "0", "fetcher": FOLDER}, {"fetcher": "json"}):
        with pytest.raises(ValueError):
            FD.BarReader({"tickers": "A", **wrong})


def test_http_feed(spark):
    """A server that is busy twice, doesn't know one ticker and leaves out a field."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            code = 404 if "NONE" in self.path else 503 if len(seen) <= 2 else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(b"Date,Close,Open,High,Volume\n2024-01-02T00:00:00-05:00,1.5,1,2,10\n2024-01-03,,1,2,\n")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = FD.read_bars(spark, ["BRK/B", "NONE"], "tidemark.sources.feed:http_csv", url=f"http://127.0.0.1:{server.server_port}/{{ticker}}.csv?p={{period}}", period="1 y", backoff=0).orderBy("ts").collect()
    finally:
        server.shutdown()
    assert [(r["ticker"], str(r["ts"]), r["open"], r["low"], r["close"], r["volume"], r["source"]) for r in rows] == [("NONE", "None", None, None, None, None, "missing"), ("BRK/B", "2024-01-02", 1.0, None, 1.5, 10.0, "feed"), ("BRK/B", "2024-01-03", 1.0, None, None, None, "feed")]
    assert seen[0] == "/BRK/B.csv?p=1%20y"


# Cache


def load(cache, tickers, cutoff="2024-01-05", place=None, **options):
    return cache.load(tickers, FOLDER, cutoff, path=f"{place}/feed", **({"backoff": 0} | options))


def test_cache_hit_partial_hit_and_stale(spark, place):
    cache = BC.BarCache(spark, f"{place}/cache")
    first = load(cache, ["A", "C"], place=place, now=dt.datetime(2024, 1, 6, 9))
    assert (first.absent, first.hit, first.published) == (["A", "C"], [], True) and first.bars.count() == 8
    # All there: the feed is not asked, so one that never answers does no harm.
    again = load(cache, ["C", "A", "A"], place=place, failing=99)
    assert (again.hit, again.absent, again.stale, again.published) == (["A", "C"], [], [], False) and again.bars.count() == 8
    some = load(cache, ["A", "B"], place=place)
    assert (some.hit, some.absent, some.published) == (["A"], ["B"], True) and some.bars.groupBy("ticker").count().count() == 2
    late = load(cache, ["A", "B"], "2024-01-09", place=place)
    assert late.stale == ["A", "B"] and late.published and late.bars.count() == 16
    assert cache.read(["A"]).count() == 8 and len(cache.files.names("parts")) == 3
    about = {r["ticker"]: (r["source"], r["last"]) for r in cache.sources(["A", "C", "X"]).collect()}
    assert about == {"A": ("feed", "2024-01-09"), "C": ("feed", "2024-01-05"), "X": ("missing", None)}


def test_nothing_is_published_if_a_ticker_fails(spark, place):
    cache = BC.BarCache(spark, f"{place}/cache")
    got = load(cache, ["A", "X"], place=place)
    assert not got.published and got.failed == {"X": "no data"} and got.bars.count() == 4
    assert cache.held().part == {} and cache.read().count() == 0
    assert load(cache, ["A"], place=place).absent == ["A"]
    # A stale ticker that fails keeps the bars it had.
    load(cache, ["C"], place=place)
    kept = load(cache, ["A", "C"], "2024-01-09", place=place, absent=json.dumps({"C": 99}))
    assert not kept.published and kept.failed == {"C": "no data"} and kept.bars.groupBy("ticker").count().orderBy("ticker").collect() == [("A", 8), ("C", 4)]
    assert cache.held().last == {"A": "2024-01-05", "C": "2024-01-05"}
    assert cache.clear() == 2 and cache.files.names() == []


def test_refresh_and_footers(spark, place):
    import pyarrow.parquet as pq

    cache = BC.BarCache(spark, f"{place}/cache")
    load(cache, ["A"], place=place, now=dt.datetime(2024, 1, 6, 9))
    load(cache, ["A"], place=place, refresh=True, now=dt.datetime(2024, 1, 7, 10))
    assert cache.held().fetched_at == {"A": "2024-01-07T10:00:00"} and len(cache.files.names("parts")) == 2
    newest = cache.files.names("parts")[-1]
    held = spark.read.parquet(f"{place}/cache/parts/{newest}/bars")
    assert held.schema["ts"].metadata == {"fetched_at": "2024-01-07T10:00:00"} and {r["source"] for r in held.collect()} == {"feed"}
    file = next(n for n in cache.files.names(f"parts/{newest}/bars") if n.endswith(".parquet"))
    assert b"2024-01-07T10:00:00" in pq.read_metadata(f"{place.removeprefix('file://')}/cache/parts/{newest}/bars/{file}").metadata[b"org.apache.spark.sql.parquet.row.metadata"]


def test_reads_prune_columns_and_push_tickers(spark, place, capsys):
    cache = BC.BarCache(spark, f"{place}/cache")
    load(cache, ["A", "B"], place=place)
    cache.close(["A"]).explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<ticker:string,ts:date,close:double>" in plan and "EqualTo(ticker,A)" in plan
    assert cache.read(["A"]).columns == ["ticker", "ts", *BC.FIELDS] and cache.close().columns == ["ticker", "ts", "close"]
    with pytest.raises(KeyError):
        cache.read(["A"], ("vwap",))


def test_requests_by_key(spark, place):
    ask = lambda tickers, **o: BC.get_prices(spark, tickers, "1y", "2024-01-05", f"{place}/requests", FOLDER, path=f"{place}/feed", **({"backoff": 0} | o))
    assert ask(["A", "B"]).published
    assert ask(["B", "A"], failing=99).hit == ["A", "B"]
    assert not ask(["A", "B"], adjusted=True, failing=99).published
    assert ask(["A", "B"], refresh=True).published and ask([]).bars.count() == 0
    assert not ask(["A", "X"]).published and ask(["A", "X"]).absent == ["A", "X"]
    assert BC.clear_requests(spark, f"{place}/requests") == 1 and not ask(["A", "B"], failing=99).published


def test_universe_through_the_cache(spark, place, tmp_path):
    file = tmp_path / "universe.json"
    file.write_text(json.dumps({"ratios": [{"pair": "A/B", "numerator": "A", "denominator": "B"}, {"pair": "A/X", "numerator": "A", "denominator": "X"}]}))
    got = BC.load_universe(spark, str(file), f"{place}/cache", FOLDER, "2024-01-08", path=f"{place}/feed", backoff=0)
    assert got.loaded.failed == {"X": "no data"} and got.series().count() == 4
    assert {r["ticker"]: (r["n_bars"], r["source"]) for r in got.coverage().collect()}["X"] == (0, "missing")
    file.write_text(json.dumps({"ratios": [{"pair": "A/B", "numerator": "A", "denominator": "B"}]}))
    got = BC.load_universe(spark, str(file), f"{place}/cache", FOLDER, "2024-01-08", path=f"{place}/feed", backoff=0)
    assert got.loaded.published and {tuple(r)[:2] for r in got.sources.select("ticker", "source").collect()} == {("A", "feed"), ("B", "feed")}
    assert P.cache_key(["B", "A"], "1y", "2024-01-05") == P.cache_key(["A", "B"], "1y", "2024-01-05") != P.cache_key(["A", "B"], "1y", "2024-01-05", True)
