"""Queries of the training-data operators against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_dedup, queries, sql, url_filter

SF = "/root/testdata/sf0.001"


def rows(got):
    return sorted((tuple(r) for r in got), key=lambda r: [str(x) for x in r])


def same(df, con, text):
    cols = sorted(df.columns)
    theirs = con.sql(text)
    assert sorted(theirs.columns) == cols
    assert rows(df.select(*cols).collect()) == rows(theirs.select(*cols).fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


def test_links_equal_sql(spark):
    page = "<head><link rel='canonical' href=\"{}\"></head>"
    data = [
        (1, "https://a.example.org/en/1?x=1", page.format("https://b.example.net/de/1")),
        (2, "https://b.EXAMPLE.net/de/1#top", "<p>"),
        (3, "https://c.example.org/en/3", page.format("//a.example.org/en/1?x=1")),
        (4, "https://d.example.org/fr/4", page.format("https://c.example.org/en/3")),
        (5, "https://e.example.org/en/5", '<meta http-equiv="refresh" content="0; url=/en/6">'),
        (6, "https://e.example.org/en/6", page.format("https://example.com/de/9")),
        (7, "no scheme", page.format("z")),
        (8, None, "<p>"),
        (9, "https://f.example.org/en/x/9?q=1", page.format("../../de/./b/../9?k=2")),
        (10, "https://f.example.org/de/9?k=2", '<LINK href=z REL="alternate Canonical">'),
        (11, "https://f.example.org/de/z", "<link rel='canonical' href='//Example.com/de/x/..'>"),
        (12, "https://g.example.org", '<meta content="1; URL=?login=http://h.net/" http-equiv=refresh>'),
        (13, "https://g.example.org?login=http://h.net/", page.format("#top")),
        (14, "https://g.example.org/a/b/", page.format("..")),
        (15, "https://g.example.org/a/", page.format("/a/../b/.")),
        (16, "https://g.example.org/b/", page.format("mailto:x@b.net")),
        (17, "https://k.example.org/", '<link data-rel="canonical" href="http://b.net/"><link rel="canonical2" href="http://b.net/">'),
    ]
    hide = "<link rel=canonical href=https://b.net/>"
    data += [
        (20, "https://n.example.org/1", f"<!-- {hide} --><p>"),
        (21, "https://n.example.org/2", f"<script>var a = '{hide}';</script><style>{hide}</style><TITLE>{hide}</title >"),
        (22, "https://n.example.org/3", f"<!-- open {hide}"),
        (23, "https://n.example.org/4", f"<script>let x = 1 < 2 </scripts> {hide}"),
        (24, "https://n.example.org/5", f'<a title="{hide}">x</a><p data-x=\'{hide}\'>'),
        (25, "https://n.example.org/6", "<link data-x=' rel=canonical href=https://b.net/ ' rel=icon href=z><link-x rel=canonical href=https://b.net/>"),
        (26, "https://q.example.org/1", "<link data-x='a>b' rel=canonical href='https://c.net/?a=b&amp;c=d'>"),
        (27, "https://q.example.org/2", '<p don\'t><link title="it\'s > all" HREF="https://c.net/" rel = "canonical">'),
        (28, "https://q.example.org/3", "<!-- a --><script>1</script><link rel=canonical href=https://c.net/9>"),
        (29, "https://r.example.org/x/1", "<base href='/de/'><base href='https://b.net/'><link rel=canonical href=2>"),
        (30, "https://r.example.org/de/2", "<p>"),
        (31, "https://r.example.org/x/3", "<base target=_top><base href=//example.com/de/y/><meta http-equiv=refresh content='0;url=../z'>"),
        (32, "https://r.example.org/x/4", "<link rel=canonical href=z><base href='https://example.com/de/'>"),
        (33, "no scheme here", "<base href=rel/><link rel=canonical href=z>"),
        (34, "https://r.example.org/x/5", "<link rel=canonical href=>"),
    ]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", data)
    same(url_filter.judge(pages), con, sql.OP3)
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    later = {20: "allow", 21: "allow", 22: "allow", 23: "allow", 24: "allow", 25: "allow", 26: "block", 27: "block", 28: "block", 29: "allow", 30: "allow", 31: "block", 32: "block", 33: "allow", 34: "allow"}
    assert verdicts == later | {1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "block", 10: "block", 11: "block", 12: "allow", 13: "allow", 14: "allow", 15: "allow", 16: "allow", 17: "allow"}
    component = {r["page_id"]: r["component"] for r in url_filter.judge(pages).collect()}
    assert component[29] == component[30] is not None and all(component[i] is None for i in (20, 21, 22, 23, 24, 25, 33, 34))
    assert component[9] == component[10] == component[11] and component[12] == component[13] and component[14] == component[15] == component[16] and component[17] is None
    assert rows(url_filter.judge(pages, compiled=0).collect()) == rows(url_filter.judge(pages).collect())


def test_odd_documents_equal_sql(spark):
    data = [(1, None, None), (2, "", "a"), (3, "Word", None), (4, "word", "a"), (5, "the same words are here twice", "b"), (6, "The Same words are here  twice", "b"), (7, "\n\t ", "c"), (8, "a b", "d")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", data)
    same(near_dedup.classes(docs, shingle=2), con, sql.OP10)
    mixed = mixing.mix(docs)
    same(mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source"), con, sql.OP7)
