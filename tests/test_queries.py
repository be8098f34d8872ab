"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    """Every query that has SQL, value by value."""
    ours = catalog.queries()[name](spark, SF).toPandas()
    theirs = con.sql(catalog.oracle_sql()[name]).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns) and len(ours) == len(theirs)
    for d in (ours, theirs):
        for c in names:
            if d[c].dtype.kind in "fiu":
                d[c] = d[c].astype(float)
            else:
                d[c] = d[c].astype(str)
    exact = [c for c in names if ours[c].dtype.kind != "f"]
    order = exact + [c for c in names if c not in exact]
    a, b = (x.sort_values(order).reset_index(drop=True) for x in (ours, theirs))
    for c in names:
        if a[c].dtype.kind == "f":
            assert ((a[c] - b[c]).abs().fillna(0) < 2e-6).all() and (a[c].isna() == b[c].isna()).all(), c
        else:
            assert (a[c] == b[c]).all(), c
