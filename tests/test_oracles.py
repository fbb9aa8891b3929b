"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import os
from collections import Counter

import pytest

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


def rows(df):
    import pandas as pd

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
            return None
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v).tz_localize(None) if getattr(v, "tzinfo", None) else pd.Timestamp(v))
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        return f"{float(v) + 0.0:.8g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    df = df[sorted(df.columns)]
    return Counter(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


def names():
    import __spark_entry__ as e

    return sorted(e.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_same_rows(spark, db, name):
    import __spark_entry__ as e

    got, want = e.queries()[name](spark, FOLDER).toPandas(), db.sql(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
