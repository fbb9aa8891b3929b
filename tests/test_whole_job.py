"""Queries do the whole of what they promise: rows that a narrower reading would leave out."""

import pytest


def save(spark, folder, name, rows, schema):
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")  # DuckDB reads the default as times without zone
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    spark.conf.unset("spark.sql.parquet.outputTimestampType")


def same_as_oracle(spark, folder, name):
    """The query's rows, after they were found to be those of its oracle."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e
    from tests.test_oracles import rows

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in folder.iterdir():
        c.execute(f"create view {f.stem} as select * from '{f}/*.parquet'")
    got = e.queries()[name](spark, str(folder)).toPandas()
    assert rows(got) == rows(c.sql(e.oracle_sql()[name]).df())
    return got


def test_counts_declared_as_text(spark, tmp_path):
    manifests = ['{"row_count":"3"}', '{"rows":" 2 "}', '{"record_count":4}', '{"row_count":"many","n_rows":"2.0"}', '{"row_count":null}', '{"n_rows":"1"}']
    save(spark, tmp_path, "raw_files", list(enumerate(manifests)), "file_id long, manifest string")
    save(spark, tmp_path, "raw_records", [(i,) for i in range(6)], "file_id long")
    got = same_as_oracle(spark, tmp_path, "reg_manifests")
    told = got[got.declared.notna()]
    assert dict(zip(told.file_id, told.declared)) == {0: 3, 1: 2, 2: 4, 3: 2} and got[got.declared.isna()].file_id.tolist() == [4]


def test_sessions_of_every_month(spark, tmp_path):
    from datetime import datetime, timezone

    days = [(1, 29), (2, 1), (4, 30), (6, 21)]
    rows = [(i, c, "1m", datetime(2024, *d, 15, 0, tzinfo=timezone.utc), 1.0, 2.0, 1.0, 1.5, 5, 2, 3, 1, 1, 2) for i, (c, d) in enumerate([("A", x) for x in days] + [("B", (5, 2))])]
    save(spark, tmp_path, "bars", rows, "bar_id long, contract string, timeframe string, timestamp_utc timestamp, open double, high double, low double, close double, volume long, buy_volume long, sell_volume long, up_ticks long, down_ticks long, total_ticks long")
    got = same_as_oracle(spark, tmp_path, "dq_session_coverage")
    # weekdays from 29 January to 21 June without 19 June, and the one day of B
    assert len(got) == 104 + 1 and got.bars.sum() == 5 and (got.bars == 0).sum() == 100


def test_joins_that_look_ahead_are_counted(spark):
    from pyspark.sql import functions as F

    from tests.helpers import frame, walk
    from tickloom.operators import asof, quality, resample

    b = frame(spark, walk(300)).drop("contract", "timestamp_ny")
    hour = F.floor(F.unix_seconds("timestamp_utc") / 3600)
    h = resample.resample(b, 60)
    sound = asof.higher_timeframe(b.select("symbol", "timestamp_utc"), h, ["close"], "h_")
    ahead = asof.asof_backward(b.select("symbol", "timestamp_utc"), h, ["symbol"], ["close"], prefix="h_")
    count = lambda joined: quality.shift_breaks(b, joined, "h_close", hour).first()["breaks"]
    assert count(sound) == 0 and count(ahead) > 200 and count(sound.limit(100)) > 0


def test_registered_queries_draw_the_surveyed_numbers(spark, monkeypatch):
    import __spark_entry__ as e
    from tickloom.operators import resampling

    drawn = []
    samples, means = resampling.samples, resampling._mean_samples
    monkeypatch.setattr(resampling, "samples", lambda t, k, n=1000, *a, **kw: drawn.append(n) or samples(t, k, n, *a, **kw))
    monkeypatch.setattr(resampling, "_mean_samples", lambda t, k, n, *a: drawn.append(n) or means(t, k, n, *a))
    for name in ("rs_bootstrap", "rs_shuffle", "rs_hash_bootstrap", "rs_generic_bootstrap"):
        e.queries()[name](spark, "/root/testdata/sf0.001")
    assert [n for n in drawn if n > 1] == [1000, 1000, 1000, 10_000]


def test_every_month_and_every_pair_of_runs(spark):
    import __spark_entry__ as e

    folder = "/root/testdata/sf0.001"
    assert {f"m{m:02d}" for m in range(1, 13)} <= set(e.queries()["met_calendar"](spark, folder).columns)
    c = e.queries()["port_rolling_correlation"](spark, folder).select("run_a", "run_b").distinct().count()
    n = e.queries()["log_equity"](spark, folder).select("run_id").distinct().count()
    assert c == n * (n - 1) // 2
