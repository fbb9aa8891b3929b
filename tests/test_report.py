"""dq_report: the calendar of a series is counted, never listed or sent to the driver; series of one contract, lost keys and the order of deliveries."""

from datetime import datetime, timedelta, timezone

from tests.test_whole_job import same_as_oracle, save

BARS = "bar_id long, contract string, timeframe string, timestamp_utc timestamp, open double, high double, low double, close double, volume long, buy_volume long, sell_volume long, up_ticks long, down_ticks long, total_ticks long"
AT = datetime(2024, 3, 5, 15, 0, tzinfo=timezone.utc)


def bar(i, contract, timeframe, ts, close=1.5):
    return (i, contract, timeframe, ts, 1.0, 2.0, 1.0, close, 5, 2, 3, 1, 1, 2)


def test_a_long_calendar_is_not_broadcast(spark, tmp_path):
    # two bars of one contract, 208 weeks apart
    save(spark, tmp_path, "bars", [bar(1, "A", "1m", AT), bar(2, "A", "1m", AT + timedelta(days=4 * 364))], BARS)
    import __spark_entry__ as e

    df = e.queries()["dq_report"](spark, str(tmp_path))
    row = df.collect()[0]
    assert row["missing_periods"] + 2 == 1380 * (row["empty_sessions"] + 2) and row["empty_sessions"] > 1000
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in ran and "Broadcast" not in ran


def test_series_of_one_contract_share_its_sessions(spark, tmp_path):
    days = [AT + timedelta(days=d) for d in (0, 3, 6, 9)]
    rows = [bar(i, "A", tf, d + timedelta(minutes=k)) for i, (tf, k, d) in enumerate((tf, k, d) for tf, k in (("1m", 0), ("5m", 5), ("1h", 240)) for d in days)]
    rows += [bar(100, "A", "1m", datetime(2024, 3, 9, 15, 0, tzinfo=timezone.utc)), bar(101, "A", "1m", AT + timedelta(seconds=20)), bar(102, "A", "1m", AT, None)]
    rows += [bar(103, "A", "5m", None), bar(104, "A", "5m", None), bar(105, None, "1m", AT), bar(106, None, "1m", AT), bar(107, "B", "1h", AT), bar(108, "C", "1m", None)]
    save(spark, tmp_path, "bars", rows, BARS)
    got = same_as_oracle(spark, tmp_path, "dq_report").set_index("symbol")
    # trade dates 5, 8, 11 and 14 March have bars; of 5 to 14 March without the weekend 6, 7, 12 and 13 have none
    assert got.loc["A", "empty_sessions"] == 4 and got.loc["A", "missing_periods"] == 8 * (1380 + 276) - 8
    # a Saturday's bar and bars without an instant are expected nowhere
    assert got.loc["A", "unexpected_periods"] == 2 and got.loc["C", "unexpected_periods"] == 1
    assert got.loc["B", "missing_periods"] == 0 and got.loc["B", "empty_sessions"] == 0


def test_a_bar_without_id_comes_after_those_with_one(spark, tmp_path):
    save(spark, tmp_path, "bars", [bar(None, "A", "1h", AT), bar(7, "A", "1m", AT)], BARS)
    import __spark_entry__ as e

    row = e.queries()["dq_report"](spark, str(tmp_path)).first()
    assert row["missing_periods"] == 1379 and row["duplicates"] == 1
