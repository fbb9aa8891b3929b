import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.helpers import BARS, at, frame, walk
from tickloom.operators import asof, features, islands, quality, registry, resample, stitch
from tickloom.runtime import barrier, durable
from tickloom.sources import broker
from tickloom.streaming.bars import run_once, stream_clean, stream_resample, stream_session_vwap, stream_stops, with_end


def bars(spark, n=200):
    return frame(spark, walk(n)).drop("symbol").withColumnRenamed("contract", "symbol")


def test_payloads(spark):
    good = {"Open": "1.5", "High": 2, "Low": "1", "Close": "1.75", "TotalVolume": "7"}
    rows = [(1, json.dumps(good)), (2, json.dumps(good | {"TotalVolume": None, "Volume": 9, "UpVolume": 4})), (3, json.dumps({k: v for k, v in good.items() if k != "Low"})), (4, None), (5, "{"), (6, json.dumps(good | {"Close": "n/a"}))]
    out = {r["id"]: r for r in broker.normalise_payload(spark.createDataFrame(rows, "id int, payload string")).collect()}
    assert out[1]["valid"] and out[1]["volume"] == 7 and out[1]["buy_volume"] is None and out[2]["volume"] == 9 and out[2]["buy_volume"] == 4
    assert not any(out[i]["valid"] for i in (3, 4, 5, 6))
    with pytest.raises(Exception, match="lacks a price"):
        broker.normalise_payload(spark.createDataFrame(rows[2:3], "id int, payload string"), strict=True).collect()


def test_windows_cover_without_overlap(spark):
    w = broker.fetch_windows(spark, "2024-01-01", "2024-04-01").orderBy("first").collect()
    assert all(b["first"] == a["last"] + 1 for a, b in zip(w, w[1:])) and w[-1]["last"] - w[0]["first"] == 91 * 86400
    assert broker.window_key("A", 1, 2) == broker.window_key("A", 1, 2) != broker.window_key("A", 1, 3)


def test_layer_round_trip_replaces_only_its_partitions(spark, tmp_path):
    b = bars(spark)
    path = broker.write_layer(b, str(tmp_path), "clean", {"minutes": 1})
    broker.write_layer(b.limit(5).withColumn("symbol", F.lit("BBB")), str(tmp_path), "clean", {"minutes": 1})
    assert spark.read.parquet(path).count() == 205
    m = broker.read_manifests(spark, f"{path}.manifest").first()
    assert m["layer"] == "clean" and m["row_count"] == 205 and m["parameters"]["minutes"] == "1"


def test_logs(spark, tmp_path):
    d = tmp_path / "day=2024-03-01"
    d.mkdir()
    (d / "a.jsonl").write_text('{"timestamp":"2024-03-01T10:00:00Z","level":"error","event":"x","run_id":"r"}\nnot json\n\n{"timestamp":"odd","level":"info","event":"y","run_id":"r"}\n')
    (tmp_path / "day=2024-03-02").mkdir()
    (tmp_path / "day=2024-03-02" / "b.jsonl").write_text('{"timestamp":"2024-03-02T10:00:00Z","level":"info","event":"z","run_id":"q"}\n')
    logs = broker.read_logs(spark, str(tmp_path))
    assert {r["event"] for r in logs.collect()} == {"x", "y", "z"}
    assert {r["event"] for r in broker.read_logs(spark, str(tmp_path), ["2024-03-02"]).collect()} == {"z"}
    assert {r["event"] for r in registry.read_logs(logs, errors_only=True).collect()} == {"x"}
    assert {r["event"] for r in registry.read_logs(logs, since="2024-03-02").collect()} == {"y", "z"}
    assert {r["event"] for r in registry.read_logs(logs, run_id="r", equal={"level": "info"}).collect()} == {"y"}


def test_lineage_and_retention(spark):
    m = spark.createDataFrame([("c", "2024-01-02", [("r", "", 1)]), ("r", "2024-01-03", []), ("f", "2024-01-04", [("c", "", 1), ("gone", "", 1)])], "path string, built_at string, sources array<struct<path:string,built_at:string,row_count:long>>")
    assert {(r["path"], r["source"], r["problem"]) for r in registry.stale(m).collect()} == {("c", "r", "newer"), ("f", "gone", "missing")}
    f = spark.createDataFrame([("c", "A", 1), ("c2", "A", 2), ("r", "B", 1), ("r2", "B", 2), ("z", "B", 0)], "path string, k string, at int")
    assert {r["path"] for r in registry.superseded(f, m, ["k"], "at").collect()} == {"z"}
    assert {r["path"] for r in registry.pinned(f, m).collect()} == {"c", "r"}
    runs = spark.createDataFrame([("s", f"r{i}", i, "validation" if i == 0 else "exploration") for i in range(5)], "strategy_id string, run_id string, ts int, mode string")
    assert {r["run_id"] for r in registry.keep_runs(runs, 2).collect()} == {"r1", "r2"}
    t = registry.migrate(spark.createDataFrame([("a", None)], "run_id string, mode string"), {"mode": F.lit("exploration"), "cohort_label": F.lit("old")}).first()
    assert (t["mode"], t["cohort_label"]) == ("exploration", "old")


def test_leaderboard_puts_missing_last(spark):
    t = spark.createDataFrame([("a", 1.0, "x"), ("b", None, "x"), ("c", float("nan"), "x"), ("d", 2.0, None), ("e", 3.0, "x")], "run_id string, calmar double, mode string")
    assert [r["run_id"] for r in registry.leaderboard(t, {"mode": "x"}, "calmar").collect()] == ["e", "a", "b", "c"]
    assert [r["run_id"] for r in registry.leaderboard(t, {}, "calmar", False).collect()] == ["a", "d", "e", "b", "c"]


def test_resample_nulls_and_gaps(spark):
    b = bars(spark, 30).where("minute(timestamp_utc) <> 7 and minute(timestamp_utc) not between 10 and 14")
    b = b.withColumn("buy_volume", F.when(F.minute("timestamp_utc") > 20, F.col("buy_volume")))
    r = resample.resample(b, 5).orderBy("timestamp_utc").collect()
    assert len(r) == 5 and r[0]["buy_volume"] is None and r[-1]["buy_volume"] is not None
    assert resample.resample_many(b, [5, 15]).count() == 5 + 2
    assert resample.resample(b.limit(0), 5).count() == 0


def test_asof_blocks_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", at(i), i) for i in (0, 5, 9, 500)] + [(None, at(5), 77), ("b", None, 78)], "k string, t timestamp, i int")
    right = spark.createDataFrame([("a", at(1), 1.0), ("a", at(5), 5.0), ("a", at(5), 6.0), ("a", None, 9.0), (None, at(1), 3.0)], "k string, t timestamp, v double")
    for block in (None, 3_600_000_000):
        out = {r["i"]: r["v"] for r in asof.asof_backward(left, right, ["k"], ["v"], left_ts="t", right_ts="t", block_us=block).collect()}
        assert {k: out[k] for k in (0, 5, 9, 500)} == {0: None, 5: 6.0, 9: 6.0, 500: 6.0} and out[78] is None
    out = {r["i"]: r["v"] for r in asof.asof_backward(left, right, ["k"], ["v"], left_ts="t", right_ts="t", strict=True).collect()}
    assert out[5] == 1.0
    assert asof.safe_prefix("60m") == "tf60m" and asof.safe_prefix("daily") == "daily"


def test_quality_taxonomy(spark):
    sessions = spark.createDataFrame([("S", at(0), at(600))], "symbol string, session_open timestamp, session_close timestamp")
    gone = set(range(10, 14)) | set(range(100, 140)) | set(range(500, 580))
    b = spark.createDataFrame([("S", at(i)) for i in range(600) if i not in gone], "symbol string, timestamp_utc timestamp")
    g = quality.classify_gaps(quality.missing_minutes(b, sessions)).orderBy("run_start").collect()
    assert [(x["bars_missing"], x["kind"]) for x in g] == [(4, "minor"), (40, "large"), (80, "large")]
    assert quality.unexpected_minutes(b, sessions).count() == 0
    assert quality.session_coverage(b, sessions).first()["bars"] == 600 - len(gone)
    assert islands.minute_runs(b, ["symbol"]).count() == 4


def test_calendars(spark):
    c = stitch.contract_calendar(spark, "ZN", date(2024, 1, 1), date(2024, 12, 31)).collect()
    assert [r["contract"] for r in c][:4] == ["ZNH24", "ZNM24", "ZNU24", "ZNZ24"] and all(b["data_start"] == a["roll"] for a, b in zip(c, c[1:]))
    assert stitch.last_business_day(2024, 3) == date(2024, 3, 29) and stitch.business_days_before(date(2024, 3, 29), 7) == date(2024, 3, 20)
    days = {r["trade_date"] for r in stitch.session_calendar(spark, date(2022, 6, 1), date(2022, 6, 30)).collect()}
    assert date(2022, 6, 20) not in days and date(2022, 6, 18) not in days and date(2022, 6, 17) in days


def test_feature_sets():
    v2 = features.resolve(features.BASE_V2, {"base-v1": features.BASE_V1})
    assert {"kind": "cci", "n": 14} in v2["features"] and {"kind": "atr", "n": 14} in v2["features"]
    turned = features.BASE_V1 | {"features": features.BASE_V1["features"][::-1]}
    assert features.feature_hash(turned) == features.feature_hash(features.BASE_V1) != features.feature_hash(v2)


def test_streams_equal_batches(spark, tmp_path):
    from tickloom.schema import clean_bars

    rows = walk(120)
    rows += [[500 + i, *rows[i][1:]] for i in range(20, 40)]  # delivered again
    rows.append([900, *rows[50][1:9], rows[50][9] + 5, *rows[50][10:]])  # a second bar at one instant
    rows.append([901, "AAA", "AAA", "1m", at(60.5), None, 1.0, 2.0, 3.0, 1.0, 5, 2, 3])  # high below low
    b = frame(spark, rows).drop("timestamp_ny").selectExpr("*", "cast(null as long) up_ticks", "cast(null as long) down_ticks", "cast(null as long) total_ticks")
    for part in (b.where("bar_id <= 60"), b.where("bar_id > 60")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = [tuple(r) for r in run_once(stream_resample(stream_clean(with_end(read(), str(tmp_path / "end")), "1 day"), 15, None), str(tmp_path / "s1")).collect()]
    w = {tuple(r) for r in resample.resample(clean_bars(b), 15).select("symbol", "timestamp_utc", "open", "high", "low", "close", "volume").collect()}
    assert len(s) == len(w) == 8 and set(s) == w
    one = frame(spark, walk(120)).drop("timestamp_ny")
    one.coalesce(1).write.parquet(str(tmp_path / "one"))
    v = run_once(stream_session_vwap(spark.readStream.schema(one.schema).parquet(str(tmp_path / "one")), late="1 day"), str(tmp_path / "s2"), "complete").collect()
    assert len(v) == 1 and v[0]["volume"] == one.agg(F.sum("volume")).first()[0] and v[0]["batch"] == 0


def test_stream_positions_cross_batches(spark, tmp_path):
    rows = [("S", at(i), 10.0 + i + 0.5, 9.5 + i, 10.0 + i, 1 if i == 1 else 0, 5.0, 14.2) for i in range(8)]
    schema = "symbol string, timestamp_utc timestamp, high double, low double, close double, signal int, stop double, target double"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(spark.createDataFrame(rows, schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_once(stream_stops(src), str(tmp_path / "s3")).collect()
    assert [(r["exit_reason"], r["entry_price"], r["exit_price"]) for r in out] == [("target", 11.0, 14.2)]


def test_registry_merge_diff_and_orphans(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, None)], "run_id string, ts int, v string")
    new = spark.createDataFrame([("b", 2, "z", 1), ("c", 0, None, 1), ("d", 1, "w", 1)], "run_id string, ts int, v string, extra int")
    assert {r["run_id"]: (r["v"], r["extra"]) for r in registry.merge(old, new).collect()} == {"a": ("x", None), "b": ("z", 1), "c": (None, None), "d": ("w", 1)}
    assert {tuple(r) for r in registry.diff(old, new, ["v"]).collect()} == {("a", "removed", None), ("b", "changed", "v"), ("d", "added", None)}
    trials = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", None)], "run_id string, sweep_id string")
    assert [r["run_id"] for r in registry.orphans(trials, trials.where("sweep_id = 's1'")).collect()] == ["b"]


@pytest.mark.parametrize("block", [1, 3, 50])
def test_places_and_streaks_over_blocks(spark, block):
    import random

    from tickloom.operators.ranks import places

    r = random.Random(block)
    rows = [(r.choice("ab"), i, r.random() < 0.6) for i in range(200)] + [(None, 7, True), (None, 9, True)]
    df = spark.createDataFrame(rows, "k string, i int, v boolean")
    got = {(x["k"], x["i"]): (x["n"], x["t"]) for x in places(df, ["k"], ["i"], F.floor(F.col("i") / block), "n", "t").collect()}
    for k in ("a", "b", None):
        own = sorted(i for q, i, _ in rows if q == k)
        assert [got[k, i] for i in own] == [(j + 1, len(own)) for j in range(len(own))]
    s = sorted((x["k"], x["island"], x["value"], x["length"]) for x in islands.streaks(df.where("k is not null"), ["k"], ["i"], F.col("v"), F.floor(F.col("i") / block)).collect())
    want = []
    for k in "ab":
        runs = []
        for v in [v for q, _, v in rows if q == k]:
            if runs and runs[-1][0] == v:
                runs[-1][1] += 1
            else:
                runs.append([v, 1])
        want += [(k, j + 1, v, n) for j, (v, n) in enumerate(runs)]
    assert s == want


def test_durable_and_barrier(spark):
    d = durable(spark.range(5).withColumn("x", F.col("id") * 2))
    assert d.count() == 5 and barrier(d).where("x > 4").count() == 2
    assert spark.createDataFrame([], BARS).count() == 0


def test_values_at_a_bars_open(spark):
    times = [0.2, 0.7, 3, 14, 16.5, 17, 45.1, 61]
    rows = spark.createDataFrame([("S", at(m), float(i)) for i, m in enumerate(times)], "symbol string, timestamp_utc timestamp, v double")
    got = {r["timestamp_utc"].minute + 60 * r["timestamp_utc"].hour - 840: r["v"] for r in features.at_open(rows, 15, ["v"]).collect()}
    # the last of the first minute; the bar before's last where the first minute is empty
    assert got == {0: 1.0, 15: 3.0, 45: 6.0, 60: 6.0}
