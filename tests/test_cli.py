import json

import pytest

from tests.helpers import frame, walk
from tickloom import cli
from tickloom.operators import asof


def test_pipeline_backtest_and_report(spark, tmp_path):
    rows = walk(3000, 3)
    frame(spark, rows).selectExpr("*", "cast(null as long) up_ticks", "cast(null as long) down_ticks", "cast(null as long) total_ticks").write.parquet(str(tmp_path / "bars.parquet"))
    paths = cli.pipeline(spark, str(tmp_path), str(tmp_path / "layers"), (5, 15), (5,))
    assert len(paths) == 4 and spark.read.parquet(paths[0]).count() == 3000
    config = {"knobs": {"m": 2.0}, "entry": {"long": {"all": ["close < bb_lower"]}, "short": {"all": ["close > bb_upper"]}}, "exits": {"stop": {"long": "close - m * atr_14", "short": "close + m * atr_14"}, "target": {"long": "bb_mid", "short": "bb_mid"}}, "backtest": {"quantity": 2, "fill_model": "next_bar_open"}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    t = cli.backtest(spark, cli.load_config(str(tmp_path / "c.json")), paths[-1])
    assert t.count() > 5 and t.first()["quantity"] == 2
    s = cli.backtest(spark, config, paths[-1], sweep={"m": [1.0, 3.0]})
    assert {r["run_id"] for r in s.select("run_id").distinct().collect()} == {"v0000", "v0001"}
    tables = cli.report(t)
    assert tables["summary"].first()["total_trades"] == t.count() and tables["heatmap"].count() == 120
    assert all(d.limit(1).count() >= 0 for d in tables.values())
    cli.main(["inventory", "--root", str(tmp_path / "layers")])


def test_gate_stops(spark, tmp_path):
    rows = walk(50)
    for r in rows[10:20]:
        r[10] = -r[10]
    frame(spark, rows).selectExpr("*", "cast(null as long) up_ticks", "cast(null as long) down_ticks", "cast(null as long) total_ticks").write.parquet(str(tmp_path / "bars.parquet"))
    with pytest.raises(SystemExit, match="gate failed for AAA .10 of 50."):
        cli.pipeline(spark, str(tmp_path), str(tmp_path / "layers"), (5,), ())
    assert len(cli.pipeline(spark, str(tmp_path), str(tmp_path / "layers"), (5,), (), most_removed=0.5)) == 3


def test_large_and_negative_readings_stay(spark):
    from tickloom.schema import clean_bars, left_out

    rows = walk(5)
    rows[1][10] = 5_000_000
    rows[2][6:10] = [-3.0, -2.0, -40.0, -37.6]
    rows[3][9] = None
    rows.append(list(rows[0]))
    rows[-1][0] = 77
    df = frame(spark, rows).selectExpr("*", "cast(null as long) up_ticks", "cast(null as long) down_ticks", "cast(null as long) total_ticks")
    kept = {r["timestamp_utc"]: r for r in clean_bars(df).collect()}
    assert len(kept) == 4 and {5_000_000} <= {r["volume"] for r in kept.values()} and -37.6 in {r["close"] for r in kept.values()}
    assert {r["bar_id"]: r["left_out"] for r in left_out(df).collect()} == {1: None, 2: None, 3: None, 4: "null_close", 5: None, 77: "redelivered"}


def test_nearest_against_brute_force(spark):
    import random
    from datetime import timedelta

    from tests.helpers import T0

    r = random.Random(2)
    ls = [(i, r.choice("ab"), T0 + timedelta(minutes=r.randrange(1500))) for i in range(80)] + [(99, None, T0), (98, "a", None)]
    rs = [(r.choice("ab"), T0 + timedelta(minutes=r.randrange(1500)), i) for i in range(120)]
    out = {x["i"]: x["v"] for x in asof.asof_nearest(spark.createDataFrame(ls, "i int, k string, t timestamp"), spark.createDataFrame(rs, "k string, timestamp_utc timestamp, v int"), ["k"], ["v"], left_ts="t", tolerance_us=600_000_000, block_us=1_200_000_000).collect()}
    for i, k, t in ls:
        c = [(abs(t - rt), rt, v) for rk, rt, v in rs if k is not None and t is not None and rk == k and abs(t - rt) <= timedelta(minutes=10)]
        assert out[i] == (min(c)[2] if c else None)
