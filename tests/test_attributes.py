import random
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tickloom.operators.attributes import attributes_at_event

EV = "trade_id string, contract string, entry_trigger_ts timestamp"
HI = "feature_id long, contract string, trade_date date, ema double, atr double, known_at timestamp"


def run(ev, hi, complete, **kw):
    out = attributes_at_event(ev, hi, event_id="trade_id", event_ts="entry_trigger_ts", entity="contract", attributes=["ema", "atr"], row_id="feature_id", valid_date="trade_date", known_at="known_at", complete=complete, **kw)
    return {r["trade_id"]: (r["ema_row"], r["atr_row"]) for r in out.collect()}


def brute(events, history, complete):
    out = {}
    first = {}
    for t, c, ts in events:
        if ts is not None and c is not None and (t not in first or (ts, (c or "").strip().upper()) < first[t]):
            first[t] = (ts, (c or "").strip().upper())
    for t, (ts, c) in first.items():
        d = (ts + timedelta(hours=6)).astimezone(ZoneInfo("America/New_York")).date()
        best = []
        for k in (3, 4):
            rows = [h for h in history if h[1] is not None and h[1].strip().upper() == c and h[k] is not None and (not complete or (h[3] is not None and h[4] is not None)) and h[2] is not None and h[5] is not None and h[2] < d and h[5] <= ts]
            best.append(max(rows, key=lambda h: (h[2], h[5], -h[0]))[0] if rows else None)
        if any(b is not None for b in best):
            out[t] = tuple(best)
    return out


def data(seed):
    r = random.Random(seed)
    start = datetime(2024, 3, 1, tzinfo=timezone.utc)
    events = [(f"t{r.randrange(50)}", r.choice(["aa", "AA ", "Bb", "zz", None]), start + timedelta(minutes=r.randrange(30 * 1440)) if r.random() > 0.05 else None) for _ in range(60)]
    history = []
    for i in range(150):
        d = date(2024, 2, 25) + timedelta(days=r.randrange(30))
        known = datetime(d.year, d.month, d.day, tzinfo=timezone.utc) + timedelta(minutes=r.choice([-500, 1200, 1300, 3000, 9000]))
        history.append((i, r.choice(["AA", "aa", "BB", None]), d if r.random() > 0.03 else None, None if r.random() < 0.2 else r.random(), None if r.random() < 0.2 else r.random(), known if r.random() > 0.03 else None))
    return events, history + history[:10]


def test_against_brute_force(spark):
    for seed in range(3):
        events, history = data(seed)
        ev, hi = spark.createDataFrame(events, EV), spark.createDataFrame(history, HI)
        for complete in (True, False):
            want = brute(events, history, complete)
            assert run(ev, hi, complete) == want
            assert run(ev, hi, complete, block_us=3 * 3_600_000_000) == want


def test_boundary_of_the_trade_date(spark):
    # the trade date turns at 18:00 New York: a row of the day becomes usable then, not before
    turn = datetime(2024, 3, 5, 23, 0, tzinfo=timezone.utc)
    hi = spark.createDataFrame([(1, "A", date(2024, 3, 5), 1.0, 1.0, turn - timedelta(days=1))], HI)
    ev = spark.createDataFrame([("x", "A", turn), ("y", "A", turn - timedelta(microseconds=1))], EV)
    assert run(ev, hi, True) == {"x": (1, 1)}


def test_nan_extra_columns_and_empty(spark):
    t = datetime(2024, 3, 9, tzinfo=timezone.utc)
    hi = spark.createDataFrame([(1, "A", date(2024, 3, 5), float("nan"), 1.0, t)], HI).withColumn("at_us", F.lit(1)).withColumn("trade_id", F.lit("q"))
    ev = spark.createDataFrame([("x", "A", t)], EV).withColumn("at_rank", F.lit(1))
    assert run(ev, hi, False) == {"x": (None, 1)}
    assert run(ev, hi, True) == {}
    assert run(ev.limit(0), hi.limit(0), True) == {}
