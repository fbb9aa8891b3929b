from datetime import datetime, timedelta, timezone

T0 = datetime(2024, 3, 5, 14, 0, tzinfo=timezone.utc)
BARS = "bar_id long, symbol string, contract string, timeframe string, timestamp_utc timestamp, timestamp_ny timestamp_ntz, open double, high double, low double, close double, volume long, buy_volume long, sell_volume long"


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def walk(n: int, seed: int = 1, contract: str = "AAA", start: int = 1):
    """Plain bars of a random walk in ticks of 0.25, each opening where the last one closed."""
    import numpy as np

    rng = np.random.default_rng(seed)
    rows, price = [], 1000.0
    for i in range(n):
        close = price + 0.25 * float(rng.integers(-4, 5))
        high, low = max(price, close) + 0.25 * float(rng.integers(0, 3)), min(price, close) - 0.25 * float(rng.integers(0, 3))
        v = int(rng.integers(80, 160))
        rows.append([start + i, contract[:3], contract, "1m", at(i), None, price, high, low, close, v, v // 2, v - v // 2])
        price = close
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], BARS)
