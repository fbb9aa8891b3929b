"""The bar-by-bar trade simulator.

One position at a time per (run, symbol, fold). Within a bar: forced exits at the close (end of day, holding limit), then stop and
target at their level (the stop if both, unless order flow speaks for the target), then scaling in, then exit on an opposing
signal, after which the same signal may open the other way. Entries fill at the next open with slippage. Path dependence
makes this a state machine over arrays; runs, symbols and folds are its parallelism. Flat stretches are skipped to the next
signal.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.segments import map_sorted_groups

SCHEMA = """run_id string, symbol string, fold int, trade_id string, leg int, direction string, quantity long, entry_trigger_ts timestamp, entry_ts timestamp, entry_price double,
 exit_trigger_ts timestamp, exit_ts timestamp, exit_price double, exit_reason string, initial_stop double, initial_target double, pnl_points double, pnl_usd double, slippage_usd double,
 commission_usd double, net_pnl_usd double, mae_points double, mfe_points double"""
#: Columns that override the rules for a series, such as an instrument's own tick, point value and commission.
COSTS = ["tick_size", "point_value", "slippage_ticks", "commission_per_side"]
_TS = pa.timestamp("us", tz="UTC")


@dataclass(frozen=True)
class Rules:
    tick_size: float = 0.25
    point_value: float = 50.0
    slippage_ticks: float = 1.0
    commission_per_side: float = 2.0
    quantity: int = 1
    same_bar: bool = False
    same_bar_reason: str = ""
    eod_flat: bool = True
    rth_close_minute: int = 960
    max_holding_bars: int | None = None
    use_order_flow: bool = False
    scale_in_atr: float | None = None
    max_scale_ins: int = 1
    scale_target_atr: float = 0.3

    def __post_init__(self):
        if self.same_bar and not self.same_bar_reason.strip():
            raise ValueError("filling on the signal's own bar needs a reason")


def run_bars(ts, o, h, l, c, flow, signal, stop, target, minute, atr, rules: Rules, size=None, leave=None, more=None) -> list[dict]:  # noqa: E741
    """Closed legs of one series; indices stand for times.

    ``size``: contracts of an entry on this bar, none suppresses it. ``leave``: on which sides (1, -1, or 2 for both) the strategy's own exit
    rule closes a position at the next open. ``more``: on which side it asks to scale in.
    """
    n = len(ts)
    slip, legs = rules.slippage_ticks * rules.tick_size, []
    entries = np.flatnonzero(signal)
    side = 0

    def close(i: int, price: float, at: int, reason: str) -> None:
        low, high = worst
        for leg in range(len(opened)):
            e, size, trig, fill = opened[leg]
            points = side * (price - e)
            money = points * rules.point_value * size
            costs = rules.slippage_ticks * rules.tick_size * rules.point_value * 2 * size, rules.commission_per_side * 2 * size
            legs.append({"leg": leg, "direction": "long" if side > 0 else "short", "quantity": size, "trigger": trig, "fill": fill, "entry_price": e, "exit_trigger": i, "exit": at, "exit_price": price, "exit_reason": reason, "initial_stop": first_stop, "initial_target": first_target,
                         "pnl_points": points, "pnl_usd": money, "slippage_usd": costs[0], "commission_usd": costs[1], "net_pnl_usd": money - costs[0] - costs[1],
                         "mae_points": side * (e - (low if side > 0 else high)), "mfe_points": side * ((high if side > 0 else low) - e)})

    i = 0
    while i < n:
        if side:
            held += 1
            worst = (min(worst[0], l[i]), max(worst[1], h[i]))
            late = rules.max_holding_bars is not None and held >= rules.max_holding_bars
            if (rules.eod_flat and minute[i] >= rules.rth_close_minute) or late:
                close(i, c[i] - side * slip, i, "eod" if rules.eod_flat and minute[i] >= rules.rth_close_minute else "time_limit")
                side = 0
                i += 1
                continue
            hit_stop = l[i] <= level if side > 0 else h[i] >= level
            hit_target = not math.isnan(goal) and (h[i] >= goal if side > 0 else l[i] <= goal)
            if hit_stop and hit_target and rules.use_order_flow and side * flow[i] > 0:
                hit_stop = False
            if hit_stop or hit_target:
                close(i, level if hit_stop else goal, i, "stop" if hit_stop else "target")
                side = 0
                i += 1
                continue
            asked = more is not None and more[i] in (side, 2) and scaled < rules.max_scale_ins and i > anchor and i + 1 < n and not math.isnan(atr[i])
            if asked or rules.scale_in_atr is not None and signal[i] == side and scaled < rules.max_scale_ins and i > anchor and i + 1 < n and not math.isnan(atr[i]):
                price = o[i + 1] + side * slip
                if asked or side * (price - opened[0][0]) >= -rules.scale_in_atr * atr[i]:
                    opened.append((price, opened[0][1] if size is None else max(int(size[i]), 1), i, i + 1))
                    whole = sum(x[1] for x in opened)
                    goal = sum(x[0] * x[1] for x in opened) / whole + side * rules.scale_target_atr * atr[i]
                    scaled, anchor = scaled + 1, i
            if signal[i] == -side or leave is not None and leave[i] in (side, 2):
                at = min(i + 1, n - 1)
                close(i, o[at] - side * slip, at, "signal" if signal[i] == -side else "rule")
                side = 0
        if not side:
            if signal[i] and i + 1 < n and not math.isnan(stop[i]) and (size is None or size[i] > 0):
                side = int(signal[i])
                price = c[i] if rules.same_bar else o[i + 1] + side * slip
                opened, held, scaled, anchor = [(price, rules.quantity if size is None else int(size[i]), i, i + 1)], 0, 0, i
                level, goal = stop[i], target[i]
                first_stop, first_target = level, goal
                worst = (math.inf, -math.inf)
            else:
                k = np.searchsorted(entries, i, side="right")
                i = int(entries[k]) if k < len(entries) else n
                continue
        i += 1
    if side:
        if not math.isfinite(worst[0]):
            worst = (l[n - 1], h[n - 1])
        close(n - 1, c[n - 1], n - 1, "eod")
    return legs


def _group(rules_of: dict[str, Rules] | Rules):
    def run(t: pa.Table) -> pa.RecordBatch | None:
        f = lambda name: t[name].to_numpy().astype("float64")
        run_id, symbol, fold = (t[k][0].as_py() for k in ("run_id", "symbol", "fold"))
        rules = rules_of if isinstance(rules_of, Rules) else rules_of[run_id]
        us = t["us"].to_numpy()
        own = {k: v for k in COSTS if k in t.column_names and (v := t[k][0].as_py()) is not None}
        rules = replace(rules, **own) if own else rules
        asked = {k: t[k].fill_null(0).to_numpy() for k in ("size", "leave", "more") if k in t.column_names}
        legs = run_bars(us, *(f(x) for x in ("open", "high", "low", "close", "flow")), t["signal"].to_numpy().astype("int64"), f("stop"), f("target"), t["minute"].to_numpy(), f("atr"), rules, **asked)
        if not legs:
            return None
        when = lambda k: pa.array([int(us[x[k]]) for x in legs], pa.int64()).cast(_TS)
        get = lambda k, kind: pa.array([x[k] for x in legs], kind, from_pandas=True)
        ids = [hashlib.sha1(f"{run_id}|{symbol}|{fold}|{us[x['fill']]}|{x['leg']}".encode()).hexdigest()[:16] for x in legs]
        n = len(legs)
        cols = {"run_id": pa.array([run_id] * n), "symbol": pa.array([symbol] * n), "fold": pa.array([fold] * n, pa.int32()), "trade_id": pa.array(ids), "leg": get("leg", pa.int32()), "direction": get("direction", pa.string()), "quantity": get("quantity", pa.int64()),
                "entry_trigger_ts": when("trigger"), "entry_ts": when("fill"), "entry_price": get("entry_price", pa.float64()), "exit_trigger_ts": when("exit_trigger"), "exit_ts": when("exit"), "exit_price": get("exit_price", pa.float64()), "exit_reason": get("exit_reason", pa.string())}
        cols |= {k: get(k, pa.float64()) for k in ("initial_stop", "initial_target", "pnl_points", "pnl_usd", "slippage_usd", "commission_usd", "net_pnl_usd", "mae_points", "mfe_points")}
        return pa.RecordBatch.from_pydict(cols)

    return run


def simulate(signals: DataFrame, rules: Rules | dict[str, Rules]) -> DataFrame:
    """Trades of signal frames. ``run_id`` and ``fold`` default to one run and fold; ``rules`` may differ by run.

    A strategy's own decisions are columns of its frame, all optional: ``size`` (contracts of an entry), ``leave`` and ``more`` (exit and
    scale-in requests by side, see run_bars). Columns named as in COSTS override the rules' costs for their series.
    """
    s = signals
    if "run_id" not in s.columns:
        s = s.withColumn("run_id", F.lit("run"))
    if "fold" not in s.columns:
        s = s.withColumn("fold", F.lit(0))
    local = F.from_utc_timestamp("timestamp_utc", "America/New_York")
    total = F.nullif((F.col("buy_volume") + F.col("sell_volume")).cast("double"), F.lit(0.0)) if "buy_volume" in s.columns else F.lit(None).cast("double")
    flow = F.coalesce((F.col("buy_volume") - F.col("sell_volume")) / total, F.lit(0.0)) if "buy_volume" in s.columns else F.lit(0.0)
    atr = F.col("atr_14").cast("double") if "atr_14" in s.columns else F.lit(None).cast("double")
    d = lambda c: F.col(c).cast("double").alias(c)
    s = s.select("run_id", "symbol", F.col("fold").cast("int").alias("fold"), F.unix_micros("timestamp_utc").alias("us"), *map(d, ("open", "high", "low", "close")), flow.alias("flow"), F.coalesce(F.col("signal"), F.lit(0)).cast("int").alias("signal"), d("stop"), d("target"), (F.hour(local) * 60 + F.minute(local)).alias("minute"), atr.alias("atr"), *[F.col(k).cast("int").alias(k) for k in ("size", "leave", "more") if k in s.columns], *[d(k) for k in COSTS if k in s.columns])
    return map_sorted_groups(s, ["run_id", "symbol", "fold"], ["us"], _group(rules), SCHEMA)
