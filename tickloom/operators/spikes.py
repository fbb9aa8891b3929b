"""False readings of bars: spikes, frozen values and impossible ones.

Every contract is filtered by local-level state-space models. The Kalman filter walks over a bar's open and close in log
price, over the upper and lower wick beyond its filtered body, and over log volume; each of these has a state of its
own. Innovations are standardised by the predicted variance, which scales with the contract's own noise, with the time since
the last bar and, in bursts, with the recent innovations. A reading whose innovation is too large is withheld from the
update. Whether it *lasts* is told by the bars after it: a level that the next open or the following bars confirm is a true
jump, and the state moves there.

A stuck source is one whose innovations lose their variance. Every field is also followed by a random walk observed without
noise, whose innovation is the change of the reading; and every bar by the steps from the last close to its open, to its
close and to its ends, which a replayed bar repeats one by one. Where these do not vary at all, a recursion carries
the likelihood of that, shrinking at each step by the contract's own share of innovations that do not vary; the stretch is
frozen once it falls below chance.

Contracts are filtered in blocks of time with an overlap on both sides that serves to settle the filter and to see what
lasts, so one huge contract is many tasks; per block the noise parameters are robust medians. Only verdicts of rows
within the block are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.grid import period_seconds
from tickloom.operators.segments import map_sorted_groups
from tickloom.runtime import table

#: Standardised innovations from here on are withheld: of the close against the level, of the wicks, of log volume.
CLOSE_Z, WICK_Z, VOLUME_Z = 7.0, 7.5, 6.0
#: Least factor by which a false volume exceeds what is expected.
VOLUME_RATIO = 12.0
#: Log-odds against chance, beyond one stretch per block, from which innovations without variance mean a frozen source.
FROZEN_ODDS = 6.0
BLOCK_PERIODS = 32_768
OVERLAP_PERIODS = 2_048
#: Bars after a withheld reading that may confirm it.
LOOKAHEAD = 3


def _noise(x: np.ndarray, floor: float) -> float:
    """A robust standard deviation: root mean square with moves cut at three times their usual size."""
    x = np.abs(x[np.isfinite(x)])
    moved = x[x > 0]
    if not len(moved):
        return floor
    return max(float(np.sqrt(np.mean(np.minimum(x, 3 * 1.4826 * np.median(moved)) ** 2))), floor)


def price_filter(us, o, h, l, c, period_us):  # noqa: E741
    """Flags (high, low, close) of bars in order of time; NaN stands for null."""
    n = len(us)
    bad_h, bad_l, bad_c = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    with np.errstate(all="ignore"):
        for x, bad in ((h, bad_h), (l, bad_l), (c, bad_c)):
            bad |= ~np.isnan(x) & (~np.isfinite(x) | (x <= 0))
        crossed = h < l
        bad_h |= crossed
        bad_l |= crossed
        lo, lh, ll, lc = (np.where(np.isfinite(x) & (x > 0), np.log(np.abs(x)), np.nan) for x in (o, h, l, c))
        level = np.nanmedian(np.r_[lo, lc]) if n else np.nan
        if not np.isfinite(level):
            return bad_h, bad_l, bad_c
        steps = np.r_[lc - lo, lo[1:] - lc[:-1]]
        tick = steps[np.isfinite(steps) & (np.abs(steps) > 1e-9)]
        tick = float(np.quantile(np.abs(tick), 0.02)) if len(tick) else 1e-5
        floor = tick / 4
        body = _noise(lc - lo, floor)
        upper = _noise(lh - np.fmax(lo, lc), floor)
        lower = _noise(np.fmin(lo, lc) - ll, floor)
    wick = max(body, upper, lower)
    q, r = body * body, 0.1 * body * body + tick * tick / 12
    LO, LC, US = lo.tolist(), lc.tolist(), us.tolist()
    # the filter starts at the first level that most of the first bars share
    first = np.r_[lo[:25], lc[:25]]
    first = first[np.isfinite(first)]
    m = float(np.median(first)) if len(first) else float(level)
    p, heat, last = q, 1.0, US[0] - period_us
    settled = np.empty(n)  # the body's second end: the close, or what stands for a withheld one
    heats = np.empty(n)
    nan = math.nan

    def confirmed(i, y, s):
        """Does a level y seen at bar i last?"""
        after = []
        for j in range(i + 1, n):
            a, b = LO[j], LC[j]
            if a == a:
                after.append(a)
            if b == b:
                after.append(b)
            if j - i >= LOOKAHEAD:
                break
        if not after:
            return False
        return abs(after[0] - y) <= s or sum(abs(a - y) <= s for a in after) * 2 > len(after)

    for i in range(n):
        a, b, t = LO[i], LC[i], US[i]
        gap = (t - last) / period_us
        p += q * min(max(gap - 1.0, 0.0), 400.0)
        last = t
        heats[i] = heat
        s = CLOSE_Z * math.sqrt(heat * (p + q + r))
        open_ok = a == a and abs(a - m) <= s
        if a == a and not open_ok and confirmed(i, a, s):
            open_ok, m, p = True, a, q  # a true gap
        if open_ok:
            k = p / (p + r)
            m += k * (a - m)
            p *= 1 - k
        p += q
        z2 = heat * (p + r)
        s = CLOSE_Z * math.sqrt(z2)
        if b == b:
            e = b - m
            if abs(e) > s and not confirmed(i, b, s):
                bad_c[i] = True
                settled[i] = a if open_ok else m
            else:
                if abs(e) > s:
                    m, p = b, q
                else:
                    k = p / (p + r)
                    m += k * e
                    p *= 1 - k
                heat = min(max(0.9 * heat + 0.1 * min(e * e / (p + q + r), 16.0), 1.0), 9.0)
                settled[i] = b
        else:
            settled[i] = a if open_ok else m
        if not open_ok:
            LO[i] = nan
    with np.errstate(all="ignore"):
        body_lo = np.array(LO)
        top, bottom = np.fmax(body_lo, settled), np.fmin(body_lo, settled)
        spread = wick_limits(np.fmax(lh - top, 0), wick, heats), wick_limits(np.fmax(bottom - ll, 0), wick, heats)
        slack = 0.25 * tick
        # a close outside its bar's high and low: whichever the level contradicts is false
        outside = (~bad_c) & ((lc > lh + slack) | (lc < ll - slack)) & ~crossed
        sane_h, sane_l = ~bad_h & (lh - top <= spread[0]) & (lh >= body_lo - slack), ~bad_l & (bottom - ll <= spread[1]) & (ll <= body_lo + slack)
        bad_c |= outside & sane_h & sane_l & ~np.isnan(body_lo)
        moved = bad_c & ~np.isnan(body_lo)
        top, bottom = np.where(moved, np.fmax(body_lo, np.fmin(settled, np.where(sane_h, lh, settled))), top), np.where(moved, np.fmin(body_lo, np.fmax(settled, np.where(sane_l, ll, settled))), bottom)
        has_h, has_l = ~np.isnan(lh), ~np.isnan(ll)
        bad_h |= has_h & ((lh - top > spread[0]) | (lh < top - spread[0]))
        bad_l |= has_l & ((bottom - ll > spread[1]) | (ll > bottom + spread[1]))
    return bad_h, bad_l, bad_c


def wick_limits(w, noise, heats):
    """Largest plausible wick of each bar: the state of a local level over the wicks before it and its predicted spread."""
    n = len(w)
    out = np.empty(n)
    W, H = w.tolist(), heats.tolist()
    r, q, p = noise * noise, 0.001 * noise * noise, noise * noise
    m = 0.0
    for i in range(n):
        p += q
        out[i] = s = m + WICK_Z * math.sqrt(H[i] * (p + r))
        x = W[i]
        if x <= s:
            k = p / (p + r)
            m += k * (x - m)
            p *= 1 - k
    return out


def volume_filter(us, v, flow, period_us):
    """Flags of volumes in order of time; ``flow`` is buys plus sells where known."""
    n = len(us)
    with np.errstate(all="ignore"):
        bad = ~np.isnan(v) & (v < 0)
        y = np.where(v >= 0, np.log1p(np.abs(v)), np.nan)
        d = np.diff(y[~np.isnan(y)])
        sigma = max(_noise(d, 0.2) / math.sqrt(2), 0.35)
        agrees, differs = np.abs(flow - v) < 0.5, (flow > 0) & (v > 4 * flow + 4)
    known = y[:25][~np.isnan(y[:25])]
    m = float(np.median(known)) if len(known) else 0.0
    r, q, p = sigma * sigma, 0.02 * sigma * sigma, 0.5 * sigma * sigma
    Y, A, D = y.tolist(), agrees.tolist(), differs.tolist()
    least = math.log(VOLUME_RATIO)
    for i in range(n):
        e0 = Y[i]
        p += q
        if e0 != e0:
            continue
        e = e0 - m
        limit = max(VOLUME_Z * math.sqrt(p + r), least)
        wild = D[i] and e > 0.5 * limit
        if (e > limit or wild) and not A[i]:
            after = [x for x in Y[i + 1 : i + 1 + LOOKAHEAD] if x == x]
            # a burst builds up or dies down: some bar after a true one is busy as well
            if wild or not after or e0 - max(after) > 0.6 * limit or e > 1.5 * limit and e0 - max(after) > 0.3 * limit:
                bad[i] = True
                continue
        elif e < -limit and not A[i]:
            after = [x for x in Y[i + 1 : i + 1 + LOOKAHEAD] if x == x]
            if after and min(after) - e0 > 0.6 * limit:
                bad[i] = True
                continue
        k = p / (p + r)
        m += k * min(max(e, -limit), limit)
        p *= 1 - k
    return bad


def vanishing(still: np.ndarray, floor: np.ndarray | None = None, least: int = 3) -> np.ndarray:
    """Places of a series of innovations that belong to an implausibly long stretch without variance.

    ``still``: whether an innovation leaves the variance of its stretch at zero. The recursion is the likelihood of the stretch so far: it
    starts again at each innovation that varies and is multiplied, at each that does not, by the share of such innovations
    in the series without its longest stretches, around the stretch, or ``floor``, whichever is largest.
    """
    n = len(still)
    out = np.zeros(n, bool)
    if not still.any():
        return out
    edge = np.flatnonzero(np.diff(np.r_[False, still, False]))
    start, stop = edge[::2], edge[1::2]
    length = stop - start
    if length.max() < least:
        return out
    capped, moved = np.minimum(length, 12).sum(), n - length.sum()
    usual = (capped + 1.0) / (capped + moved + 2.0)
    beyond = math.log(n + 1) + FROZEN_ODDS
    for k in np.flatnonzero(length >= least):
        a, b = start[k], stop[k]
        # a quiet stretch around it makes it likelier
        near = np.r_[still[max(a - 101, 0) : max(a - 1, 0)], still[b : b + 100]]
        share = max(usual, (near.sum() + 1.0) / (len(near) + 2.0)) if len(near) >= 40 else usual
        if floor is not None:
            share = max(share, floor[a])
        if -length[k] * math.log(share) > beyond:
            out[a:b] = True
    return out


def frozen(x: np.ndarray, by_value: bool, proof: np.ndarray | None = None) -> np.ndarray:
    """All but the first reading of a stretch in which a field's own innovations, its changes, have no variance.

    Nulls neither end nor extend a stretch. ``by_value``: a common value repeats as often as it is common. ``proof``: the same
    quantity by another way; a stretch it agrees with is true.
    """
    out = np.zeros(len(x), bool)
    at = np.flatnonzero(~np.isnan(x))
    if len(at) < 4:
        return out
    y = x[at]
    innovation = np.diff(y)
    floor = None
    if by_value:
        _, of, n = np.unique(y, return_inverse=True, return_counts=True)
        # how common the value is outside its stretch
        edges = np.flatnonzero(np.r_[True, innovation != 0])
        run = np.repeat(np.diff(np.r_[edges, len(y)]), np.diff(np.r_[edges, len(y)]))
        floor = ((n[of] - run + 1.0) / (len(y) - run + 2.0))[1:]
    hit = np.flatnonzero(vanishing(innovation == 0, floor)) + 1
    if proof is not None and len(hit):
        for part in np.split(hit, np.flatnonzero((np.diff(hit) > 1) | (np.diff(y[hit]) != 0)) + 1):
            other = proof[at[part]]
            other = other[~np.isnan(other)]
            if len(other) and np.mean(other == y[part[0]]) >= 0.5:
                continue
            out[at[part]] = True
        return out
    out[at[hit]] = True
    return out


def replayed(o, h, l, c) -> np.ndarray:  # noqa: E741
    """All but the first of a stretch of bars whose innovations, other than zero, come back unchanged bar after bar."""
    out = np.zeros(len(o), bool)
    if len(o) < 4:
        return out
    # from the last close to the open, from there to the close, and on to the ends
    steps = np.column_stack([c - o, h - np.fmax(o, c), np.fmin(o, c) - l])[1:]
    gap = o[1:] - c[:-1]
    same = np.r_[False, (steps[1:] == steps[:-1]).all(axis=1)] & (o[1:] == o[:-1]) & (gap != 0)
    same[0] = (o[0] == o[1]) & (c[0] == c[1]) & (h[0] == h[1]) & (l[0] == l[1]) & (gap[0] != 0)
    out[1:] = vanishing(same, least=4)
    return out


def _unit(group: pa.Table) -> pa.RecordBatch | None:
    """One block of a contract: its readings once each, filtered, and the verdicts handed to every delivered copy."""
    f = lambda name: group[name].to_numpy().astype("float64")
    us = group["sp_us"].to_numpy()
    cols = [f(c) for c in ("sp_open", "sp_high", "sp_low", "sp_close", "sp_volume", "sp_flow")]
    same = us[1:] == us[:-1]
    for x in cols[:5]:
        same &= (x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1]))
    first = np.r_[True, ~same]
    of = np.cumsum(first) - 1
    t, (o, h, l, c, v, flow) = us[first], [x[first] for x in cols]  # noqa: E741
    period = float(group["sp_period"][0].as_py()) * 1e6
    bad = dict(zip(("high", "low", "close"), price_filter(t, o, h, l, c, period)))
    bad["volume"] = volume_filter(t, v, flow, period)
    shape = replayed(o, h, l, c)
    for name, x in (("high", h), ("low", l), ("close", c)):
        bad[name] |= (frozen(x, False) | shape) & ~np.isnan(x)
    bad["volume"] |= frozen(v, True, flow)
    own = group["sp_own"].to_numpy(zero_copy_only=False)
    ids, block = group["sp_id"].to_numpy(), []
    names = []
    for name, flags in bad.items():
        hit = flags[of] & own
        block.append(ids[hit])
        names += [name] * int(hit.sum())
    if not names:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(block), pa.int64()), pa.array(names, pa.string())], names=["bar_id", "field"])


def false_readings(bars: DataFrame) -> DataFrame:
    """(bar_id, field): the readings of high, low, close and volume that cannot be true for their contract.

    Nulls are no case. Copies of a bar at one instant with equal values are judged once and flagged alike; at one instant
    with other values they follow each other by bar_id. Rows without contract, time, bar_id or a known timeframe give none. A
    contract of a few bars has little normal behaviour; impossible readings are found in it all the same. An empty table
    gives an empty result. Columns other than those of a bar are ignored.
    """
    col = F.col
    num = lambda c: col(c).cast("double").alias(f"sp_{c}")
    b = bars.select(
        col("bar_id").cast("bigint").alias("sp_id"), col("contract").alias("sp_contract"), col("timeframe").alias("sp_tf"), F.unix_micros("timestamp_utc").alias("sp_us"),
        *map(num, ("open", "high", "low", "close", "volume")), (col("buy_volume") + col("sell_volume")).cast("double").alias("sp_flow"),
    )
    b = b.withColumn("sp_period", period_seconds(col("sp_tf"))).where("sp_id is not null and sp_contract is not null and sp_us is not null and sp_period is not null")
    size, edge = BLOCK_PERIODS * 1_000_000, OVERLAP_PERIODS * 1_000_000
    here = F.floor(col("sp_us") / (col("sp_period") * size))
    ends = [F.floor((col("sp_us") + d * col("sp_period") * edge) / (col("sp_period") * size)) for d in (-1, 1)]
    b = b.withColumn("sp_here", here).withColumn("sp_block", F.explode(F.array_distinct(F.array(here, *ends)))).withColumn("sp_own", col("sp_block") == col("sp_here")).drop("sp_here")
    return map_sorted_groups(b, ["sp_contract", "sp_tf", "sp_block"], ["sp_us", "sp_id"], _unit, "bar_id long, field string")


def p1_found(spark, folder: str) -> DataFrame:
    """False readings of the bars."""
    return false_readings(table(spark, folder, "bars"))
