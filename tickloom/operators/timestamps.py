"""Mixed timestamp spellings and zones to one instant.

All spellings are compiled into ONE regular expression whose alternatives carry named groups. A single
``regexp_replace`` per value turns a spelling into a fixed row of components, so the expression runs once and stays in
the JVM. Calendar ranges are checked on the components and the instant is assembled by integer day arithmetic
(days since 1970 from year, month and day), never through a date parser.

A clock reading without offset belongs to the feed's home zone. It is turned into an instant by trying the two
offsets in force one day before and one day after it: one valid candidate is the answer, none means the reading never
occurred (clocks went forward), two mean it occurred twice (clocks went back). Only readings within a day of such a
fall-back leave the JVM: grouped by contract and noon-to-noon day they are put in the order of their bar numbers by a
two-state shortest path, which is a group of bounded size however large a contract is.
"""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.runtime import barrier

DAY_US = 86_400_000_000
NEW_YORK = "America/New_York"
FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

#: Offsets in minutes of abbreviations a feed's own zone does not know. Fixed values.
WORLD_ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "BST": 60, "IST": 330, "JST": 540,
    "AEST": 600, "AEDT": 660,
}

_CLOCK = r"(?<h{0}>\d{{1,2}}):(?<n{0}>\d{{2}})(?::(?<s{0}>\d{{2}})(?:[.,](?<f{0}>\d+))?)?"
_ZONE = r"(?:\s*(?:(?<o{0}>[+-]\d{{2}}:?\d{{2}})|(?<a{0}>(?![ap]m\b)[a-z]{{1,5}})))?(?:\[(?<r{0}>[a-z0-9_/+-]+)\])?"
_HALF = r"(?:\s*(?<p{0}>[ap])\.?m\.?)?"
_NAME = "|".join(MONTHS)
_BRANCHES = {
    # 2024-03-10T09:55:01.123-04:00[Zone], with T, t or a blank and a point or a comma
    "A": rf"(?<yA>\d{{4}})-(?<mA>\d{{1,2}})-(?<dA>\d{{1,2}})[t ]\s*{_CLOCK.format('A')}{_ZONE.format('A')}",
    # 03/27/2024 1:05 pm, in the feed's order
    "B": rf"(?<uB>\d{{1,4}})/(?<vB>\d{{1,2}})/(?<wB>\d{{1,4}})\s+{_CLOCK.format('B')}{_HALF.format('B')}{_ZONE.format('B')}",
    # 27-Mar-2024 11:32:02
    "C": rf"(?<dC>\d{{1,2}})-(?<xC>{_NAME})[a-z]*-(?<yC>\d{{2,4}})\s+{_CLOCK.format('C')}{_HALF.format('C')}{_ZONE.format('C')}",
    # Mar 7, 2024 1:17:00 PM
    "D": rf"(?<xD>{_NAME})[a-z]*\.?\s+(?<dD>\d{{1,2}}),?\s+(?<yD>\d{{4}}),?\s+{_CLOCK.format('D')}{_HALF.format('D')}{_ZONE.format('D')}",
    # Sun, 03 Nov 2024 03:25:00 -0500
    "E": rf"(?:[a-z]{{3,9}},\s*)?(?<dE>\d{{1,2}})\s+(?<xE>{_NAME})[a-z]*\s+(?<yE>\d{{4}})\s+{_CLOCK.format('E')}{_ZONE.format('E')}",
    # 20241103T020501Z and 20241103020501
    "F": rf"(?<yF>\d{{4}})(?<mF>\d{{2}})(?<dF>\d{{2}})t?(?<hF>\d{{2}})(?<nF>\d{{2}})(?<sF>\d{{2}})(?:[.,](?<fF>\d+))?{_ZONE.format('F')}",
    # counts since 1970 in seconds, milli-, micro- or nanoseconds, told apart by their digits
    "G": r"(?<eG>\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})",
    # /Date(1711884000123+0100)/: the count is UTC, the offset says only where it was shown
    "H": r"/date\((?<eH>\d{12,13})(?:[+-]\d{4})?\)/",
}
PATTERN = r"(?i)^\s*(?:" + "|".join(_BRANCHES.values()) + r")\s*$"
#: Components in the order in which the replacement lists them: year, month, day, hour, minute, second, fraction, half
#: of the day, offset, abbreviation, region, the three numbers of a slashed date, month name, count.
_PARTS = "ymdhnsfpoaruvwxe"


def _replacement() -> str:
    have = {g + b for g in _PARTS for b in _BRANCHES if f"(?<{g}{b}>" in PATTERN}
    return "\x01|" + "|".join("".join(f"${{{g}{b}}}" for b in _BRANCHES if g + b in have) for g in _PARTS)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date by integer arithmetic alone."""
    y2 = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return era * 146097 + doe - 719468


def zone_offset(us: Column, zone: Column) -> Column:
    """Microseconds by which ``zone`` is ahead of UTC at the instant ``us``; null for a null zone."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) - us


def as_text(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), FORMAT)


def _abbreviations(batches):
    """The abbreviations each home zone has used since 1970, the latest meaning winning, in minutes."""
    for pdf in batches:
        maps = []
        for zone in pdf["home_zone"]:
            known: dict[str, int] = {}
            if zone in available_timezones():
                tz = ZoneInfo(zone)
                for year in range(1970, 2038):
                    for month in (1, 4, 7, 10):
                        at = datetime(year, month, 15, tzinfo=timezone.utc).astimezone(tz)
                        if at.tzname().isalpha():
                            known[at.tzname()] = int(at.utcoffset().total_seconds() // 60)
            maps.append(list(known.items()))
        yield pd.DataFrame({"feed_id": pdf["feed_id"], "tsn_zone": pdf["home_zone"], "tsn_order": pdf["date_order"], "tsn_known": maps})


def feed_clocks(feeds: DataFrame) -> DataFrame:
    """One row per feed: its zone, date order and the abbreviations of its zone. Feeds repeated in the table count once."""
    one = feeds.groupBy("feed_id").agg(F.min("home_zone").alias("home_zone"), F.min("date_order").alias("date_order"))
    made = one.mapInPandas(_abbreviations, "feed_id long, tsn_zone string, tsn_order string, tsn_known array<struct<k:string,v:int>>")
    return made.withColumn("tsn_known", F.map_from_entries("tsn_known")).withColumn("tsn_zone", F.when(F.col("tsn_zone").isin(sorted(available_timezones())), F.col("tsn_zone")))


def _components(df: DataFrame) -> DataFrame:
    """Adds tsn_wall (the clock reading in microseconds as if UTC), tsn_off (minutes ahead of UTC or null), tsn_region, tsn_count."""
    c = {p: f"nullif(tsn_parts[{i + 1}], '')" for i, p in enumerate(_PARTS)}
    whole = lambda p: F.expr(f"try_cast({c[p]} as bigint)")
    df = df.withColumn("tsn_raw", F.regexp_replace("tsn_text", F.lit(PATTERN), F.lit(_replacement())))
    df = barrier(df.withColumn("tsn_parts", F.when(F.col("tsn_raw").startswith("\x01"), F.split("tsn_raw", r"\|"))))
    name = F.lower(F.expr(c["x"]))
    u, v, w = whole("u"), whole("v"), whole("w")
    year_first = (F.length(F.expr(c["u"])) > 2) | ((F.col("tsn_order") == "YMD") & (F.length(F.expr(c["w"])) <= 2))
    dmy = F.col("tsn_order") == "DMY"
    y = F.coalesce(whole("y"), F.when(year_first, u).otherwise(w))
    m = F.coalesce(whole("m"), F.expr("nullif(array_position(array(" + ",".join(f"'{x}'" for x in MONTHS) + f"), lower({c['x']})), 0)").cast("bigint"), F.when(name.isNull(), F.when(year_first, v).when(dmy, v).otherwise(u)))
    d = F.coalesce(whole("d"), F.when(year_first, w).when(dmy, u).otherwise(v))
    df = df.withColumns({
        "tsn_y": F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y), "tsn_m": m, "tsn_d": d, "tsn_h": whole("h"), "tsn_n": whole("n"),
        "tsn_s": F.coalesce(whole("s"), F.lit(0)), "tsn_f": F.expr(f"coalesce(try_cast(rpad(left({c['f']}, 6), 6, '0') as bigint), 0)"),
        "tsn_p": F.lower(F.expr(c["p"])), "tsn_o": F.expr(c["o"]), "tsn_a": F.upper(F.expr(c["a"])), "tsn_region": F.expr(c["r"]), "tsn_e": F.expr(c["e"]),
        "tsn_y_text": F.coalesce(F.expr(c["y"]), F.when(year_first, F.expr(c["u"])).otherwise(F.expr(c["w"]))),
    })
    df = barrier(df.drop("tsn_parts", "tsn_raw", "tsn_text"))
    col = F.col
    # a year of three digits, or a four-digit year below 100, is no year
    good_year = (F.length("tsn_y_text") != 3) & ~((F.length("tsn_y_text") == 4) & (F.col("tsn_y_text") < "0100"))
    leap = (col("tsn_y") % 4 == 0) & ((col("tsn_y") % 100 != 0) | (col("tsn_y") % 400 == 0))
    last = F.when(col("tsn_m") == 2, F.when(leap, 29).otherwise(28)).when(col("tsn_m").isin(4, 6, 9, 11), 30).otherwise(31)
    hour = F.when(col("tsn_p").isNull(), F.when(col("tsn_h") <= 23, col("tsn_h"))).when(col("tsn_h").between(1, 12), col("tsn_h") % 12 + F.when(col("tsn_p") == "p", 12).otherwise(0))
    real = good_year & col("tsn_m").between(1, 12) & (col("tsn_d") >= 1) & (col("tsn_d") <= last) & hour.isNotNull() & (col("tsn_n") <= 59) & (col("tsn_s") <= 59)
    wall = (((days_from_civil(col("tsn_y"), col("tsn_m"), col("tsn_d")) * 24 + hour) * 60 + col("tsn_n")) * 60 + col("tsn_s")) * 1_000_000 + col("tsn_f")
    sign = F.when(F.left("tsn_o", F.lit(1)) == "-", -1).otherwise(1)
    off_h, off_n = F.expr("try_cast(substr(tsn_o, 2, 2) as bigint)"), F.expr("try_cast(right(tsn_o, 2) as bigint)")
    offset = F.when(off_h.between(0, 18) & (off_n <= 59), sign * (off_h * 60 + off_n))
    fixed = F.create_map(*[F.lit(x) for kv in WORLD_ABBREVIATIONS.items() for x in kv])
    known = F.when(col("tsn_a").isin("UTC", "GMT", "Z"), 0).otherwise(F.coalesce(F.try_element_at("tsn_known", col("tsn_a")), F.try_element_at(fixed, col("tsn_a"))))
    digits = F.length("tsn_e")
    count = F.expr("try_cast(tsn_e as bigint)")
    count_us = F.when(digits <= 10, count * 1_000_000).when(digits <= 13, count * 1000).when(digits <= 16, count).otherwise(F.expr("try_cast(tsn_e as bigint) div 1000"))
    written = (col("tsn_o").isNotNull() & offset.isNull()) | (col("tsn_a").isNotNull() & known.isNull())
    region_ok = col("tsn_region").isin(sorted(available_timezones()))
    return df.withColumns({
        "tsn_wall": F.when(col("tsn_e").isNull() & real & ~written, wall.cast("bigint")), "tsn_count": count_us.cast("bigint"),
        "tsn_off": F.coalesce(offset, known).cast("bigint"), "tsn_clock": F.when(region_ok, col("tsn_region")).otherwise(col("tsn_zone")),
    })


def _order_folds(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chooses between the two instants of each doubled reading so that instants rise with the bar number.

    Per bar number there is one state (the instant, where any record of the bar is certain) or two. Steps that do not
    go forward cost 1e6, others the size of the logarithm of the step over the usual step per bar.
    """
    bar = pdf["bar_no"].to_numpy(dtype="float64", na_value=np.nan)
    c1, c2 = pdf["c1"].to_numpy(dtype="int64"), pdf["c2"].to_numpy(dtype="int64")
    out = c1.copy()
    doubled = c2 > c1
    named = ~np.isnan(bar)
    if not (doubled & named).any():
        return pd.DataFrame({"row_id": pdf["row_id"], "us": out})
    states: list[tuple[float, list[int]]] = []
    for b in np.unique(bar[named]):
        at = named & (bar == b)
        sure = c1[at & ~doubled]
        if len(sure):
            states.append((b, [int(np.sort(sure)[len(sure) // 2])]))
        else:
            states.append((b, [int(c1[at].min()), int(c2[at].min())]))
    single = [(b, s[0]) for b, s in states if len(s) == 1]
    steps = [(t - t0) / (b - b0) for (b0, t0), (b, t) in zip(single, single[1:]) if t > t0 and b - b0 == 1]
    if not steps:
        steps = [(s[0] - s0[0]) / (b - b0) for (b0, s0), (b, s) in zip(states, states[1:]) if s[0] > s0[0]]
    usual = float(np.median(steps)) if steps else 60e6
    cost, back = [np.zeros(len(states[0][1]))], []
    for (b0, s0), (b, s) in zip(states, states[1:]):
        step = np.subtract.outer(np.array(s, dtype="float64"), np.array(s0, dtype="float64"))
        with np.errstate(divide="ignore", invalid="ignore"):
            price = np.where(step > 0, np.abs(np.log(np.maximum(step, 1.0) / (usual * (b - b0)))), 1e6)
        total = price + cost[-1][None, :]
        back.append(total.argmin(axis=1))
        cost.append(total.min(axis=1))
    pick = [int(cost[-1].argmin())]
    for b in reversed(back):
        pick.append(int(b[pick[-1]]))
    chosen = {b: s[k] for (b, s), k in zip(states, reversed(pick))}
    for i in np.flatnonzero(doubled & named):
        t = chosen[bar[i]]
        out[i] = c1[i] if abs(t - c1[i]) <= abs(t - c2[i]) else c2[i]
    return pd.DataFrame({"row_id": pdf["row_id"], "us": out})


def normalise_timestamps(records: DataFrame, feeds: DataFrame, *, row_id: str = "record_id", text: str = "time_stamp", contract: str = "contract", order: str = "bar_no", feed: str = "feed_id") -> DataFrame:
    """(row_id, timestamp_utc, timestamp_ny, us) of every row of ``records`` whose text names a real date and clock time.

    Rows whose text is null, empty, of no known form, off the calendar, or names a reading the zone's clock skipped give
    no row; so do rows of a feed without a known zone unless the text has an offset. A doubled reading without contract
    or bar number takes its first occurrence. Repeated input rows give repeated rows. Columns other than the five named
    are ignored, whatever their names. An empty table gives an empty result.
    """
    col = F.col
    src = records.select(col(row_id).cast("bigint").alias("row_id"), col(text).alias("tsn_text"), col(contract).alias("tsn_contract"), col(order).cast("bigint").alias("bar_no"), col(feed).cast("bigint").alias("feed_id"))
    df = _components(src.where(col("tsn_text").isNotNull()).join(feed_clocks(feeds), "feed_id", "left"))
    df = barrier(df.select("row_id", "tsn_contract", "bar_no", "tsn_zone", "tsn_clock", "tsn_wall", F.coalesce(col("tsn_count"), col("tsn_wall") - col("tsn_off") * 60_000_000).alias("tsn_sure"))).where(col("tsn_wall").isNotNull() | col("tsn_sure").isNotNull())
    # the reading on the home clock, and the offsets a day before and after it
    df = barrier(df.withColumn("tsn_home", F.when(col("tsn_sure").isNull(), col("tsn_wall")).otherwise(col("tsn_sure") + F.coalesce(zone_offset(col("tsn_sure"), col("tsn_zone")), F.lit(0)))))
    zone = F.when(col("tsn_sure").isNull(), col("tsn_clock")).otherwise(col("tsn_zone"))
    df = barrier(df.withColumns({"tsn_before": zone_offset(col("tsn_home") - DAY_US, zone), "tsn_after": zone_offset(col("tsn_home") + DAY_US, zone)}))
    c1, c2 = col("tsn_wall") - col("tsn_before"), col("tsn_wall") - col("tsn_after")
    changing = col("tsn_before") != col("tsn_after")
    df = df.withColumns({
        "tsn_c1": F.when(col("tsn_sure").isNull(), F.when(~changing, c1).when(zone_offset(c1, col("tsn_clock")) == col("tsn_before"), c1)),
        "tsn_c2": F.when(col("tsn_sure").isNull() & changing & (zone_offset(c2, col("tsn_clock")) == col("tsn_after")), c2),
    })
    df = barrier(df.select("row_id", "tsn_contract", "bar_no", F.floor((col("tsn_home") - DAY_US // 2) / DAY_US).alias("tsn_day"), (col("tsn_before") > col("tsn_after")).alias("tsn_fold"),
                   F.coalesce("tsn_sure", "tsn_c1", "tsn_c2").alias("c1"), F.coalesce("tsn_sure", "tsn_c2", "tsn_c1").alias("c2"))).where(col("c1").isNotNull())
    near = F.coalesce(col("tsn_fold"), F.lit(False))
    plain = df.where(~near).select("row_id", col("c1").alias("us"))
    folded = df.where(near).groupBy("tsn_contract", "tsn_day").applyInPandas(_order_folds, "row_id long, us long")
    us = plain.unionAll(folded)
    return us.select("row_id", as_text(col("us")).alias("timestamp_utc"), as_text(col("us") + zone_offset(col("us"), F.lit(NEW_YORK))).alias("timestamp_ny"), "us")


def clock_corrections(bars: DataFrame, *, row_id: str = "bar_id", utc: str = "timestamp_utc", local: str = "timestamp_ny", zone: str = NEW_YORK) -> DataFrame:
    """(row_id, timestamp_utc, timestamp_ny, us) of rows whose local clock is null or not ``zone``'s clock at ``utc``.

    A null ``utc`` gives no row. Repeated rows are judged one by one.
    """
    us = F.unix_micros(F.col(utc))
    src = bars.select(F.col(row_id).cast("bigint").alias("row_id"), us.alias("us"), F.unix_micros(F.col(local).cast("timestamp")).alias("tsn_local")).where(F.col("us").isNotNull())
    src = src.withColumn("tsn_right", F.col("us") + zone_offset(F.col("us"), F.lit(zone)))
    bad = src.where(F.col("tsn_local").isNull() | (F.col("tsn_local") != F.col("tsn_right")))
    return bad.select("row_id", as_text(F.col("us")).alias("timestamp_utc"), as_text(F.col("tsn_right")).alias("timestamp_ny"), "us")


def p3_found(spark, folder: str) -> DataFrame:
    """Both tables of problem 3 in one form."""
    from tickloom.runtime import table

    cols = ["row_id", "timestamp_utc", "timestamp_ny"]
    records = normalise_timestamps(table(spark, folder, "raw_records"), table(spark, folder, "feeds")).select(F.lit("raw_records").alias("table_name"), *cols)
    bars = clock_corrections(table(spark, folder, "bars")).select(F.lit("bars").alias("table_name"), *cols)
    return records.unionAll(bars)
