"""Queries of the general data problems (1, 2, 3, 5, 6) and, where SQL can say the same, their oracles."""

from __future__ import annotations

from tickloom.operators import attributes, drift, grid, spikes, timestamps

CODE = r"upper(regexp_replace(contract, '^\s+|\s+$', '', 'g'))"
TRADE_DATE = "cast(({} + interval 6 hours) at time zone 'America/New_York' as date)"


def queries() -> dict:
    return {
        "p1_found": spikes.p1_found,
        "p2_found": drift.p2_found,
        "p2_records": drift.p2_records,
        "p3_found": timestamps.p3_found,
        "p5_found": attributes.p5_found,
        "p5_attributes": attributes.p5_attributes,
        "p6_found": grid.p6_found,
        "p6_grid": grid.p6_grid,
    }


def _as_of(condition: str, name: str) -> str:
    return f"""(select trade_id, feature_id, val from (
        select t.trade_id, f.feature_id, f.{name} as val,
               row_number() over (partition by t.trade_id order by f.trade_date desc, f.known_at desc, f.feature_id) as rn
        from t join f on t.k = f.k and f.known_at <= t.ts and f.trade_date < {TRADE_DATE.format("t.ts")} where {condition}) where rn = 1)"""


def oracle_sql() -> dict[str, str]:
    heads = f"""with t as (select trade_id, min({CODE}) as k, min(entry_trigger_ts) as ts from trades group by trade_id),
        f as (select *, {CODE} as k from daily_features)"""
    return {
        "p5_found": f"{heads} select trade_id, feature_id from {_as_of('daily_ema_20 is not null and daily_atr_14 is not null', 'daily_ema_20')}",
        "p5_attributes": f"""{heads}, e as {_as_of("daily_ema_20 is not null", "daily_ema_20")}, a as {_as_of("daily_atr_14 is not null", "daily_atr_14")}
            select coalesce(e.trade_id, a.trade_id) as trade_id, round(e.val, 8) as daily_ema_20, e.feature_id as daily_ema_20_row,
                   round(a.val, 8) as daily_atr_14, a.feature_id as daily_atr_14_row from e full join a on e.trade_id = a.trade_id""",
        "p6_found": f"""with p as (select distinct contract, timeframe, case timeframe when '1m' then 60 else 300 end as per, {TRADE_DATE.format("timestamp_utc")} as d,
                cast(floor(epoch(timestamp_utc) / (case timeframe when '1m' then 60 else 300 end)) as bigint) * (case timeframe when '1m' then 60 else 300 end) as s
                from bars where close is not null),
            q as (select *, lead(s) over (partition by contract, timeframe, d order by s) as n from p)
            select contract, unnest(range(s + per, n, per)) as slot_start from q where n > s + per""",
    }
