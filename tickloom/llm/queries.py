"""Queries of the problems of this subpackage and, where SQL can say the same, their oracles."""

from __future__ import annotations

from tickloom.llm import mixing, nearest, packing, prose


def queries() -> dict:
    return {
        "p4_found": nearest.p4_found,
        "p7_packed": packing.p7_packed,
        "p7_report": packing.p7_report,
        "p8_mixture": mixing.p8_mixture,
        "p8_shares": mixing.p8_shares,
        "p8_slots": mixing.p8_slots,
        "p9_found": prose.p9_found,
        "p9_statistics": prose.p9_statistics,
    }


def oracle_sql() -> dict[str, str]:
    code = r"upper(regexp_replace(contract, '^\s+|\s+$', '', 'g'))"
    return {
        "p4_found": f"""with t as (select trade_id, min({code}) as k, min(entry_ts) as ts from trades group by trade_id),
            f as (select bar_id, timestamp_utc, {code} as k from bars)
            select trade_id, bar_id from (select t.trade_id, f.bar_id,
                row_number() over (partition by t.trade_id order by abs(epoch_us(f.timestamp_utc) - epoch_us(t.ts)), f.timestamp_utc, f.bar_id) as rn
                from t join f on t.k = f.k and f.timestamp_utc between t.ts - interval 10 minutes and t.ts + interval 10 minutes) where rn = 1""",
    }
