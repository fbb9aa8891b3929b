"""Pairing each left record with the record of another table nearest in time.

Both sides are laid out by (entity, block of time), sorted by time within partitions, and streamed through a two-pointer
merge over Arrow batches: per batch the last right record at or before and the first one after each left record are
found by running maxima and minima of positions. Between batches only the last right record and the left records whose
right neighbour has not come yet are held, so memory does not depend on the size of an entity. Blocks cut a hot entity
into many tasks; a right record lies in the block of each end of its tolerance, at most two.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.attributes import entity_code
from tickloom.runtime import table

MINUTE_US = 60_000_000


def _merge(tolerance_us: int):
    """The two-pointer merge over batches sorted by (entity, block, time, side, id); side 0 is right, 1 is left."""

    def pairs(group, us, side, left, right, final):
        """Resolved (left, right) pairs of a run of rows, and from where on rows must be kept for the next batch."""
        n = len(us)
        fresh = np.r_[True, (group[1:] != group[:-1])]
        starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        ends = np.r_[np.flatnonzero(fresh)[1:], n][np.cumsum(fresh) - 1]
        is_right = side == 0
        # of right records at one time only the first, which has the lowest id, can be taken
        pos = np.arange(n)
        same = np.r_[False, is_right[1:] & is_right[:-1] & (us[1:] == us[:-1]) & ~fresh[1:]]
        usable = is_right & ~same
        before = np.maximum.accumulate(np.where(usable, pos, -1))
        before = np.where(before >= starts, before, -1)
        after = np.minimum.accumulate(np.where(usable, pos, n)[::-1])[::-1]
        open_end = (after >= ends) & (ends == n) & (not final)  # its next right record may still come
        after = np.where(after < ends, after, -1)
        lefts = np.flatnonzero(~is_right)
        if open_end.any():
            # a neighbour at or before within no distance, or the end of the tolerance already streamed past, decides at once
            decided = ~open_end[lefts] | (us[lefts] + tolerance_us < us[-1]) | ((before[lefts] >= 0) & (us[np.maximum(before[lefts], 0)] == us[lefts]))
        else:
            decided = np.ones(len(lefts), dtype=bool)
        done, waiting = lefts[decided], lefts[~decided]
        b, a = before[done], after[done]
        db = np.where(b >= 0, us[done] - us[np.maximum(b, 0)], np.iinfo(np.int64).max)
        da = np.where(a >= 0, us[np.maximum(a, 0)] - us[done], np.iinfo(np.int64).max)
        pick = np.where(db <= da, b, a)
        ok = np.minimum(db, da) <= tolerance_us
        keep = np.zeros(n, dtype=bool)
        if not final:
            keep[waiting] = True
            last = before[n - 1] if n else -1
            if last >= 0:
                keep[last] = True
            need = before[waiting]
            keep[need[need >= 0]] = True
        return left[done[ok]], right[pick[ok]], np.minimum(db, da)[ok], keep

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            rows, held = step(t, False)
            if rows is not None:
                yield rows
        if held is not None and held.num_rows:
            rows, _ = step(held, True)
            if rows is not None:
                yield rows

    def step(t, final):
        t = t.combine_chunks()
        code = t["ne_entity"].combine_chunks()
        code = np.asarray(code.dictionary_encode().indices)
        block = t["ne_block"].to_numpy()
        group = np.r_[0, np.cumsum((code[1:] != code[:-1]) | (block[1:] != block[:-1]))] if len(code) else code
        keys = np.asarray(t["ne_left"].to_pandas(), dtype=object)
        left, right, gap, keep = pairs(group, t["ne_us"].to_numpy(), t["ne_side"].to_numpy(), keys, t["ne_right"].to_numpy(), final)
        out = pa.RecordBatch.from_pandas(pd.DataFrame({"left_id": left, "right_id": right, "gap_us": gap}), schema=pa.schema([("left_id", pa.string()), ("right_id", pa.int64()), ("gap_us", pa.int64())]), preserve_index=False) if len(left) else None
        return out, t.filter(pa.array(keep))

    return run


def nearest_match(left: DataFrame, right: DataFrame, *, left_id: str, left_ts: str, right_id: str, right_ts: str, entity: str, tolerance_us: int, block_us: int = 360 * MINUTE_US) -> DataFrame:
    """(left_id, right_id, gap_us): for each left id the right record of its entity nearest in time, at most the tolerance away.

    Equally near: the earlier right record; at the same time: the lowest right id. A left id repeated in the table counts
    once, at its earliest time. Left ids are compared as text. Null ids, times or entities never match. Entities are
    compared without case and outer blanks. Other columns are ignored. Empty tables give an empty result.
    """
    if block_us < 2 * tolerance_us:
        raise ValueError("blocks must be at least twice the tolerance")
    col = F.col
    ls = left.select(col(left_id).cast("string").alias("ne_left"), F.unix_micros(col(left_ts)).alias("ne_us"), entity_code(col(entity)).alias("ne_entity")).where("ne_left is not null and ne_us is not null and ne_entity is not null")
    ls = ls.groupBy("ne_left").agg(F.min(F.struct("ne_us", "ne_entity")).alias("ne_x")).select("ne_left", "ne_x.*")
    ls = ls.select("ne_entity", F.floor(col("ne_us") / block_us).alias("ne_block"), "ne_us", F.lit(1).alias("ne_side"), "ne_left", F.lit(-1).cast("bigint").alias("ne_right"))
    rs = right.select(entity_code(col(entity)).alias("ne_entity"), F.unix_micros(col(right_ts)).alias("ne_us"), col(right_id).cast("bigint").alias("ne_right")).where("ne_right is not null and ne_us is not null and ne_entity is not null")
    ends = [F.floor((col("ne_us") + d) / block_us) for d in (-tolerance_us, tolerance_us)]
    rs = rs.withColumn("ne_block", F.explode(F.array_distinct(F.array(*ends)))).select("ne_entity", "ne_block", "ne_us", F.lit(0).alias("ne_side"), F.lit(None).cast("string").alias("ne_left"), "ne_right")
    both = ls.unionByName(rs).repartition("ne_entity", "ne_block").sortWithinPartitions("ne_entity", "ne_block", "ne_us", "ne_side", "ne_right")
    return both.mapInArrow(_merge(tolerance_us), "left_id string, right_id long, gap_us long")


def p4_found(spark, folder: str) -> DataFrame:
    """Trades and the bars of their contract nearest to their entry, within ten minutes."""
    out = nearest_match(table(spark, folder, "trades"), table(spark, folder, "bars"), left_id="trade_id", left_ts="entry_ts", right_id="bar_id", right_ts="timestamp_utc", entity="contract", tolerance_us=10 * MINUTE_US)
    return out.select(F.col("left_id").alias("trade_id"), F.col("right_id").alias("bar_id"))
