"""Attributes as known at the time of an event.

Each attribute keeps its own change history: long rows (entity, attribute, rank, value). Matching an event takes, per
attribute, the best history row that had become usable by then, and the attributes are pivoted back to one row per
event, so a change of one attribute never makes a new version of the others.

A history row is *usable* from the later of two instants: when it became known, and when the day it describes was over
(the event must belong to a later trade date). Both conditions are thus one comparison in time, and the match is a
running maximum of the rank. To keep a hot entity from landing in one task, time is cut into blocks: block maxima are
made by a partial aggregation, a window over the few block rows of an entity carries the maximum into each block, and
the running maximum over the rows is taken per (entity, attribute, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.timestamps import NEW_YORK
from tickloom.runtime import table

DAY_US = 86_400_000_000


def entity_code(c: Column) -> Column:
    """Contract codes without case and outer blanks."""
    return F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))


def end_of_trade_date_us(trade_date: Column, zone: str = NEW_YORK) -> Column:
    """The instant from which events belong to a later trade date: local midnight after it, less six hours."""
    return F.unix_micros(F.to_utc_timestamp(F.date_add(trade_date, 1).cast("timestamp"), zone)) - 6 * 3_600_000_000


def attributes_at_event(events: DataFrame, history: DataFrame, *, event_id: str, event_ts: str, entity: str, attributes: list[str], row_id: str, valid_date: str, known_at: str, complete: bool = False, block_us: int = 7 * DAY_US) -> DataFrame:
    """One row per event id with, per attribute a, ``a`` (value), ``a_row`` (id of the history row) and ``a_date``.

    A history row of attribute a counts if a is non-null (with ``complete``: if all attributes are), its valid date is
    before the event's trade date and it was known by the event. Among those the latest valid date wins, then the latest
    known_at, then the lowest row id. Events of one id repeated in the table count once, with the earliest event_ts (and the
    lowest entity code where even those tie). Rows without id, entity, time or date match nothing and decide nothing. Events without a match for any
    attribute give no row; a missing attribute beside found ones is null. Entity codes are compared without case and
    outer blanks. Only the named columns are read, so extra ones may have any name. Empty tables give an empty result.
    """
    col = F.col
    ev = events.select(col(event_id).alias("at_id"), entity_code(col(entity)).alias("at_entity"), F.unix_micros(col(event_ts)).alias("at_us"))
    ev = ev.where(col("at_id").isNotNull() & col("at_us").isNotNull() & col("at_entity").isNotNull())
    ev = ev.groupBy("at_id").agg(F.min(F.struct("at_us", "at_entity")).alias("at_first")).select("at_id", col("at_first.at_us").alias("at_us"), col("at_first.at_entity").alias("at_entity"))
    ev = ev.select("at_entity", F.explode(F.array(*map(F.lit, attributes))).alias("at_name"), "at_us", "at_id")

    hist = history.select(entity_code(col(entity)).alias("at_entity"), col(valid_date).alias("at_date"), F.unix_micros(col(known_at)).alias("at_known"), col(row_id).cast("bigint").alias("at_row"), *[F.nanvl(col(a).cast("double"), F.lit(None).cast("double")).alias(f"at_v{i}") for i, a in enumerate(attributes)])
    hist = hist.where(col("at_entity").isNotNull() & col("at_date").isNotNull() & col("at_known").isNotNull() & col("at_row").isNotNull())
    if complete:
        for i in range(len(attributes)):
            hist = hist.where(col(f"at_v{i}").isNotNull())
    hist = hist.select("at_entity", "at_date", "at_known", "at_row", F.explode(F.array(*[F.struct(F.lit(a).alias("n"), col(f"at_v{i}").alias("v")) for i, a in enumerate(attributes)])).alias("at_x")).where(col("at_x.v").isNotNull())
    rank = F.struct(col("at_date").alias("d"), col("at_known").alias("k"), (-col("at_row")).alias("r"), col("at_x.v").alias("v"))
    hist = hist.select("at_entity", col("at_x.n").alias("at_name"), F.greatest(col("at_known"), end_of_trade_date_us(col("at_date"))).alias("at_us"), rank.alias("at_rank"))

    block = F.floor(col("at_us") / block_us).alias("at_block")
    no_rank = F.lit(None).cast(hist.schema["at_rank"].dataType)
    keys = ["at_entity", "at_name"]
    # what each block starts with
    blocks = hist.select(*keys, block, "at_rank").unionByName(ev.select(*keys, block).distinct().withColumn("at_rank", no_rank)).groupBy(*keys, "at_block").agg(F.max("at_rank").alias("at_rank"))
    carry = blocks.withColumn("at_rank", F.max("at_rank").over(Window.partitionBy(*keys).orderBy("at_block").rowsBetween(Window.unboundedPreceding, -1))).where(col("at_rank").isNotNull())
    start = carry.select(*keys, "at_block", (col("at_block") * block_us).alias("at_us"), F.lit(0).alias("at_side"), "at_rank", F.lit(None).cast("string").alias("at_id"))
    rows = hist.select(*keys, block, "at_us", F.lit(0).alias("at_side"), "at_rank", F.lit(None).cast("string").alias("at_id"))
    asks = ev.select(*keys, block, "at_us", F.lit(1).alias("at_side"), no_rank.alias("at_rank"), col("at_id").cast("string").alias("at_id"))
    run = Window.partitionBy(*keys, "at_block").orderBy("at_us", "at_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = start.unionAll(rows).unionAll(asks).withColumn("at_rank", F.max("at_rank").over(run)).where((col("at_side") == 1) & col("at_rank").isNotNull())
    # and back to one row per event
    back = []
    for a in attributes:
        of = F.max(F.when(col("at_name") == a, col("at_rank")))
        back += [of.alias(f"at_{a}")]
    out = matched.groupBy("at_id").agg(*back)
    cols = [c for a in attributes for c in (col(f"at_{a}.v").alias(a), (-col(f"at_{a}.r")).alias(f"{a}_row"), col(f"at_{a}.d").alias(f"{a}_date"))]
    return out.select(col("at_id").cast(events.schema[event_id].dataType).alias(event_id), *cols)


def trade_attributes(spark, folder: str, complete: bool) -> DataFrame:
    return attributes_at_event(
        table(spark, folder, "trades"), table(spark, folder, "daily_features"), event_id="trade_id", event_ts="entry_trigger_ts", entity="contract",
        attributes=["daily_ema_20", "daily_atr_14"], row_id="feature_id", valid_date="trade_date", known_at="known_at", complete=complete,
    )


def p5_found(spark, folder: str) -> DataFrame:
    """The daily row valid and known at each trade's trigger: with complete rows only, both histories name the same row."""
    found = trade_attributes(spark, folder, complete=True)
    return found.where(F.col("daily_ema_20_row") == F.col("daily_atr_14_row")).select("trade_id", F.col("daily_ema_20_row").alias("feature_id"))


def p5_attributes(spark, folder: str) -> DataFrame:
    """Each attribute with its own last known value, updated independently."""
    out = trade_attributes(spark, folder, complete=False)
    return out.select("trade_id", F.round("daily_ema_20", 8).alias("daily_ema_20"), "daily_ema_20_row", F.round("daily_atr_14", 8).alias("daily_atr_14"), "daily_atr_14_row")
