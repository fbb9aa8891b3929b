"""Sources mixed to target shares of all tokens, small ones repeated up to a cap.

The mixture is a row of slots of equal tokens. Slot j belongs to the source in whose part of the cumulative weights the
golden-ratio point frac(j * 0.618...) lies, so every stretch of the mixture has the right shares, not only the whole.
Slots are ranked per source. Each source's documents, shuffled by hash, form a tape as long as its repeats allow; the tape is
cut into blocks of a slot's tokens and block r fills the source's r-th slot. A document that does not end with its block runs on
in the next block of its source. Only the last block of a source is longer or shorter: it takes its last document to the
end, so none is used in part.

The mixture is as long as the documents of its sources together. A source whose cap keeps it under its share gives all its
cap allows, and what it lacks goes to the others in proportion to their targets, so those keep their ratios. Tape
places and ranks are prefix sums in two levels: within shards of a bounded number of rows and over the table of shards, so a
source with a third of all documents is many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.tokens import TOKENIZER, token_counts
from tickloom.runtime import durable, table

GOLDEN = (math.sqrt(5) - 1) / 2
BLOCK_TOKENS = 1024
SHARD_DOCUMENTS = 4096
SLOT_CHUNK = 65_536
#: Sources a table of targets may name; its rows go to every task.
MOST_SOURCES = 10_000


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    good = targets.where("source is not null and target_share > 0 and max_repeats > 0")
    good = good.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").cast("double").alias("share"), F.max("max_repeats").cast("bigint").alias("repeats"))
    rows = good.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return sorted((r["source"], r["share"], r["repeats"]) for r in rows)


def amounts(wanted: dict[str, float], most: dict[str, float], total: float) -> dict[str, float]:
    """Sizes per source that add up to ``total`` if they can: in proportion to ``wanted``, but for sources held at ``most``."""
    out: dict[str, float] = {}
    free = dict(wanted)
    while free:
        rest, weight = total - sum(out.values()), sum(free.values())
        held = [s for s, w in free.items() if most[s] < rest * w / weight]
        if not held:
            return out | {s: rest * w / weight for s, w in free.items()}
        for s in held:
            out[s] = float(most[s])
            del free[s]
    return out


def _owners(bounds: list[float]):
    """Slots to the place of the source whose part of the cumulative weights holds the slot's golden-ratio point."""

    def run(batches):
        for batch in batches:
            slot = batch.column("id").to_numpy()
            at = np.minimum(np.searchsorted(bounds, (slot * GOLDEN) % 1.0, side="right"), len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at, pa.int32())], names=["slot", "source"])

    return run


def _lookup(values: list, kind: str) -> Column:
    """A source's value by its place in the list."""
    return F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("source") + 1)


def mixture(counts: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None) -> DataFrame:
    """(slot, place, doc_id, source, use, token_start, tokens): the documents of the mixture in order of slot and place.

    ``counts`` is what token_counts gives. ``use`` counts the uses of a document from 1; a use that runs over several slots
    has one row in each, from token_start on. Sources are compared without case and outer blanks; those without a target are
    not used, those without documents leave their share to the others in proportion. A doc_id repeated in the table counts
    once, with its smallest size. No document is used more than max_repeats times. ``total_tokens`` is the size of the
    mixture, by default that of the sources' documents. With less than one block in all, or an empty table, the result is empty.
    """
    col = F.col
    wanted = _targets(targets)
    spark = counts.sparkSession
    empty = spark.createDataFrame([], "slot long, place long, doc_id long, source string, use int, token_start long, tokens long")
    if not wanted:
        return empty
    docs = counts.where(col("source").isin([w[0] for w in wanted]) & (col("tokens") > 0)).groupBy("doc_id").agg(F.min(F.struct("tokens", "source")).alias("x")).select("doc_id", "x.tokens", "x.source")
    docs = durable(docs)
    have = {r["source"]: (r["tokens"], r["docs"]) for r in docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    used = [(s, w, k, *have[s]) for s, w, k in wanted if s in have]
    if not used:
        return empty
    sizes = amounts({s: w for s, w, *_ in used}, {s: k * tokens for s, _, k, tokens, _ in used}, total_tokens or sum(u[3] for u in used))
    whole = sum(sizes.values())
    slots = int(whole / block_tokens)
    if not slots:
        return empty
    # slots, owners and ranks per owner; from here on a source is its place in ``used``
    bounds = (np.cumsum([sizes[u[0]] for u in used]) / whole).tolist()
    line = spark.range(slots).mapInArrow(_owners(bounds), "slot long, source int").withColumn("chunk", F.expr(f"slot div {SLOT_CHUNK}"))
    ahead = line.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    ahead = durable(ahead)
    blocks = {r["source"]: r["n"] for r in ahead.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    ahead = ahead.select("source", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = line.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1).join(ahead.hint("merge"), ["source", "chunk"]).select("source", (col("r") + col("before")).alias("rank"), "slot")
    # joins sort and merge: all sides grow with the corpus, however small they are taken for
    # places of documents on their source's tape
    place = F.create_map(*[x for i, u in enumerate(used) for x in (F.lit(u[0]), F.lit(i))])
    total, n_blocks = [u[3] for u in used], [blocks.get(i, 0) for i in range(len(used))]
    uses = [min(u[2], -(-n * block_tokens // u[3])) for u, n in zip(used, n_blocks)]
    tape = docs.select(place[col("source")].alias("source"), "doc_id", "tokens", F.xxhash64("doc_id", F.lit(17)).alias("h"))
    tape = tape.withColumn("shard", F.pmod("h", _lookup([max(1, -(-u[4] // SHARD_DOCUMENTS)) for u in used], "bigint")))
    shards = tape.groupBy("source", "shard").agg(F.sum("tokens").alias("n"))
    shards = shards.select("source", "shard", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "shard").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tape = tape.withColumn("at", upto).join(shards.hint("merge"), ["source", "shard"]).withColumn("at", col("at") + col("before"))
    end = _lookup(n_blocks, "bigint") * block_tokens
    passes = tape.withColumn("use", F.explode(F.sequence(F.lit(0), _lookup(uses, "int") - 1))).withColumn("at", col("at") + col("use") * _lookup(total, "bigint"))
    passes = passes.where((_lookup(uses, "int") > 0) & (col("at") < end))
    # a document lies in every block from its first to its last token, at most in the source's last one
    last = F.least(F.expr(f"(at + tokens - 1) div {block_tokens}"), _lookup(n_blocks, "bigint") - 1)
    runs = passes.withColumn("last", last).withColumn("rank", F.explode(F.sequence(F.expr(f"at div {block_tokens}"), col("last"))))
    start = F.greatest(col("rank") * block_tokens - col("at"), F.lit(0))
    stop = F.when(col("rank") == _lookup(n_blocks, "bigint") - 1, col("tokens")).otherwise(F.least(col("tokens"), (col("rank") + 1) * block_tokens - col("at")))
    runs = runs.select("source", "rank", (col("at") + start - col("rank") * block_tokens).alias("place"), "doc_id", (col("use") + 1).alias("use"), start.alias("token_start"), (stop - start).alias("tokens"))
    return runs.join(ranked.hint("merge"), ["source", "rank"]).select("slot", "place", "doc_id", _lookup([u[0] for u in used], "string").alias("source"), "use", "token_start", "tokens")


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its target and really reached share of tokens, documents used, uses and the most uses of one."""
    col = F.col
    per = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count_if(col("token_start") == 0).alias("uses"))
    per = per.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    want = targets.where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = want.join(per, "source", "left").fillna(0, ["tokens", "documents", "uses", "most_uses"])
    return out.withColumn("reached_share", F.round(F.coalesce(F.try_divide(col("tokens"), F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)), 8))


def p8_mixture(spark, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The documents of the mixture in order."""
    return mixture(token_counts(table(spark, folder, "documents"), tokenizer), table(spark, folder, "mix_targets"))


def p8_shares(spark, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The shares the mixture reaches."""
    return reached(p8_mixture(spark, folder, tokenizer), table(spark, folder, "mix_targets"))


def p8_slots(spark, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per source: its slots and the tokens they hold, which are equal but for the last slot of a source."""
    per = p8_mixture(spark, folder, tokenizer).groupBy("source", "slot").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    full = F.count_if(F.col("tokens") == BLOCK_TOKENS).alias("exact")
    return per.groupBy("source").agg(F.count("*").alias("slots"), full, F.min("tokens").alias("least_tokens"), F.max("tokens").alias("most_tokens"), F.sum("tokens").alias("tokens"), F.max("pieces").alias("most_pieces"))
