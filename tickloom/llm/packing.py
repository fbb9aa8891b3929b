"""Items of varying length into containers under several limits at once.

Vector bin packing: an item takes tokens, one segment and loss-bearing tokens; a container limits all three. The dot-product
heuristic fills one container at a time with the item whose demand has the largest inner product with what the container
has left, among those that fit. Items only meet within shards of a bounded number drawn by hash, so any table packs in
parallel; a shard leaves at most a few containers part empty, out of thousands. An item of more tokens than a container is
cut into full containers and one rest, which is packed with the others; no other item is cut. A piece whose loss-bearing
tokens alone exceed their limit, as in a full container, has a container to itself.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tokens import TOKENIZER, token_counts
from tickloom.operators.segments import map_sorted_groups
from tickloom.runtime import durable, table

#: Items of a shard, on average.
SHARD_ITEMS = 20_000
#: Tokens of capacity per segment that a container may hold, and the share of its tokens that may bear loss.
TOKENS_PER_SEGMENT, LOSS_SHARE = 64, 0.98
#: What ends a container: nothing waiting has as few tokens, or as little loss; no segment is left; nothing waits.
TOKENS, LOSS, SEGMENTS, NOTHING, ALONE = "tokens", "loss", "segments", "end", "alone"
#: Container sizes a table may name.
MOST_PACKS = 1000


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_capacity: int) -> tuple[np.ndarray, list[str]]:
    """Container number of each item, and what ended each container. Every item fits an empty container by itself.

    Items of one size in tokens wait in a list sorted by loss. Scores of all sizes are one vector; a size whose best item has too
    much loss for what is left is looked up again for its best fitting one.
    """
    n = len(tokens)
    out = np.full(n, -1, dtype=np.int64)
    waiting: list[list[tuple[int, int]] | None] = [None] * (capacity + 1)
    for i in np.argsort(loss, kind="stable").tolist():
        t = int(tokens[i])
        if waiting[t] is None:
            waiting[t] = []
        waiting[t].append((int(loss[i]), i))
    sizes = np.array([t for t in range(capacity + 1) if waiting[t]], dtype=np.int64)
    most = np.array([waiting[t][-1][0] for t in sizes], dtype=np.float64)  # the largest loss waiting per size; -1: none
    a, b = 1.0 / capacity**2, 1.0 / max(loss_capacity, 1) ** 2
    left, container, ended = n, 0, []
    while left:
        room, room_loss, room_segments = capacity, loss_capacity, segments
        end = NOTHING
        while left:
            if not room_segments:
                end = SEGMENTS
                break
            k = int(np.searchsorted(sizes, room, side="right"))
            if not k or (most[:k] < 0).all():
                end = TOKENS
                break
            score = np.where(most[:k] >= 0, a * room * sizes[:k] + b * room_loss * np.minimum(most[:k], room_loss), -1.0)
            tight = np.flatnonzero(most[:k] > room_loss)
            picks: dict[int, int] = {}
            for j in tight.tolist():
                at = bisect_right(waiting[sizes[j]], (room_loss, n)) - 1
                picks[j] = at
                score[j] = a * room * sizes[j] + b * room_loss * waiting[sizes[j]][at][0] if at >= 0 else -1.0
            j = int(score.argmax())
            if score[j] < 0:
                end = LOSS
                break
            t = int(sizes[j])
            spent, i = waiting[t].pop(picks.get(j, -1))
            most[j] = waiting[t][-1][0] if waiting[t] else -1.0
            out[i] = container
            room, room_loss, room_segments = room - t, room_loss - spent, room_segments - 1
            left -= 1
        container += 1
        ended.append(end)
        if container % 256 == 0:
            alive = most >= 0
            sizes, most = sizes[alive], most[alive]
    return out, ended


_OUT = "pack_name string, container string, doc_id long, copy long, piece long, token_start long, tokens long, loss_tokens long, closed_by string"


def _shard(group: pa.Table) -> pa.RecordBatch | None:
    capacity = group["capacity"][0].as_py()
    bins, ended = pack(group["tokens"].to_numpy(), group["loss_tokens"].to_numpy(), capacity, group["segments"][0].as_py(), group["loss_capacity"][0].as_py())
    head = f"{group['shard'][0].as_py()}-"
    one = lambda c: group[c].combine_chunks()
    at = bins.tolist()
    cols = [one("pack_name"), pa.array([head + str(x) for x in at]), *map(one, ("doc_id", "copy", "piece", "token_start", "tokens", "loss_tokens")), pa.array([ended[x] for x in at])]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _OUT.split(", ")])


def packed(counts: DataFrame, packs: DataFrame, *, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = LOSS_SHARE, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(pack_name, container, doc_id, copy, piece, token_start, tokens, loss_tokens, closed_by): each document in the containers of each pack.

    ``counts`` is what token_counts gives. Pieces of a document cover its tokens from token_start on, in order of ``piece``; a
    document no larger than the capacity is one piece. A container holds at most capacity_tokens, capacity / tokens_per_segment
    pieces and loss_share * capacity loss-bearing tokens, but for pieces that exceed the last alone and have a container to themselves.
    ``closed_by`` says what ended the container. Packs without a name or a positive capacity are left out, repeated ones count
    once, more than MOST_PACKS are an error. Repeated documents are packed as often as they come, told apart by ``copy``. Containers
    depend on the rows only, not on how files hold them. Empty tables give an empty result.
    """
    col = F.col
    items = durable(counts.where("tokens > 0").groupBy("doc_id", "tokens", "prompt_tokens").agg(F.count("*").alias("copies")))
    shards = max(1, -(-(items.agg(F.sum("copies")).first()[0] or 0) // shard_items))
    sizes = _sizes(packs, tokens_per_segment, loss_share)
    if not sizes:
        return items.sparkSession.createDataFrame([], _OUT)
    each = items.withColumn("pack", F.explode(F.array(*[F.struct(*[F.lit(x).cast("string" if k == "pack_name" else "bigint").alias(k) for k, x in s.items()]) for s in sizes])))
    each = each.select("pack.*", "doc_id", "tokens", "prompt_tokens", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
    pieces = each.withColumn("piece", F.explode(F.expr("sequence(0L, (tokens - 1) div capacity)"))).withColumn("token_start", col("piece") * col("capacity"))
    size = F.least(col("capacity"), col("tokens") - col("token_start"))
    loss = F.greatest(F.lit(0), F.least(size, col("token_start") + size - col("prompt_tokens"))).cast("bigint")
    pieces = pieces.select("pack_name", "capacity", "segments", "loss_capacity", "doc_id", "copy", "piece", "token_start", size.alias("tokens"), loss.alias("loss_tokens"))
    alone = (col("tokens") >= col("capacity")) | (col("loss_tokens") > col("loss_capacity"))
    single = pieces.where(alone).select("pack_name", F.concat_ws("-", F.lit("alone"), "doc_id", "copy", "piece").alias("container"), "doc_id", "copy", "piece", "token_start", "tokens", "loss_tokens", F.lit(ALONE).alias("closed_by"))
    rest = pieces.where(~alone).withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece", "pack_name"), F.lit(shards)).cast("bigint"))
    return single.unionByName(map_sorted_groups(rest, ["pack_name", "shard"], ["doc_id", "copy", "piece", "tokens", "loss_tokens"], _shard, _OUT))


def _sizes(packs: DataFrame, tokens_per_segment: int, loss_share: float) -> list[dict]:
    """The containers and their limits; their number is checked, since every task gets them."""
    rows = packs.where("pack_name is not null and capacity_tokens > 0").groupBy(F.col("pack_name").cast("string").alias("pack_name")).agg(F.max("capacity_tokens").cast("bigint").alias("capacity")).limit(MOST_PACKS + 1).collect()
    if len(rows) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} container sizes")
    return [{"pack_name": r["pack_name"], "capacity": (c := r["capacity"]), "segments": max(1, c // tokens_per_segment), "loss_capacity": max(1, int(c * loss_share))} for r in sorted(rows)]


def p7_packed(spark, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every document in the containers of each pack."""
    return packed(token_counts(table(spark, folder, "documents"), tokenizer), table(spark, folder, "pack_sizes"))


def p7_report(spark, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per pack: containers, pieces, the share of space filled, the fullest container in each respect and what ended how many."""
    out = p7_packed(spark, folder, tokenizer)
    per = out.groupBy("pack_name", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.sum("loss_tokens").alias("loss_tokens"), F.first("closed_by").alias("closed_by"))
    sizes = table(spark, folder, "pack_sizes").groupBy("pack_name").agg(F.max("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    shared = F.col("closed_by") != ALONE
    ends = [F.count_if(F.col("closed_by") == e).alias(f"closed_by_{e}") for e in (TOKENS, LOSS, SEGMENTS, NOTHING, ALONE)]
    total = per.groupBy("pack_name").agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.max("pieces").alias("most_pieces"), F.max(F.when(shared, F.col("loss_tokens"))).alias("most_loss"), *ends
    )
    return total.join(sizes, "pack_name").withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
