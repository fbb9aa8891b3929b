import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm.packing import pack, packed
from tickloom.llm.tokens import TOKENIZER, load, token_counts

COUNTS = "doc_id long, source string, tokens long, prompt_tokens long"
PACKS = "pack_name string, capacity_tokens int"


def test_heuristic_keeps_every_limit():
    rng = np.random.default_rng(1)
    for cap, seg, share in ((100, 100, 1.0), (100, 3, 1.0), (64, 8, 0.6)):
        loss_cap = int(cap * share)
        t = rng.integers(1, loss_cap + 1, 400)
        w = np.minimum(rng.integers(0, 200, 400), t)
        b, ended = pack(t, w, cap, seg, loss_cap)
        assert len(ended) == b.max() + 1 and set(ended) <= {"tokens", "loss", "segments", "end"} and ended.count("end") <= 1
        assert (b >= 0).all() and set(b) == set(range(b.max() + 1))
        assert np.bincount(b, t).max() <= cap and np.bincount(b, w).max() <= loss_cap and np.bincount(b).max() <= seg
    t = rng.integers(1, 60, 3000)
    b, _ = pack(t, t, 256, 256, 256)
    assert t.sum() / ((b.max() + 1) * 256) > 0.99


def check(out, counts, packs, per=64):
    p = out.toPandas()
    for name, cap in packs:
        q = p[p.pack_name == name]
        size = q.groupby("container").agg(tokens=("tokens", "sum"), n=("doc_id", "size"), loss=("loss_tokens", "sum"), closed=("closed_by", "first"))
        assert size.tokens.max() <= cap and size.n.max() <= max(1, cap // per)
        assert ((size.loss <= int(cap * 0.98)) | (size.n == 1) & (size.closed == "alone")).all()
        for doc, g in q.groupby("doc_id"):
            whole = dict((c[0], c[2]) for c in counts)[doc]
            g = g.sort_values("token_start")
            assert g.tokens.sum() == whole and (g.token_start.to_numpy() == np.r_[0, g.tokens.cumsum().to_numpy()[:-1]]).all()
            assert len(g) == (whole + cap - 1) // cap
    return p


def test_all_documents_whole_unless_too_large(spark):
    rng = np.random.default_rng(2)
    counts = [(i, "s", int(rng.integers(1, 700)), int(rng.integers(0, 20))) for i in range(400)] + [(1000, "s", 5000, 3)]
    packs = [("a", 512), ("b", 2048)]
    df = spark.createDataFrame(counts, COUNTS)
    p = check(packed(df, spark.createDataFrame(packs, PACKS), shard_items=150), counts, packs)
    assert p.tokens.sum() == 2 * sum(c[2] for c in counts)


def test_every_limit_binds(spark):
    rng = np.random.default_rng(4)
    counts = [(i, "s", int(rng.integers(2, 300 if i % 3 else 20)), int(rng.integers(0, 5))) for i in range(6000)]
    p = packed(spark.createDataFrame(counts, COUNTS), spark.createDataFrame([("a", 1024)], PACKS), shard_items=8000).toPandas()
    ends = p.groupby("container").closed_by.first().value_counts()
    assert min(ends.get(k, 0) for k in ("tokens", "loss", "segments")) > 0
    # what fits is never cut, whatever the loss limit
    q = packed(spark.createDataFrame([(1, "s", 100, 0), (2, "s", 64, 0), (3, "s", 129, 0)], COUNTS), spark.createDataFrame([("a", 100)], PACKS), loss_share=0.5).toPandas()
    assert q.groupby("doc_id").size().to_dict() == {1: 1, 2: 1, 3: 2} and q.container.nunique() == 4


def test_containers_do_not_depend_on_files(spark):
    counts = [(i % 90, "s", 10 + i % 7 * 9, i % 3) for i in range(300)]
    df, packs = spark.createDataFrame(counts, COUNTS), spark.createDataFrame([("a", 128)], PACKS)
    order = ["container", "doc_id", "copy", "piece", "tokens"]
    a, b = (packed(x, packs, shard_items=60).toPandas().sort_values(order).reset_index(drop=True) for x in (df.coalesce(1), df.repartition(7)))
    assert a.equals(b)


def test_edges(spark):
    counts = spark.createDataFrame([(1, "s", 10, 0), (1, "s", 10, 0), (2, None, 0, 0), (3, "s", None, None)], COUNTS).withColumn("uid", F.lit(1)).withColumn("shard", F.lit(1))
    packs = spark.createDataFrame([("a", 16), ("a", 16), (None, 5), ("z", 0), ("y", None)], PACKS).withColumn("segments", F.lit(1))
    p = packed(counts, packs).toPandas()
    assert len(p) == 2 and p.tokens.tolist() == [10, 10] and p.container.nunique() == 2 and sorted(p["copy"]) == [0, 1]
    assert packed(counts.limit(0), packs).count() == 0 and packed(counts, packs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no public tokenizer here")
def test_token_counts(spark):
    rows = [(1, "One two three\nfour five.", "News "), (2, "", "a"), (3, None, None), (4, "x" * 50_000, None), (5, " ", None), (None, "lost", None), (6, "日本語 \U0001f600 é", "b")]
    out = {r["doc_id"]: r for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    e = load(TOKENIZER)
    assert set(out) == {1, 4, 5, 6} and out[1]["source"] == "news"
    for i, text, _ in rows:
        if i in out:
            assert out[i]["tokens"] == len(e.encode_ordinary(text))
            assert e.decode(e.encode_ordinary(text)) == text
    assert 0 < out[1]["prompt_tokens"] < out[1]["tokens"] and out[4]["prompt_tokens"] == 0
