import numpy as np
from pyspark.sql import functions as F

from tickloom.llm.mixing import amounts, mixture, reached

COUNTS = "doc_id long, source string, tokens long, prompt_tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def data(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i, s, int(rng.integers(20, 400)), 0))
    return spark.createDataFrame(rows, COUNTS)


def test_shares_and_caps(spark):
    c = data(spark, {"big": 2000, "mid": 500, "small": 60})
    t = spark.createDataFrame([("Big ", 0.3, 1), ("mid", 0.4, 3), ("small", 0.2, 2), ("none", 0.1, 4)], TARGETS)
    m = mixture(c, t, block_tokens=512)
    r = {x["source"]: x for x in reached(m, t).collect()}
    assert r["small"]["most_uses"] <= 2 and r["mid"]["most_uses"] <= 3 and r["big"]["most_uses"] == 1
    # small is held at its cap, the others keep their ratio
    assert abs(r["big"]["reached_share"] / r["mid"]["reached_share"] - 0.75) < 0.03
    assert r["small"]["uses"] > 110 and r["none"]["tokens"] == 0 and r["none"]["reached_share"] == 0
    assert abs(sum(x["reached_share"] for x in r.values()) - 1) < 1e-6


def test_every_stretch_is_mixed(spark):
    c = data(spark, {"a": 1500, "b": 1500})
    t = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 2)], TARGETS)
    p = mixture(c, t, block_tokens=256).toPandas().sort_values(["slot", "place"])
    for k in range(8):
        part = p.iloc[k * len(p) // 8 : (k + 1) * len(p) // 8]
        assert abs(part[part.source == "a"].tokens.sum() / part.tokens.sum() - 0.7) < 0.06
    assert not p.duplicated(["doc_id", "use", "token_start"]).any()


def test_slots_are_full_and_documents_whole(spark):
    c = data(spark, {"a": 700, "b": 300, "c": 5}, seed=3).unionAll(spark.createDataFrame([(5000, "a", 9000, 0)], COUNTS))
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.37, 3), ("c", 0.03, 4)], TARGETS)
    p = mixture(c, t, block_tokens=512).toPandas()
    per = p.groupby(["source", "slot"]).tokens.sum().reset_index()
    for _, g in per.groupby("source"):
        g = g.sort_values("slot")
        assert (g.tokens.iloc[:-1] == 512).all()
    assert sorted(per.slot) == list(range(len(per)))
    size = {r["doc_id"]: r["tokens"] for r in c.collect()}
    for (doc, use), g in p.groupby(["doc_id", "use"]):
        g = g.sort_values("token_start")
        assert g.tokens.sum() == size[doc] and (g.token_start.to_numpy() == np.r_[0, g.tokens.cumsum().to_numpy()[:-1]]).all()


def test_amounts():
    assert amounts({"a": 1.0, "b": 1.0}, {"a": 10, "b": 1000}, 100) == {"a": 10.0, "b": 90.0}
    assert amounts({"a": 3.0, "b": 1.0}, {"a": 1000, "b": 1000}, 100) == {"a": 75.0, "b": 25.0}
    assert amounts({"a": 1.0}, {"a": 5}, 100) == {"a": 5.0}


def test_edges(spark):
    c = spark.createDataFrame([(1, "a", 900, 0), (1, "a", 900, 0), (2, None, 50, 0), (3, "x", 50, 0), (4, "a", 0, 0), (5, "a", None, None)], COUNTS).withColumn("h", F.lit(1)).withColumn("rank", F.lit(2))
    t = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 2), ("b", None, 1), ("c", 0.2, None)], TARGETS).withColumn("slot", F.lit(1))
    p = mixture(c, t, block_tokens=100).toPandas()
    assert set(p.doc_id) == {1} and p.use.max() <= 2
    assert mixture(c.limit(0), t).count() == 0 and mixture(c, t.limit(0)).count() == 0
