import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tickloom.llm.nearest import MINUTE_US, nearest_match

L = "lid string, k string, lt timestamp"
R = "rid long, k string, rt timestamp"
T0 = datetime(2024, 3, 1, 5, 55, tzinfo=timezone.utc)


def run(left, right, **kw):
    out = nearest_match(left, right, left_id="lid", left_ts="lt", right_id="rid", right_ts="rt", entity="k", tolerance_us=10 * MINUTE_US, **kw).collect()
    assert len({r["left_id"] for r in out}) == len(out)
    return {r["left_id"]: r["right_id"] for r in out}


def brute(ls, rs):
    first = {}
    for i, k, t in ls:
        if i is not None and k is not None and t is not None:
            first[i] = min(first.get(i, (t, k.strip().upper())), (t, k.strip().upper()))
    out = {}
    for i, (t, k) in first.items():
        c = [(abs(t - rt), rt, rid) for rid, rk, rt in rs if rid is not None and rk is not None and rt is not None and rk.strip().upper() == k and abs(t - rt) <= timedelta(minutes=10)]
        if c:
            out[i] = min(c)[2]
    return out


def make(seed, n=150, m=200):
    r = random.Random(seed)
    when = lambda: T0 + timedelta(minutes=r.randrange(0, 1500) / r.choice([1, 2]), microseconds=r.choice([0, 0, 7]))
    key = lambda: r.choice(["a", "A ", " b", "B", "c"])
    return [(f"l{r.randrange(n)}", key(), when()) for _ in range(n)], [(i, key(), when()) for i in range(m)]


def test_against_brute_force(spark):
    for seed in range(3):
        ls, rs = make(seed)
        assert run(spark.createDataFrame(ls, L), spark.createDataFrame(rs, R)) == brute(ls, rs)


def test_small_batches_and_blocks(spark):
    ls, rs = make(9)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert run(spark.createDataFrame(ls, L), spark.createDataFrame(rs, R), block_us=20 * MINUTE_US) == brute(ls, rs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ties_edges_nulls_and_clashes(spark):
    m = lambda x: T0 + timedelta(minutes=x)
    ls = [("tie", "a", m(5)), ("edge", "a", m(30)), ("far", "a", m(60)), ("same", "a", m(100)), (None, "a", m(5)), ("nokey", None, m(5)), ("notime", "a", None)]
    rs = [(1, "a", m(3)), (2, "a", m(7)), (3, "a", m(20)), (5, "a", m(100)), (4, "a", m(100)), (None, "a", m(5)), (9, None, m(5)), (8, "a", None), (4, "a", m(100))]
    left = spark.createDataFrame(ls, L).withColumn("rid", F.lit("x")).withColumn("ne_us", F.lit(1))
    right = spark.createDataFrame(rs, R).withColumn("lid", F.lit("x")).withColumn("ne_block", F.lit(1))
    assert run(left, right) == {"tie": 1, "edge": 3, "same": 4}
    assert run(left.limit(0), right) == {} and run(left, right.limit(0)) == {}
