import json

import numpy as np

from tickloom.operators.drift import assign, clusters, concepts, name_similarity, resemblance, schema_changes, unified_records

FILES = "file_id long, contract string, symbol string, feed_id int, file_seq int, path string, received_at timestamp, manifest string"
RECORDS = "record_id long, file_id long, contract string, bar_no int, payload string"


def build(spark, files, records):
    return spark.createDataFrame(files, FILES), spark.createDataFrame(records, RECORDS)


def a_file(i, manifest, seq=None, contract="A"):
    return (i, contract, "A", 1, seq or i, f"p{i}", None, json.dumps(manifest) if isinstance(manifest, dict) else manifest)


def values(n):
    return {"High": 100.5 + n, "TotalVolume": 10 * n + 3, "IsRealtime": bool(n % 2)}


def changes(f, r):
    out, _, _ = schema_changes(f, r)
    return {(x["file_id"], x["field_name"], x["change"], x["old_name"]) for x in out.collect()}


def case(spark, extra_files=(), extra_records=()):
    hashes = ["a" * 16, "b" * 16, "c" * 16, "a" * 16]
    files = [a_file(1, {"schema_version": 1, "file_hash": hashes[0], "row_count": 8}), a_file(2, {"schema_version": 2, "sha16": hashes[1], "row_count": 8}), a_file(3, {"schema_version": 2, "sha16": hashes[2], "row_count": 8, "code_commit": "abc1234"}), a_file(4, {"schema_version": 1, "file_hash": hashes[3], "row_count": 8})]
    records = []
    for n in range(1, 9):
        records.append((len(records) + 1, 1, "A", n, json.dumps(values(n))))
    for n in range(5, 13):
        v = values(n)
        records.append((len(records) + 1, 2, "A", n, json.dumps({"HighPx": v["High"], "TotalVolume": str(v["TotalVolume"]), "IsRealtime": v["IsRealtime"]})))
    for n in range(9, 17):
        v = values(n)
        records.append((len(records) + 1, 3, "A", n, json.dumps({"HighPx": v["High"], "TotalVolume": str(v["TotalVolume"]), "Spread": (n * 7) % 5})))
    return build(spark, [*files, *extra_files], [*records, *extra_records])


WANT = {(2, "sha16", "renamed", "file_hash"), (2, "HighPx", "renamed", "High"), (2, "TotalVolume", "retyped", None), (3, "IsRealtime", "removed", None), (3, "Spread", "added", None), (3, "code_commit", "added", None)}


def test_each_change_and_a_redelivered_file(spark):
    assert changes(*case(spark)) == WANT


def test_nulls_bad_json_and_repeats(spark):
    files = [a_file(11, None, 1, "B"), a_file(12, "not json", 2, "B"), a_file(13, {"x": None}, 3, "B"), (None, None, None, None, None, None, None, None)]
    records = [(901, 11, "B", None, None), (902, 12, "B", 1, "[1, 2"), (None, None, None, None, None), (903, 13, "B", 1, "{}")]
    f, r = case(spark, files, records)
    r = r.unionAll(r)
    assert changes(f, r) == WANT | {(13, "x", "added", None)}


def test_empty(spark):
    f, r = build(spark, [], [])
    assert changes(f, r) == set()


def test_one_table_over_names(spark):
    f, r = case(spark)
    out = unified_records(f, r.unionAll(r.limit(3)))
    rows = {x["record_id"]: x for x in out.collect()}
    assert out.count() == len(rows) == 24 and set(out.columns) == {"record_id", "file_id", "contract", "bar_no", "HighPx", "TotalVolume", "IsRealtime", "other"}
    assert rows[9]["HighPx"] == rows[5]["HighPx"] == 105.5 and rows[9]["TotalVolume"] == 53 and rows[9]["IsRealtime"] is True
    assert rows[24]["HighPx"] == 116.5 and rows[24]["IsRealtime"] is None and rows[24]["other"] == {"Spread": str((16 * 7) % 5)}
    assert unified_records(f.limit(0), r.limit(0)).count() == 0


def test_what_is_found_elsewhere_helps_where_values_are_silent(spark):
    files, records = [], []
    for k in range(4):
        c, last = f"C{k}", k == 3
        files += [a_file(10 * k + 1, {"file_hash": f"{k}a" * 8}, 1, c), a_file(10 * k + 2, {"file_hash": f"{k}b" * 8}, 2, c)]
        for n in range(1, 9):
            records.append((1000 * k + n, 10 * k + 1, c, n, json.dumps({"Vwap": 10.25 + 7 * n})))
            # the last contract's files share no bar, and its values are of another size
            m = n + 100 if last else n
            records.append((1000 * k + 500 + n, 10 * k + 2, c, m, json.dumps({"AvgPx": 10.25 + 7 * n + (90_000 if last else 0)})))
    got = changes(*build(spark, files, records))
    assert got == {(10 * k + 2, "AvgPx", "renamed", "Vwap") for k in range(4)}
    alone = changes(*build(spark, files[6:], [r for r in records if r[2] == "C3"]))
    assert alone == {(32, "AvgPx", "added", None), (32, "Vwap", "removed", None)}


def test_names_and_sketches():
    assert concepts("LowPx") == concepts("low_px") == {"low", "px"}
    assert name_similarity("schema_version", "schemaVersion") == 1.0
    assert name_similarity("OpenInterest", "TradeCount") < 0.4
    assert resemblance([1, 2, 3], [1, 2, 3]) == 1 and resemblance([1, 2], [2, 3]) == 1 / 3 and resemblance(None, [1]) == 0


def test_clusters_keep_apart_what_files_hold_together():
    names = {"a": 9, "b": 5, "c": 4, "d": 2}
    assert clusters(names, [("a", "b", 7), ("c", "b", 3), ("c", "d", 2)], {("a", "c")}) == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_matching_is_optimal():
    rng = np.random.default_rng(3)
    import itertools

    for _ in range(30):
        n, m = rng.integers(1, 5, 2)
        w = rng.normal(size=(n, m))
        got = sum(w[i, j] for i, j in assign(w))
        pad = np.zeros((max(n, m), max(n, m)))
        pad[:n, :m] = np.maximum(w, 0)
        best = max(sum(pad[i, p[i]] for i in range(len(pad))) for p in itertools.permutations(range(len(pad))))
        assert abs(got - best) < 1e-9
