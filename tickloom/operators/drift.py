"""Field sets, names and types that drift from file to file.

Each file is profiled column by column: how many values of each JSON type, moments, and a sketch of its values (the least
hashes of what they say), all of which add up, so a file may be read in any number of parts. Neighbouring files of a
contract are compared field by field. Renames are found by a bipartite matching (Hungarian) of the vanished with the new
fields of a file; a pair is weighed by the agreement of values on the bars both files deliver (rare values count more), the
kinship of sketches, moments and types, and the similarity of names. Matched columns are then unified: along the chain of
renames of a contract, and over contracts by clustering the names that renames link and files never hold together.

JSON is parsed in Arrow batches, once where the records are read for the profiles, which alone are shuffled, and once more
for the values of vanished and new fields on shared bars. Matching sees one file at a time, and goes over the files twice:
what the first round finds often tells the second which names belong together.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.segments import map_sorted_groups
from tickloom.runtime import durable, table

#: Hashes a sketch keeps, and bars of a block in which two files' values are compared.
SKETCH, BAR_BLOCK = 8, 4096
#: Renames found elsewhere that make two names as good as alike.
LEAST_LINKS = 3
#: Distinct field names over all files that unification accepts; their links are clustered in one place.
MOST_NAMES = 10_000
HEX = re.compile(r"^[0-9a-f]{6,64}$")


def concepts(name: str) -> set[str]:
    """The words of a field name."""
    return {w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if w}


def name_similarity(a: str, b: str) -> float:
    """Share of words two names have in common, or of their letter pairs if that is more; from 0 to 1."""
    x, y = concepts(a), concepts(b)
    words = len(x & y) / len(x | y) if x | y else 0.0
    pairs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    p, q = (pairs(re.sub(r"[^a-z0-9]", "", s.lower())) for s in (a, b))
    letters = 2 * len(p & q) / (len(p) + len(q)) if p and q else 0.0
    return max(words, 0.8 * letters)


def resemblance(a: list[int] | None, b: list[int] | None) -> float:
    """Share of values two sketches have in common, estimated from the least hashes of both together."""
    x, y = set(a or []), set(b or [])
    if not x or not y:
        return 0.0
    least = sorted(x | y)[:SKETCH]
    return sum(h in x and h in y for h in least) / len(least)


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching by the Hungarian algorithm; pairs of weight zero or less are not matched."""
    n, m = weight.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = -np.maximum(weight, 0.0)
    u, v = np.zeros(size + 1), np.zeros(size + 1)
    match, way = np.zeros(size + 1, dtype=int), np.zeros(size + 1, dtype=int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least = np.full(size + 1, np.inf)
        used = np.zeros(size + 1, dtype=bool)
        while True:
            used[j0] = True
            i0, free = match[j0], ~used
            free[0] = False
            reduced = cost[i0] - u[i0] - v
            better = free & (reduced < least)
            least[better], way[better] = reduced[better], j0
            j1 = int(np.flatnonzero(free)[np.argmin(least[free])])
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] <= n and weight[match[j] - 1, j - 1] > 0]


def pair_weight(old: dict, new: dict, agreement: tuple[int, float, float] | None, known: frozenset = frozenset()) -> float:
    """How much speaks for ``new`` carrying on ``old``; positive is a rename.

    ``known``: pairs of names that carry on one another elsewhere, which are as good as alike.

    ``agreement``: the number of shared bars with both values, on how many they agree, and how much those agreements tell, in nats,
    a rare value more than a common one.
    """
    if old["section"] != new["section"]:
        return -1.0
    linked = (old["name"], new["name"]) in known
    similar = 1.0 if linked else name_similarity(old["name"], new["name"])
    if old["section"] == "record":
        if agreement:
            bars, hits, told = agreement
            if hits < 0.75 * bars or (hits < bars and bars < 4):
                return -1.0
            strangers = not linked and not concepts(old["name"]) & concepts(new["name"])
            # flags agree by chance: they need kindred names or many bars
            return told + 3 * similar - (3.0 if strangers and told < 4 else 1.5)
        if old["type"] != new["type"] and old["type"] and new["type"]:
            return 4 * similar - 3.2
        near = 0.0
        if old["mean"] is not None and new["mean"] is not None:
            spread = (old["spread"] or 0.0) + (new["spread"] or 0.0) + 1e-3 * abs(old["mean"]) + 1e-9
            near = 1.0 if abs(old["mean"] - new["mean"]) <= 3 * spread else -1.0
        return 4 * similar + near + 2 * resemblance(old["sketch"], new["sketch"]) - 2.5
    a, b = old["text"], new["text"]
    if a is None or b is None:
        return 4 * similar - 1.9
    hex_a, hex_b = bool(HEX.match(a)) and old["type"] == "text", bool(HEX.match(b)) and new["type"] == "text"
    if hex_a or hex_b:
        return 2.0 + 2 * similar if hex_a and hex_b and len(a) == len(b) else -1.0
    if old["mean"] is None or new["mean"] is None:
        return 4 * similar + (1.0 if a == b else 0.0) - 1.9
    counts = [abs(x["mean"] - x["records"]) <= max(2.0, 0.34 * x["records"]) for x in (old, new)]
    versions = 0 <= new["mean"] - old["mean"] <= 3 and new["mean"] < 1000
    kin = 1.2 if all(counts) else 1.2 if versions and not any(counts) else 0.4 if versions or any(counts) else -0.5
    return kin + 3 * similar - 1.1


def _loads(text: str | None) -> dict:
    """The top-level fields of a JSON text; none if it cannot be read or is no object."""
    try:
        v = json.loads(text) if text else None
    except ValueError:
        return {}
    return v if isinstance(v, dict) else {}


def _number(v) -> float | None:
    """The number a value is or spells; true and false count as 1 and 0."""
    if isinstance(v, str):
        if "_" in v:
            return None
        try:
            v = float(v)
        except ValueError:
            return None
    elif isinstance(v, (dict, list)):
        return None
    return float(v) if -1e15 < v < 1e15 else None


def _said(v) -> str:
    """What a value says, however it is typed: 1.50, "1.5" and "1.5 " say the same."""
    n = _number(v)
    if n is not None:
        return repr(round(n, 6) + 0.0)
    return v.strip().lower() if isinstance(v, str) else json.dumps(v, sort_keys=True)


_KINDS = ["text", "number", "boolean", "nested"]
_PARTIAL = "dr_file long, dr_name string, dr_section string, t long, n long, b long, x long, dr_seen long, dr_count long, dr_sum double, dr_square double, dr_text string, dr_sketch array<int>"


def _kind(v) -> int:
    return 2 if isinstance(v, bool) else 0 if isinstance(v, str) else 1 if isinstance(v, (int, float)) else 3


def _profiler(section: str):
    """Rows of (dr_file, dr_json) to partial profiles per file and field of a batch."""
    names, spelled = [c.split()[0] for c in _PARTIAL.split(", ")], section == "manifest"

    def run(batches):
        for batch in batches:
            made: dict[tuple[int, str], list] = {}
            for file, text in zip(batch.column("dr_file").to_pylist(), batch.column("dr_json").to_pylist()):
                for name, v in _loads(text).items():
                    p = made.get((file, name))
                    if p is None:
                        p = made[file, name] = [0, 0, 0, 0, 0, 0, 0.0, 0.0, None, set()]
                    p[4] += 1
                    if v is None:
                        continue
                    p[_kind(v)] += 1
                    n = _number(v)
                    if n is not None:
                        p[5] += 1
                        p[6] += n
                        p[7] += n * n
                        p[9].add(hash(round(n, 6)) & 0x7FFFFFFF)
                    else:
                        p[9].add(zlib.crc32(_said(v).encode("utf-8", "replace")) & 0x7FFFFFFF)
                    # only single values, as manifests have them, are compared as texts
                    if spelled:
                        said = _said(v)
                        p[8] = said if p[8] is None or said < p[8] else p[8]
            if made:
                cols = list(zip(*made.values()))
                arrays = [pa.array([k[0] for k in made], pa.int64()), pa.array([k[1] for k in made], pa.string()), pa.array([section] * len(made)), *[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.float64()), pa.array(cols[7], pa.float64()), pa.array(cols[8], pa.string()), pa.array([sorted(c)[:SKETCH] for c in cols[9]], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _hash(manifest):
    """The longest text of at least 12 hexadecimal digits among the values of a map."""
    found = F.filter(F.map_values(manifest), lambda v: v.rlike("^[0-9a-f]{12,64}$"))
    return F.array_max(F.transform(found, lambda h: F.struct(F.length(h).alias("n"), h.alias("h"))))["h"]


def ordered_files(files: DataFrame, block: int = 4096) -> DataFrame:
    """(dr_contract, dr_file, dr_seq, dr_prev): files whose hash is new to their contract, each with the one before it.

    A hash is the longest text of at least 12 hexadecimal digits among a manifest's top-level values; without one a file counts as new.
    Neighbours are found per block of file_seq, with the last file of earlier blocks carried in, so a contract may have any number of files.
    """
    col = F.col
    base = files.where(col("file_id").isNotNull() & col("contract").isNotNull() & col("file_seq").isNotNull())
    base = base.select(col("contract").alias("dr_contract"), col("file_id").cast("bigint").alias("dr_file"), col("file_seq").cast("bigint").alias("dr_seq"), F.from_json("manifest", "map<string,string>").alias("dr_m"))
    base = base.select("dr_contract", "dr_file", "dr_seq", _hash(col("dr_m")).alias("dr_hash"))
    base = base.groupBy("dr_contract", "dr_file").agg(F.min("dr_seq").alias("dr_seq"), F.min("dr_hash").alias("dr_hash"))
    known = base.where(col("dr_hash").isNotNull()).groupBy("dr_contract", "dr_hash").agg(F.min(F.struct("dr_seq", "dr_file")).alias("x")).select("dr_contract", "x.dr_file", "x.dr_seq")
    kept = base.where(col("dr_hash").isNull()).select("dr_contract", "dr_file", "dr_seq").unionByName(known)
    kept = kept.withColumn("dr_block", F.floor(col("dr_seq") / block))
    at = F.struct("dr_seq", "dr_file")
    carry = kept.groupBy("dr_contract", "dr_block").agg(F.max(at).alias("x"))
    carry = carry.withColumn("x", F.max("x").over(Window.partitionBy("dr_contract").orderBy("dr_block").rowsBetween(Window.unboundedPreceding, -1))).where("x is not null").select("dr_contract", "dr_block", "x.dr_seq", "x.dr_file", F.lit(0).alias("dr_own"))
    both = kept.select("dr_contract", "dr_block", "dr_seq", "dr_file", F.lit(1).alias("dr_own")).unionByName(carry)
    w = Window.partitionBy("dr_contract", "dr_block").orderBy("dr_seq", "dr_file")
    return both.withColumn("dr_prev", F.lag("dr_file").over(w)).where("dr_own = 1").select("dr_contract", "dr_file", "dr_seq", "dr_prev")


def profiles(files: DataFrame, records: DataFrame) -> DataFrame:
    """Per (file, field): its section, type (that of most of its non-null values), counts, moments and sketch."""
    col = F.col
    of = lambda d, text, section: d.select(col("file_id").cast("bigint").alias("dr_file"), col(text).alias("dr_json")).where("dr_file is not null").mapInArrow(_profiler(section), _PARTIAL)
    both = of(files, "manifest", "manifest").unionByName(of(records, "payload", "record"))
    p = both.groupBy("dr_file", "dr_name").agg(
        *[F.sum(c).alias(c) for c in ("t", "n", "b", "x", "dr_seen", "dr_count", "dr_sum", "dr_square")], F.min("dr_section").alias("dr_section"), F.min("dr_text").alias("dr_text"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("dr_sketch")))), 1, SKETCH).alias("dr_sketch"),
    )
    most = F.greatest("t", "n", "b", "x")
    kind = F.when(most > 0, F.when(col("n") == most, "number").when(col("t") == most, "text").when(col("b") == most, "boolean").otherwise("nested"))
    mean = F.when(col("dr_count") > 0, col("dr_sum") / col("dr_count"))
    spread = F.when(col("dr_count") > 0, F.sqrt(F.greatest(F.lit(0.0), col("dr_square") / col("dr_count") - mean * mean)))
    return p.select("dr_file", "dr_name", "dr_section", kind.alias("dr_type"), "dr_seen", mean.alias("dr_mean"), spread.alias("dr_spread"), "dr_text", "dr_sketch")


_SAID = "dr_pair long, dr_block long, dr_bar long, dr_role int, dr_name string, dr_said string"


def _extract(batches):
    """Records with the (pair, role, name) their file is asked for to what those fields say on their bar."""
    names = [c.split()[0] for c in _SAID.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for bar, text, asked in zip(*(batch.column(c).to_pylist() for c in ("dr_bar", "dr_json", "dr_asked"))):
            fields = _loads(text)
            for a in asked:
                v = fields.get(a["dr_name"])
                if v is not None:
                    out.append((a["dr_pair"], bar // BAR_BLOCK, bar, a["dr_role"], a["dr_name"], _said(v)))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4]), pa.array(cols[5])], names=names)


def _agreements(group: pa.Table) -> pa.RecordBatch | None:
    """Of one pair of files and one block of bars: shared bars, agreements and what these tell, for each vanished with each new field."""
    bars: dict[int, tuple[dict, dict]] = {}
    for bar, role, name, said in zip(*(group[c].to_pylist() for c in ("dr_bar", "dr_role", "dr_name", "dr_said"))):
        side = bars.setdefault(bar, ({}, {}))[role]
        if name not in side or said < side[name]:
            side[name] = said
    seen, total = Counter(), Counter()
    for _, news in bars.values():
        for name, said in news.items():
            seen[name, said] += 1
            total[name] += 1
    found: dict[tuple[str, str], list] = {}
    for olds, news in bars.values():
        for old, before in olds.items():
            for new, said in news.items():
                f = found.setdefault((old, new), [0, 0, 0.0])
                f[0] += 1
                if before == said:
                    f[1] += 1
                    f[2] += min(3.0, float(-np.log(seen[new, said] / total[new])))
    if not found:
        return None
    cols = list(zip(*found.values()))
    return pa.RecordBatch.from_arrays([pa.array([group["dr_pair"][0].as_py()] * len(found), pa.int64()), pa.array([k[0] for k in found]), pa.array([k[1] for k in found]), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["dr_pair", "dr_old", "dr_new", "bars", "hits", "told"])


def _matcher(known: frozenset):
    return lambda group: _match(group, known)


def _match(group: pa.Table, known: frozenset) -> pa.RecordBatch | None:
    """Renames of one file: rows are its vanished and new fields (part 0) and agreements on shared bars (part 1)."""
    rows = group.to_pylist()
    fields: dict[int, list[dict]] = {0: [], 1: []}
    agree: dict[tuple[str, str], tuple[int, float, float]] = {}
    for r in rows:
        if r["part"] == 0:
            fields[r["role"]].append({"name": r["name"], "section": r["section"], "type": r["type"], "mean": r["mean"], "spread": r["spread"], "text": r["text"], "sketch": r["sketch"], "records": r["records"] or 0})
        else:
            agree[r["name"], r["other"]] = (r["role"], r["mean"], r["spread"])
    olds, news = fields[0], fields[1]
    if not olds or not news:
        return None
    weight = np.array([[pair_weight(o, n, agree.get((o["name"], n["name"])), known) for n in news] for o in olds])
    found = assign(weight)
    if not found:
        return None
    return pa.RecordBatch.from_pydict({"dr_file": [rows[0]["dr_file"]] * len(found), "dr_old": [olds[i]["name"] for i, _ in found], "dr_new": [news[j]["name"] for _, j in found]}, schema=pa.schema([("dr_file", pa.int64()), ("dr_old", pa.string()), ("dr_new", pa.string())]))


def _links(renames: DataFrame) -> frozenset:
    """Pairs of names, either way round, that at least LEAST_LINKS renames join; as many as the names allow, which is checked."""
    a, b = F.least("dr_old", "dr_new").alias("a"), F.greatest("dr_old", "dr_new").alias("b")
    rows = renames.groupBy(a, b).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_LINKS).limit(10 * MOST_NAMES + 1).collect()
    if len(rows) > 10 * MOST_NAMES:
        raise ValueError("too many pairs of field names")
    return frozenset(p for r in rows for p in ((r["a"], r["b"]), (r["b"], r["a"])))


def schema_changes(files: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The changes (file_id, field_name, change, old_name, old_type, new_type), the ordered files they were found in, and all profiles.

    A file is compared with the file of its contract before it by file_seq, both after leaving out files whose hash came
    before. First files give no change. A JSON text that cannot be parsed has no fields; a field with nulls only has no type and
    is never retyped. Repeated records count as often as they come; a file without records is judged by its manifest.
    Columns other than contract, file_id, file_seq, manifest, bar_no and payload are ignored. Empty tables give an empty result.
    """
    col = F.col
    order = durable(ordered_files(files))
    prof = durable(profiles(files, records))
    cur = prof.join(order.where("dr_prev is not null").select("dr_file").hint("merge"), "dr_file").withColumn("dr_pair", col("dr_file")).withColumn("dr_role", F.lit(1))
    old = prof.join(order.where("dr_prev is not null").select(col("dr_file").alias("dr_pair"), col("dr_prev").alias("dr_file")).hint("merge"), "dr_file").withColumn("dr_role", F.lit(0))
    both = cur.unionByName(old)
    names = ["dr_section", "dr_type", "dr_mean", "dr_spread", "dr_text", "dr_sketch", "dr_file"]
    side = lambda r: F.max(F.when(col("dr_role") == r, F.struct(*names)))
    fields = both.groupBy("dr_pair", "dr_name").agg(side(0).alias("o"), side(1).alias("c"))
    retyped = fields.where(col("o.dr_type") != col("c.dr_type")).select("dr_pair", "dr_name", F.lit("retyped").alias("change"), F.lit(None).cast("string").alias("old_name"), col("o.dr_type").alias("old_type"), col("c.dr_type").alias("new_type"))
    moved = fields.where(col("o").isNull() | col("c").isNull()).select("dr_pair", "dr_name", col("c").isNotNull().cast("int").alias("dr_role"), F.coalesce("c", "o").alias("f")).select("dr_pair", "dr_name", "dr_role", "f.*")
    # values of vanished and new fields on the bars of both files; the sides grow with the records, so they are sorted and merged
    told = moved.where("dr_section = 'record'").groupBy("dr_file").agg(F.collect_list(F.struct("dr_pair", "dr_role", "dr_name")).alias("dr_asked"))
    rec = records.where(col("bar_no").isNotNull() & col("file_id").isNotNull()).select(col("file_id").cast("bigint").alias("dr_file"), col("bar_no").cast("bigint").alias("dr_bar"), col("payload").alias("dr_json"))
    said = rec.join(told.hint("merge"), "dr_file").select("dr_bar", "dr_json", "dr_asked").mapInArrow(_extract, _SAID)
    agree = map_sorted_groups(said, ["dr_pair", "dr_block"], ["dr_bar"], _agreements, "dr_pair long, dr_old string, dr_new string, bars long, hits long, told double")
    agree = agree.groupBy("dr_pair", "dr_old", "dr_new").agg(F.sum("bars").cast("int").alias("role"), F.sum("hits").cast("double").alias("mean"), F.sum("told").alias("spread"))
    agree = agree.select(col("dr_pair").alias("dr_file"), F.lit(1).alias("part"), "role", col("dr_old").alias("name"), col("dr_new").alias("other"), "mean", "spread")
    counts = prof.where("dr_section = 'record'").groupBy("dr_file").agg(F.max("dr_seen").cast("double").alias("records"))
    asked = moved.join(counts.hint("merge"), "dr_file", "left").select(col("dr_pair").alias("dr_file"), F.lit(0).alias("part"), col("dr_role").alias("role"), col("dr_name").alias("name"), col("dr_section").alias("section"), col("dr_type").alias("type"), col("dr_mean").alias("mean"), col("dr_spread").alias("spread"), col("dr_text").alias("text"), col("dr_sketch").alias("sketch"), "records")
    evidence = durable(asked.unionByName(agree, allowMissingColumns=True))
    match = lambda known: map_sorted_groups(evidence, ["dr_file"], ["part", "role", "name"], _matcher(known), "dr_file long, dr_old string, dr_new string")
    renames = match(_links(match(frozenset())))
    shapes = moved.select("dr_pair", "dr_name", "dr_role", "dr_type").join(
        renames.select(col("dr_file").alias("dr_pair"), F.explode(F.array(F.struct(F.lit(0).alias("r"), col("dr_old").alias("n"), col("dr_new").alias("m")), F.struct(F.lit(1).alias("r"), col("dr_new").alias("n"), col("dr_old").alias("m")))).alias("x")).select("dr_pair", col("x.r").alias("dr_role"), col("x.n").alias("dr_name"), col("x.m").alias("old_name")),
        ["dr_pair", "dr_role", "dr_name"], "left",
    )
    shapes = shapes.where("old_name is null or dr_role = 1")
    change = F.when(col("old_name").isNotNull(), "renamed").when(col("dr_role") == 1, "added").otherwise("removed")
    none = F.lit(None).cast("string")
    shapes = shapes.select("dr_pair", "dr_name", change.alias("change"), "old_name", F.when(col("dr_role") == 0, col("dr_type")).otherwise(none).alias("old_type"), F.when(col("dr_role") == 1, col("dr_type")).otherwise(none).alias("new_type"))
    out = retyped.unionByName(shapes).select(col("dr_pair").alias("file_id"), col("dr_name").alias("field_name"), "change", "old_name", "old_type", "new_type")
    return out, order, prof


def p2_found(spark, folder: str) -> DataFrame:
    """Every change of a field against the contract's preceding file."""
    changes, _, _ = schema_changes(table(spark, folder, "raw_files"), table(spark, folder, "raw_records"))
    return changes.select("file_id", "field_name", "change")


def _roots(group: pa.Table) -> pa.RecordBatch | None:
    """The renames of one contract in order of file_seq to spells (name, first_seq, last_seq, root)."""
    live: dict[str, tuple[str, int | None]] = {}
    out: list[tuple[str, int | None, int | None, str]] = []
    seqs, olds, news = (group[c].to_pylist() for c in ("dr_seq", "dr_old", "dr_new"))
    i = 0
    while i < len(seqs):
        j = i
        while j < len(seqs) and seqs[j] == seqs[i]:
            j += 1
        # all renames of a file happen at once, so names may change places
        roots = [(new, live.get(old, (old, None))[0], old) for old, new in zip(olds[i:j], news[i:j])]
        for _, _, old in roots:
            if old in live:
                root, since = live.pop(old)
                out.append((old, since, seqs[i] - 1, root))
        for new, root, _ in roots:
            live[new] = (root, seqs[i])
        i = j
    out += [(name, since, None, root) for name, (root, since) in live.items()]
    c = group["dr_contract"][0].as_py()
    cols = list(zip(*out)) if out else [[], [], [], []]
    return pa.RecordBatch.from_pydict({"dr_contract": [c] * len(out), "dr_name": cols[0], "dr_since": cols[1], "dr_until": cols[2], "dr_root": cols[3]}, schema=pa.schema([("dr_contract", pa.string()), ("dr_name", pa.string()), ("dr_since", pa.int64()), ("dr_until", pa.int64()), ("dr_root", pa.string())]))


def clusters(names: dict[str, int], links: list[tuple[str, str, int]], together: set[tuple[str, str]]) -> dict[str, str]:
    """Each name's column: the most frequent name of its cluster.

    ``names``: files that hold each; ``links``: pairs that carried on one another and how often; ``together``: pairs some file holds at once,
    which are two columns. The most frequent links are followed first, as long as no two names of a cluster were held together.
    """
    of = {n: {n} for n in names}
    for a, b, _ in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        x, y = of[a], of[b]
        if x is y or any((min(p, q), max(p, q)) in together for p in x for q in y):
            continue
        x |= y
        for n in y:
            of[n] = x
    return {n: max(c, key=lambda m: (names[m], m)) for n, c in of.items()}


def _columns(changes: DataFrame, prof: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """name -> column over all contracts, and the columns that at least half of the files have, with their types.

    Only distinct names, their links and their pairs in files reach the driver, of which there are as many as drift has made; checked.
    """
    fields = prof.where("dr_section = 'record'").select("dr_file", "dr_name", "dr_type")
    count = fields.groupBy("dr_name").agg(F.count("*").alias("n"), *[F.count_if(F.col("dr_type") == k).alias(k) for k in _KINDS]).limit(MOST_NAMES + 1).collect()
    if len(count) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} field names")
    names = {r["dr_name"]: r["n"] for r in count}
    links = [(r["a"], r["b"], r["n"]) for r in changes.where("change = 'renamed'").groupBy(F.col("old_name").alias("a"), F.col("field_name").alias("b")).agg(F.count("*").alias("n")).collect() if r["a"] in names and r["b"] in names]
    sets = fields.groupBy("dr_file").agg(F.array_sort(F.collect_set("dr_name")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    pairs = sets.select(F.col("n"), F.explode("s").alias("a"), "s").select("n", "a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    column = clusters(names, links, {(r["a"], r["b"]) for r in pairs})
    files = fields.select("dr_file").distinct().count()
    held, kinds = Counter(), {}
    for r in count:
        c = column[r["dr_name"]]
        held[c] += r["n"]
        kinds.setdefault(c, Counter()).update({k: r[k] for k in _KINDS})
    kind = {"number": "double", "boolean": "boolean", "text": "string", "nested": "string"}
    # most fields are numbers that some files spell as text
    types = {c: "double" if k["number"] > 0 and k["number"] >= 0.2 * k["text"] else kind[k.most_common(1)[0][0]] for c, k in kinds.items()}
    return column, {c: types[c] for c in sorted(held) if 2 * held[c] >= files}


def _typed(v, kind: str):
    if v is None:
        return None
    if kind == "double":
        return _number(v)
    if kind == "boolean":
        n = _number(v)
        return n != 0 if n is not None else {"true": True, "false": False}.get(v.strip().lower()) if isinstance(v, str) else None
    return v if isinstance(v, str) else json.dumps(v)


def _unifier(column: dict[str, str], main: dict[str, str]):
    """Records with their file's names of earlier days (dr_roots) to the unified columns; what has no such column goes to ``other``."""
    arrow = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches):
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in main}
            other = []
            for text, roots in zip(batch.column("dr_json").to_pylist(), batch.column("dr_roots").to_pylist()):
                roots = dict(roots or [])
                row, rest = {}, {}
                # a name that carries on another has the other's column; of two fields for one column the one so named has it
                fields = [(name, roots.get(name, name), v) for name, v in _loads(text).items()]
                for name, root, v in sorted(fields, key=lambda f: (f[1] != column.get(f[1]), f[0])):
                    c = column.get(root, root)
                    if c in main and c not in row:
                        row[c] = _typed(v, main[c])
                    elif v is not None:
                        rest[root] = v if isinstance(v, str) else json.dumps(v)
                for c in main:
                    cols[c].append(row.get(c))
                other.append(sorted(rest.items()))
            keep = [batch.column(c) for c in ("record_id", "file_id", "contract", "bar_no")]
            yield pa.RecordBatch.from_arrays([*keep, *[pa.array(cols[c], arrow[k]) for c, k in main.items()], pa.array(other, pa.map_(pa.string(), pa.string()))], names=["record_id", "file_id", "contract", "bar_no", *main, "other"])

    return run


def unified_records(files: DataFrame, records: DataFrame) -> DataFrame:
    """One row per record id in one schema: record_id, file_id, contract, bar_no, the unified columns, and ``other``.

    A field is followed back through its contract's renames to its first name; names are clustered over all contracts by the renames that
    link them, and a cluster that at least half of the files have is a column, under its most frequent name. ``other`` maps the
    first names of further fields to their values as text. A repeated record id counts once. Texts that are no number are
    null in number columns; 0 and 1 are false and true. Files delivered again are read with the names of their first delivery.
    """
    col = F.col
    changes, order, prof = schema_changes(files, records)
    changes = durable(changes)
    column, main = _columns(changes, prof)
    ren = changes.where("change = 'renamed'").select(col("file_id").alias("dr_file"), col("old_name").alias("dr_old"), col("field_name").alias("dr_new")).join(order.select("dr_contract", "dr_file", "dr_seq"), "dr_file")
    spells = map_sorted_groups(ren, ["dr_contract"], ["dr_seq", "dr_new"], _roots, "dr_contract string, dr_name string, dr_since long, dr_until long, dr_root string")
    base = files.select(col("contract").alias("dr_contract"), col("file_id").cast("bigint").alias("dr_file"), col("file_seq").cast("bigint").alias("dr_seq"), _hash(F.from_json("manifest", "map<string,string>")).alias("dr_hash")).where("dr_file is not null")
    # a file delivered again has the names of its first delivery
    first = base.where("dr_hash is not null").groupBy("dr_contract", "dr_hash").agg(F.min("dr_seq").alias("dr_first"))
    at = base.join(first.hint("merge"), ["dr_contract", "dr_hash"], "left").groupBy("dr_file").agg(F.min("dr_contract").alias("dr_contract"), F.min(F.coalesce("dr_first", "dr_seq")).alias("dr_at"))
    named = prof.where("dr_section = 'record'").select("dr_file", "dr_name").join(at.hint("merge"), "dr_file").join(spells.hint("merge"), ["dr_contract", "dr_name"])
    named = named.where("coalesce(dr_since <= dr_at, true) and coalesce(dr_until >= dr_at, true)").groupBy("dr_file").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("dr_name", "dr_root")))).alias("dr_roots"))
    rec = records.where("record_id is not null").select(col("record_id").cast("bigint").alias("record_id"), col("file_id").cast("bigint").alias("file_id"), col("contract").cast("string").alias("contract"), col("bar_no").cast("bigint").alias("bar_no"), col("payload").alias("dr_json"))
    rec = rec.join(named.withColumnRenamed("dr_file", "file_id").hint("merge"), "file_id", "left")
    schema = ", ".join(["record_id long, file_id long, contract string, bar_no long", *[f"`{c}` {k}" for c, k in main.items()], "other map<string,string>"])
    out = rec.mapInArrow(_unifier(column, main), schema)
    rest = [c for c in out.columns if c not in ("record_id", "other")]
    one = out.withColumn("other", F.array_sort(F.map_entries("other"))).groupBy("record_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest], "other")).alias("x"))
    return one.select("record_id", *[F.col("x").getField(c).alias(c) for c in rest], F.map_from_entries("x.other").alias("other"))


def p2_records(spark, folder: str) -> DataFrame:
    """All records in one schema."""
    return unified_records(table(spark, folder, "raw_files"), table(spark, folder, "raw_records"))
