import numpy as np
from pyspark.sql import functions as F

from tickloom.llm.prose import Model, prose_outliers
from tickloom.llm.textstats import STATISTICS, Alphabet, CommonWords, measure

DOCS = "doc_id long, lang string, text string"
COMMON = {"en": frozenset("the of and to in a is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may".split())}
NOUNS = "harbour lantern engine paper window market village teacher river garden orchard station journey kitchen ticket winter".split()


def prose(rng, n=12):
    out = []
    for _ in range(n):
        a, b, c = rng.choice(NOUNS, 3)
        out.append(str(rng.choice([f"The {a} was seen by the {b} and it was not far from the {c}.", f"They said that the {a} had been made for the {b}, but the {c} is old.", f"When the {a} was new we could see how the {b} would open the {c}!", f"I have been in the {a} {rng.integers(2, 99)} times with all of the {b}."])))
    return " ".join(out[: n // 2]) + "\n\n" + " ".join(out[n // 2 :])


def bullets(rng, n=30):
    return "\n".join("- " + " ".join(rng.choice(NOUNS, rng.integers(1, 4))) for _ in range(n))


def cells(rng, n=20):
    return "\n".join(" | ".join([str(rng.choice(NOUNS)), str(rng.integers(1, 9999)), f"{rng.random() * 100:.1f}%"]) for _ in range(n))


def junk(rng):
    kind = rng.integers(4)
    if kind == 0:
        return f"{rng.choice(NOUNS)} now! " * int(rng.integers(40, 200))
    if kind == 1:
        return "".join(f"var a{rng.integers(99)}=1;function b(c_){{return d.e(c_)||{rng.integers(9)}}}" for _ in range(20))
    if kind == 2:
        return "".join(rng.choice(list("abcdefABCDEF0123456789+/"), 600))
    return "".join(rng.choice(list("#$%^~@�`"), 600))


def corpus(spark, extra=()):
    """Prose and, from 1000, 2000 and 3000 on, lists, tables and junk, of which those with an even number are labelled."""
    rng = np.random.default_rng(5)
    rows = [(i, "en", prose(rng, int(rng.integers(8, 40)))) for i in range(400)]
    for i in range(50):
        rows += [(1000 + i, "en", bullets(rng)), (2000 + i, "en-US", cells(rng)), (3000 + i, "en", junk(rng))]
    labels = [(i, {1: "list", 2: "table", 3: "junk"}.get(i // 1000, "prose"), "r") for i, _, _ in rows if i % 2 == 0]
    return spark.createDataFrame([*rows, *extra], DOCS), spark.createDataFrame([("en", w) for w in COMMON["en"]], "lang string, word string"), spark.createDataFrame(labels, "doc_id long, form string, rater string")


def test_forms(spark):
    docs, common, labels = corpus(spark)
    wrong = spark.createDataFrame([(2, "junk", "x"), (1000, "table", "x"), (None, "list", "x"), (4, None, "x"), (6, "poem", "x"), (99999, "list", "x")], labels.schema)
    out = {r["doc_id"]: r for r in prose_outliers(docs, common, labels.unionAll(wrong)).collect()}
    assert len(out) == 550
    assert sum(out[i]["form"] == "prose" for i in range(400)) >= 398
    for k, form in ((1000, "list"), (2000, "table"), (3000, "junk")):
        assert all(out[k + i]["outlier"] for i in range(50))
        assert sum(out[k + i]["form"] == form for i in range(1, 50, 2)) >= 24
    for r in out.values():
        assert len(r["contributions"]) == len(STATISTICS) and abs(sum(r["contributions"]) - r["distance"] ** 2) < 1e-6 * max(1, r["distance"] ** 2)
        assert r["outlier"] or r["form"] == "prose"


def test_the_distance_decides(spark, monkeypatch):
    docs, common, labels = corpus(spark)
    before = {r["doc_id"]: r["form"] for r in prose_outliers(docs, common, labels).collect()}
    monkeypatch.setattr(Model, "contributions", lambda self, x, lang: ((d := x - np.array([self.centres[g] for g in lang])) ** 2, d))
    after = {r["doc_id"]: r["form"] for r in prose_outliers(docs, common, labels).collect()}
    assert before != after


def test_without_labels_the_largest_group_of_contributions_speaks(spark):
    docs, common, labels = corpus(spark)
    out = {r["doc_id"]: r for r in prose_outliers(docs, common).collect()}
    assert sum(out[i]["form"] == "prose" for i in range(400)) >= 395 and sum(out[2000 + i]["form"] == "table" for i in range(50)) >= 45
    assert all(out[k + i]["form"] != "prose" for k in (1000, 2000, 3000) for i in range(50))


def test_edges(spark):
    rng = np.random.default_rng(7)
    long = " ".join(prose(rng, 40) for _ in range(600))
    extra = [(5000, None, None), (5001, "en", ""), (5002, "en", " \n\t \u3000"), (None, "en", "lost"), (5003, None, prose(rng)), (5004, "zz", prose(rng)), (5005, "en", long), (5006, "en", "x"), (5006, "en", "x"), (5007, "ru", "Сад был старый. " * 20), (5008, "ja", "この庭からその港まで市場を見ました。" * 12), (5009, "en", "\U0001f600" * 30 + "\x00")]
    docs, common, labels = corpus(spark, extra)
    docs = docs.withColumn("v", F.lit(1)).withColumn("form", F.lit("q"))
    rows = prose_outliers(docs, common, labels).collect()
    ids = [r["doc_id"] for r in rows]
    assert not {5000, 5001, 5002, None} & set(ids) and ids.count(5006) == 2 and 5009 in ids
    got = {r["doc_id"]: r for r in rows}
    assert got[5003]["form"] == got[5004]["form"] == "prose" and got[5003]["language"] == got[5004]["language"] == "en" and got[5005]["n_words"] > 100_000
    assert prose_outliers(docs.limit(0), common, labels).count() == 0
    assert prose_outliers(docs, common.limit(0), labels.limit(0)).count() == len(rows)


def one(text, tag="en", common=COMMON):
    lang, n, v = measure([text], [tag], CommonWords(common), Alphabet())
    return lang[0], int(n[0]), dict(zip(STATISTICS, v[0]))


def test_statistics_by_hand():
    lang, n, s = one("The cat is here.\nIt was 12 of them")
    assert (lang, n) == ("en", 8)
    assert abs(s["mean_word_length"] - 23 / 8) < 1e-9 and s["punctuated_lines"] == 0.5
    assert abs(s["common_words"] - 6 / 8) < 1e-9 and abs(s["digit_ratio"] - 2 / 26) < 1e-9 and s["symbol_ratio"] == 0
    assert abs(s["capital_words"] - 2 / 8) < 1e-9 and abs(s["log_words_per_sentence"] - np.log1p(8 / 2)) < 1e-9
    assert abs(s["punctuated_text"] - 16 / 33) < 1e-9 and abs(s["vowel_ratio"] - 9 / 23) < 1e-9


def test_lines_and_columns():
    assert one("a,1,2\nb,3,4\nc,5,6")[2]["column_agreement"] == 1 and one("a  1\nb  2\nc")[2]["column_agreement"] > 0.8
    assert one("one, two\nthree, four")[2]["column_agreement"] == 0
    assert one("- a\n- b\nword")[2]["marked_starts"] == 0.6
    assert abs(one("buy now " * 20)[2]["repetition"] - 1) < 1e-9
    assert one("don't stop")[1] == 2 and one("el café")[1] == 2


def test_many_texts_are_measured_as_one_by_one():
    rng = np.random.default_rng(3)
    texts = [prose(rng), bullets(rng), cells(rng), "x", "\n\n y \n", junk(rng), "日本語のテキスト。", "a\x00b"] * 3
    whole = measure(texts, ["en"] * len(texts), CommonWords(COMMON), Alphabet())[2]
    for i, t in enumerate(texts[:8]):
        assert np.allclose(whole[i], list(one(t)[2].values())) and np.allclose(whole[i + 8], whole[i])
