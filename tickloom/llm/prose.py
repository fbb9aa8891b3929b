"""Per-document text statistics and how far they stand from the prose of the document's language.

Statistics are taken over whole texts in Arrow batches (``textstats``). Centre and covariance of all of them are
estimated per language from the corpus itself, robustly: a first centre and scale from medians, then sums over the documents
near them, twice over. Each document's Mahalanobis distance and every statistic's contribution to it are reported. Documents
beyond the threshold are outliers from prose, and only they can have a form. Which one is read off the contributions: each
form, odd prose among them, has a centre and covariance of signed log contributions, fitted on a bounded sample of hand
labels, and an outlier has the form it is nearest to. With few labels the largest group of contributions speaks instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.textstats import STATISTICS, Alphabet, CommonWords, measure
from tickloom.runtime import durable, table

K = len(STATISTICS)
#: Squared distance beyond which a document is no ordinary prose: the 0.999 quantile of chi-square with 17 degrees of freedom.
OUTLIER = 40.79
#: Least variance of each statistic, so that shares that are zero in all prose still have a scale.
FLOORS = dict(zip(STATISTICS, [0.05, 0.05, 0.05, 1e-4, 1e-4, 1e-3, 4e-3, 1e-3, 4e-4, 4e-3, 4e-3, 0.05, 0.05, 4e-3, 2.5e-3, 2.5e-3, 2.5e-3]))
#: Common words accepted from the table at most; it has a few hundred.
MOST_COMMON_WORDS = 100_000
#: Labelled documents the forms are fitted on at most (those with the least hash), and labelled outliers they need at least.
MOST_LABELS, LEAST_LABELS = 20_000, 40
FORMS = ["prose", "list", "table", "junk"]
#: Where labels are too few: the statistics whose contributions, added up, speak for a form.
SPEAKS = {
    "list": ["punctuated_lines", "punctuated_text", "log_line_length", "log_words_per_sentence", "capital_words", "marked_starts"],
    "table": ["separators_per_word", "column_agreement", "digit_ratio", "digit_ends"],
    "junk": ["symbol_ratio", "repetition", "mean_word_length", "word_length_spread", "vowel_ratio", "common_words"],
}
_ROW = "doc_id long, language string, n_words long, v array<double>"


def _measure(common: dict[str, frozenset]):
    def run(batches):
        words, alphabet = CommonWords(common), Alphabet()
        for batch in batches:
            if batch.num_rows:
                language, n, v = measure(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), words, alphabet)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(language, pa.string()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * K, pa.array(v.ravel()))], names=["doc_id", "language", "n_words", "v"])

    return run


def measured(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, language, n_words, v): the statistics of whole texts with a character other than blanks."""
    rows = common_words.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError("the table of common words is too large to hand to every task")
    common: dict[str, set] = {}
    for r in rows:
        common.setdefault(r["lang"], set()).add(r["word"])
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\p{Z}\p{C}]"))
    return docs.mapInArrow(_measure({k: frozenset(v) for k, v in common.items()}), _ROW)


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    v = batch.column("v")
    return np.asarray(v.flatten()).reshape(len(v), K), np.array(batch.column("language").to_pylist(), dtype=object)


class Model:
    """Centre and inverse covariance of prose per language."""

    def __init__(self, centres: dict[str, np.ndarray], inverses: dict[str, np.ndarray]):
        self.centres, self.inverses = centres, inverses

    def contributions(self, x: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each statistic adds to the squared distance, and its deviation from the centre."""
        c, d = np.zeros_like(x), np.zeros_like(x)
        for g in set(lang):
            at = lang == g
            d[at] = x[at] - self.centres[g]
            c[at] = d[at] * (d[at] @ self.inverses[g])
        return c, d


def profile(contributions: np.ndarray, deviations: np.ndarray) -> np.ndarray:
    """Logs of contributions, with the sign of the deviation: too many digits and too few are different things."""
    return np.sign(deviations) * np.log1p(np.abs(contributions))


def _sums(vectors: DataFrame, near) -> dict[str, np.ndarray]:
    """Per language: number, sums and products of the vectors that ``near`` accepts, added up per batch before they move."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, lang = _vectors(batch)
            ok = near(x, lang)
            for g in set(lang[ok]):
                y = x[ok & (lang == g)]
                total[g] = total.get(g, 0.0) + np.r_[len(y), y.sum(axis=0), (y.T @ y).ravel()]
        if total:
            yield pa.RecordBatch.from_pydict({"language": list(total), "s": [t.tolist() for t in total.values()]}, schema=pa.schema([("language", pa.string()), ("s", pa.list_(pa.float64()))]))

    parts = vectors.mapInArrow(run, "language string, s array<double>")
    # arrays are added place by place: one long row per language instead of hundreds of aggregates
    places = parts.select("language", F.posexplode("s").alias("at", "x")).groupBy("language", "at").agg(F.sum("x").alias("x"))
    rows = places.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("s")).collect()
    return {r["language"]: np.array([e["x"] for e in r["s"]]) for r in rows}


def _fitted(sums: dict[str, np.ndarray], languages: list[str], widen: float) -> Model:
    """Centres and shrunk, floored covariances; small languages lean on all languages together."""
    floor = np.diag([FLOORS[s] for s in STATISTICS])
    n_of = {g: s[0] for g, s in sums.items()}
    centres = {g: s[1 : 1 + K] / s[0] for g, s in sums.items()}
    covs = {g: s[1 + K :].reshape(K, K) / s[0] - np.outer(centres[g], centres[g]) for g, s in sums.items()}
    total = sum(n_of.values())
    mean, pooled = sum(n_of[g] * centres[g] for g in sums) / total, sum(n_of[g] * covs[g] for g in sums) / total
    lean = 30.0
    out_c, out_i = {}, {}
    for g in languages:
        n, c, v = n_of.get(g, 0.0), centres.get(g, mean), covs.get(g, pooled)
        out_c[g] = c if n >= 15 else (n * c + lean * mean) / (n + lean)
        out_i[g] = np.linalg.inv(widen * (n * v + lean * pooled) / (n + lean) + floor)
    return Model(out_c, out_i)


def fit_prose(vectors: DataFrame) -> Model:
    """Robust centre and covariance per language over all documents with a vector.

    Only per-language sums reach the driver: as many rows as there are languages, which the table of common words bounds.
    """
    quart = vectors.groupBy("language").agg(*[F.percentile_approx(F.col("v")[i], [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(K)])
    rows = {r[0]: np.array([r[i + 1] for i in range(K)]) for r in quart.collect()}
    if not rows:
        return Model({}, {})
    mid = {g: q[:, 1] for g, q in rows.items()}
    least = np.sqrt([FLOORS[s] for s in STATISTICS])
    scale = {g: np.maximum((q[:, 2] - q[:, 0]) / 1.349, least) for g, q in rows.items()}
    languages = list(rows)

    def near(x, lang):
        m, s = np.array([mid[g] for g in lang]), np.array([scale[g] for g in lang])
        return (np.abs(x - m) <= 4 * s).all(axis=1)

    sums = _sums(vectors, near) or _sums(vectors, lambda x, lang: np.ones(len(x), dtype=bool))
    model = _fitted(sums, languages, 1.3)
    for _ in range(2):
        model = _fitted(_sums(vectors, lambda x, lang, m=model: m.contributions(x, lang)[0].sum(axis=1) <= OUTLIER) or sums, languages, 1.15)
    return model


class Forms:
    """Centres and covariances of the forms in the space of ``profile``, or the groups of statistics where labels are too few."""

    def __init__(self, profiles: np.ndarray, labels: np.ndarray):
        self.fits: list[tuple[str, np.ndarray, np.ndarray, float]] = []
        if len(labels) >= LEAST_LABELS:
            fits = self._fit({f: profiles[labels == f] for f in FORMS})
            for _ in range(2):
                # labels that contradict the fit are taken for wrong, unless that were most of a form's
                got = self._nearest(profiles, fits)
                kept = {}
                for f in FORMS:
                    own = labels == f
                    kept[f] = profiles[own & (got == f)] if (own & (got == f)).sum() * 2 > own.sum() else profiles[own]
                fits = self._fit(kept)
            self.fits = fits

    @staticmethod
    def _fit(of: dict[str, np.ndarray]):
        of = {f: w for f, w in of.items() if len(w)}
        n = sum(map(len, of.values()))
        covs = {f: np.cov(w.T, bias=True) if len(w) > 1 else np.zeros((K, K)) for f, w in of.items()}
        pooled = sum(len(of[f]) * covs[f] for f in of) / n
        fits = []
        for f, w in of.items():
            m = len(w)
            cov = (m * covs[f] + 5 * pooled) / (m + 5) + np.eye(K) * (0.05 + 5 / m)
            fits.append((f, np.median(w, axis=0) if m < 10 else w.mean(axis=0), np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1] - 2 * np.log((m + 1) / (n + 4)))))
        return fits

    @staticmethod
    def _nearest(u: np.ndarray, fits) -> np.ndarray:
        score = np.array([((u - m) * ((u - m) @ inverse)).sum(axis=1) + offset for _, m, inverse, offset in fits])
        return np.array([f for f, *_ in fits], dtype=object)[score.argmin(axis=0)]

    def name(self, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        if not len(c):
            return np.array([], dtype=object)
        if self.fits:
            return self._nearest(profile(c, d), self.fits)
        groups = np.column_stack([c[:, [STATISTICS.index(s) for s in of]].sum(axis=1) for of in SPEAKS.values()])
        return np.array(list(SPEAKS), dtype=object)[groups.argmax(axis=1)]


def fit_forms(vectors: DataFrame, model: Model, labels: DataFrame | None) -> Forms:
    """The forms from hand labels: at most MOST_LABELS documents, those with the least hash; a document on which raters are split has none."""
    none = Forms(np.zeros((0, K)), np.array([], dtype=object))
    if labels is None or not model.centres:
        return none
    votes = labels.where(F.col("form").isin(FORMS) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "form").count()
    won = votes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("count", "form")), asc=False).alias("w"))
    one = won.where("size(w) = 1 or w[0].count > w[1].count").select("doc_id", F.col("w")[0]["form"].alias("form")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)
    rows = vectors.join(F.broadcast(one), "doc_id").groupBy("doc_id").agg(F.min(F.struct("language", "v", "form")).alias("x")).select("x.*").collect()
    if not rows:
        return none
    c, d = model.contributions(np.array([r["v"] for r in rows]), np.array([r["language"] for r in rows], dtype=object))
    far = c.sum(axis=1) > OUTLIER
    return Forms(profile(c, d)[far], np.array([r["form"] for r in rows], dtype=object)[far])


def _score(model: Model, forms: Forms):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c, d = model.contributions(*_vectors(batch))
            d2 = c.sum(axis=1)
            outlier = d2 > OUTLIER
            form = np.full(len(d2), "prose", dtype=object)
            form[outlier] = forms.name(c[outlier], d[outlier])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "language": batch.column("language"), "n_words": batch.column("n_words"), "v": batch.column("v"), "distance": np.sqrt(np.maximum(d2, 0.0)), "contributions": c.tolist(), "outlier": outlier, "form": form.tolist()},
                schema=pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("n_words", pa.int64()), ("v", pa.list_(pa.float64())), ("distance", pa.float64()), ("contributions", pa.list_(pa.float64())), ("outlier", pa.bool_()), ("form", pa.string())]),
            )

    return run


def prose_outliers(documents: DataFrame, common_words: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per document with a text: its statistics, distance from its language's prose, each statistic's contribution, outlier and form.

    ``contributions`` are in the order of STATISTICS and add up to the squared distance. ``form`` is list, table, junk or prose;
    what is no outlier is prose. Null and blank texts give no row, null doc_ids neither; repeated documents are judged one by
    one. An empty table gives an empty result; without common words all languages are one. Without ``labels`` (doc_id,
    form), or with fewer than LEAST_LABELS on outliers, an outlier has the form whose statistics contribute most. Labels of
    unknown documents or forms are ignored, and so are other columns.
    """
    vectors = durable(measured(documents, common_words))
    model = fit_prose(vectors)
    forms = fit_forms(vectors, model, labels)
    return vectors.mapInArrow(_score(model, forms), _ROW + ", distance double, contributions array<double>, outlier boolean, form string")


def _judged(spark, folder: str) -> DataFrame:
    return prose_outliers(table(spark, folder, "documents"), table(spark, folder, "common_words"), table(spark, folder, "form_labels"))


def p9_found(spark, folder: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return _judged(spark, folder).where("form <> 'prose'").select("doc_id", "form")


def p9_statistics(spark, folder: str) -> DataFrame:
    """The statistics, distance and contributions of every document with a text."""
    names = [F.col("v")[i].alias(s) for i, s in enumerate(STATISTICS)]
    shares = [F.col("contributions")[i].alias(f"{s}_contribution") for i, s in enumerate(STATISTICS)]
    return _judged(spark, folder).select("doc_id", "language", "n_words", *names, "distance", *shares, "outlier", "form")
