"""Toxicity as ordered severity grades: a cumulative-link (proportional-odds) regression.

    P(grade > k) = sigmoid(w . x - cut_k),   cut_0 < cut_1 < ...

One weight per feature is shared by all thresholds; only the cuts differ. ``x`` is sparse: log(1 + count) of the words
and word beginnings the model uses. Expected severity is the sum of the P(grade > k).

The features are chosen from document counts over all labelled rows, made with partial counts inside the tasks. Only the
weights, cuts and threshold are fitted on a sample, at most ``FIT_ROWS`` labelled rows chosen by a hash; with at most
``FEATURES`` features this bounds what is broadcast and what reaches the driver. Scoring covers every row.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm.shared import bitmap, bound_batches, has_bit, held
from tillspark.runtime import drop_materialized, materialize, materialize_counted

FEATURES, FIT_ROWS = 2048, 30_000
#: A feature is used if it stands in so many documents and its share of toxic ones is so many deviations off.
LEAST_DOCS, LEAST_Z = 3, 4.0
#: Lengths of word beginnings, which catch inflected and compounded forms; whole words are features besides.
BEGINNINGS = (4, 5, 6)
RIDGE, STEPS = 2e-4, 400
#: A row is called toxic if its probability of a grade above 0 reaches a threshold, fitted between these.
THRESHOLDS = (0.05, 0.5)
PARTIAL = 400_000
#: Features by which toxic texts are told more and less severe.
TELLING = 128

_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _features_of(word: str) -> tuple[str, ...]:
    starts = tuple(word[:n] for n in BEGINNINGS if len(word) >= n)
    return (*starts, f"{word}$")


class _ByWord(dict):
    """A function of words that keeps what it gave, up to a bound."""

    def __init__(self, function, most: int = 300_000):
        self.function, self.most = function, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.function(word)
        return out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every, high, features = Counter(), Counter(), _ByWord(_features_of)

    def out() -> pa.RecordBatch:
        names = list(every)
        rows = [pa.array(names, pa.string()), pa.array([every[w] for w in names], pa.int64()),
                pa.array([high[w] for w in names], pa.int64())]
        every.clear()
        high.clear()
        return pa.RecordBatch.from_arrays(rows, names=["word", "n", "high"])

    for batch in batches:
        for text, grade in zip(batch.column(0), batch.column(1)):
            found = set(chain.from_iterable(map(features.__getitem__, set(_words(text.as_py())))))
            every.update(found)
            if grade.as_py() > 0:
                high.update(found)
            if len(every) > PARTIAL:
                yield out()
    yield out()


def document_counts(labelled: DataFrame, text: str = "text", grade: str = "grade") -> DataFrame:
    """(word, n, high): of each feature its documents, and those with a grade above 0; a stored table."""
    rows = labelled.select(F.col(text).alias("text"), F.col(grade).cast("int").alias("grade")).filter(F.col("text").isNotNull() & (F.col("grade") >= 0))
    return materialize(rows.mapInArrow(_document_counts, "word string, n long, high long")
                       .groupBy("word").agg(F.sum("n").alias("n"), F.sum("high").alias("high")))


@dataclass
class SeverityModel:
    index: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray
    threshold: float = THRESHOLDS[1]
    #: Tells models apart in workers that live on.
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def features(self, text: str | None) -> tuple[list[int], np.ndarray]:
        index = self.index
        places_of = held(("severity", self.name), lambda: _ByWord(lambda w: tuple(index[f] for f in _features_of(w) if f in index)))
        counts = Counter(chain.from_iterable(map(places_of.__getitem__, _words(text))))
        places = sorted(counts)
        return places, np.log1p([counts[i] for i in places])

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each k."""
        places, values = self.features(text)
        return _sigmoid(float(self.weights[places] @ values) - self.cuts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_cumulative_link(
    rows: np.ndarray, places: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int, top: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts of the largest penalised likelihood, by full-batch gradient steps (Adam).

    ``rows``, ``places`` and ``values`` are the sparse entries; the cuts are a first one and the logs of the gaps.
    """
    n = len(grades)
    shares = np.array([(grades > k).mean() for k in range(top)])
    start = -np.log(np.clip(shares, 1e-6, 1 - 1e-6) / (1 - np.clip(shares, 1e-6, 1 - 1e-6)))
    x = np.concatenate((np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(x), np.zeros_like(x)
    at = np.arange(n)
    for step in range(1, STEPS + 1):
        w, cuts = x[:features], np.cumsum(np.concatenate((x[features:features + 1], np.exp(x[features + 1:]))))
        score = np.bincount(rows, w[places] * values, n)
        # P(grade > k), with the certain ends; P(grade) is a difference of neighbours.
        p = np.column_stack((np.ones(n), *(_sigmoid(score - c) for c in cuts), np.zeros(n)))
        slope = p * (1 - p)
        likely = np.maximum(p[at, grades] - p[at, grades + 1], 1e-12)
        by_score = (slope[at, grades] - slope[at, grades + 1]) / likely
        by_cut = np.zeros((n, top + 2))
        by_cut[at, grades] -= slope[at, grades] / likely
        by_cut[at, grades + 1] += slope[at, grades + 1] / likely
        by_cut = by_cut[:, 1:-1].mean(axis=0)
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate((
            np.bincount(places, by_score[rows] * values, features) / n - RIDGE * w,
            tail[:1], tail[1:] * np.exp(x[features + 1:])))
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        x = x + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return x[:features], np.cumsum(np.concatenate((x[features:features + 1], np.exp(x[features + 1:]))))


def fit_threshold(p: np.ndarray, high: np.ndarray) -> float:
    """The threshold with the fewest errors; of a gap without rows its middle, in log odds."""
    order = np.argsort(p, kind="stable")
    odds = np.log(np.clip(p[order], 1e-9, 1 - 1e-9) / (1 - np.clip(p[order], 1e-9, 1 - 1e-9)))
    # Errors if all rows from place i on are called high: missed ones before it, clean ones from it.
    errors = np.append(0, np.cumsum(high[order])) + np.append(np.cumsum(~high[order][::-1])[::-1], 0)
    # Only between different odds, or above all.
    places = np.append(np.flatnonzero(np.diff(odds) > 1e-9) + 1, len(p))
    best = int(places[np.argmin(errors[places])])
    middle = (odds[best - 1] + odds[best]) / 2 if best < len(p) else np.inf
    return float(np.clip(_sigmoid(np.array(middle)), *THRESHOLDS))


def _chosen(n: int, *columns: str):
    """A condition that holds for at most FIT_ROWS of ``n`` rows, by a hash; a little under, whatever the hash deals."""
    steps = 1 << 20
    kept = steps if n <= FIT_ROWS else int(steps * 0.95 * FIT_ROWS / n)
    return F.pmod(F.xxhash64(*columns), F.lit(steps)) < kept


def learn(
    labelled: DataFrame, doc: str = "doc_id", text: str = "text", grade: str = "grade", counts: DataFrame | None = None,
) -> SeverityModel:
    """Fit to rows with a whole-number ``grade`` from 0 up; rows whose grade or text is NULL are left out.

    ``counts`` is what ``document_counts`` gives for these rows, if it is there already. With no rows, or with one
    grade only, the model gives every row severity 0.
    """
    spark = labelled.sparkSession
    bound_batches(spark)
    rows = labelled.select(F.col(doc).alias("id"), F.col(text).alias("text"), F.col(grade).cast("int").alias("grade"))
    rows = rows.filter(F.col("text").isNotNull() & (F.col("grade") >= 0))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") > 0).alias("high"),
                    F.coalesce(F.max("grade"), F.lit(0)).alias("top")).first()
    if size.high in (0, size.n):
        return SeverityModel({}, np.zeros(0), np.full(max(size.top, 1), 500.0))
    counts = counts if counts is not None else document_counts(rows)
    share = size.high / size.n
    z = (F.col("high") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    chosen = [r.word for r in counts.filter(F.col("n") >= LEAST_DOCS).withColumn("z", z)
              .filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(FEATURES).collect()]
    model = SeverityModel({w: i for i, w in enumerate(chosen)}, np.zeros(len(chosen)), np.zeros(size.top))
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<places:array<int>,values:array<double>>")
    def features(texts: pa.Array) -> pa.Array:
        found = [sent.value.features(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([p for p, _ in found], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in found], pa.list_(pa.float64()))],
            names=["places", "values"])

    sample = rows.filter(_chosen(size.n, "id", "text"))
    held = sample.select("grade", features("text").alias("x")).select("grade", "x.*").toArrow()
    grades = held["grade"].to_numpy()
    lists = held["places"].combine_chunks()
    per_row = np.diff(lists.offsets.to_numpy()) if len(held) else np.zeros(0, int)
    row, place = np.repeat(np.arange(len(grades)), per_row), lists.flatten().to_numpy().astype(np.int64)
    value = held["values"].combine_chunks().flatten().to_numpy()
    model.weights, model.cuts = fit_cumulative_link(row, place, value, grades.astype(np.int64), len(chosen), size.top)
    scores = np.bincount(row, model.weights[place] * value, len(grades))
    model.threshold = fit_threshold(_sigmoid(scores - model.cuts[0]), grades > 0)
    return model


def _perhaps_among(ids: DataFrame, n: int):
    """A column function of the hash of a doc_id: true for those of ``ids``, and for few others."""
    sent = ids.sparkSession.sparkContext.broadcast(bitmap(ids, n, F.xxhash64("doc_id")))

    @F.arrow_udf("boolean")
    def perhaps(hashes: pa.Array) -> pa.Array:
        return pa.array(has_bit(sent.value, hashes.to_numpy(zero_copy_only=False)))

    return perhaps


def learn_severity(docs: DataFrame, labels: DataFrame) -> SeverityModel:
    """A model from labels (doc_id, toxic) that tell toxic from clean only.

    Grades: 0 clean, 1 toxic, 2 toxic and strongly so. The second step is read from the texts: toxic documents
    with more than the median number of telling words, those whose documents are toxic nine times in ten. Rows
    without text or label are left out; labels that repeat count once, and of labels of one id that differ, toxic counts. Counts, shares and the median cover all labelled
    documents. Their texts, and few others, are shuffled once to their labels and stored until the model is there.
    """
    bound_batches(docs.sparkSession)
    toxic, n = materialize_counted(
        labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("grade")))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    if docs.schema["doc_id"].dataType == labels.schema["doc_id"].dataType:  # or else equal ids may have other hashes
        texts = texts.filter(_perhaps_among(toxic, n)(F.xxhash64("doc_id")))
    rows = materialize(texts.join(toxic.hint("merge"), "doc_id"))
    counts = document_counts(rows)
    base = rows.agg(F.avg("grade").alias("share")).first().share
    z = (F.col("high") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base)) if base and base < 1 else F.lit(0.0)
    often = counts.filter((F.col("n") >= LEAST_DOCS) & (F.col("high") > 0.9 * F.col("n")))
    telling = {r.word for r in often.orderBy(F.desc(z), "word").limit(TELLING).collect()}

    @F.arrow_udf("long")
    def hits(texts: pa.Array) -> pa.Array:
        tells = _ByWord(lambda w: any(f in telling for f in _features_of(w)))
        return pa.array([sum(map(tells.__getitem__, _words(t.as_py()))) for t in texts], pa.int64())

    found = rows.filter("grade > 0").select("doc_id", "text", hits("text").alias("hits"))
    middle = found.agg(F.percentile_approx("hits", 0.5).alias("m")).first().m
    high = found.select("doc_id", "text", F.when(F.col("hits") <= F.lit(middle), 1).otherwise(2).alias("grade"))
    model = learn(rows.filter("grade = 0").unionByName(high), counts=counts)
    for done in (toxic, rows, counts):
        drop_materialized(done)
    return model


def scorer(spark, model: SeverityModel):
    """A column function: text to (severity, grade, p_toxic, toxic)."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<severity:double,grade:int,p_toxic:double,toxic:boolean>")
    def score(texts: pa.Array) -> pa.Array:
        above = np.array([sent.value.above(t.as_py()) for t in texts]).reshape(len(texts), -1)
        first = above[:, 0] if len(texts) else np.zeros(0)
        return pa.StructArray.from_arrays(
            [pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)), pa.array(first),
             pa.array(first >= sent.value.threshold)], names=["severity", "grade", "p_toxic", "toxic"])

    return score


def score(docs: DataFrame, model: SeverityModel, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) per row of ``docs``.

    NULL and empty texts have no words and so the severity of a text that says nothing. NULL and repeated ids stay.
    Other columns are ignored. No rows in, no rows out.
    """
    bound_batches(docs.sparkSession)
    found = scorer(docs.sparkSession, model)(F.col(text))
    return docs.select(F.col(doc).alias("doc_id"), found.alias("found")).select("doc_id", "found.*")
