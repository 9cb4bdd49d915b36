"""Language identification: known words first, shorter and shorter character n-grams for the rest.

Learning counts every word of every labelled text per language, with partial counts inside the tasks, and, from the
distinct words, their character n-grams. A known word scores by its smoothed log frequencies per language. Any other word
backs off: at each of its positions the longest n-gram of the model is taken, and their log frequencies are averaged. Scores are
whole numbers of a small unit, so sums do not depend on their order.

An n-gram is in the model if it makes at least one in ``GRAM_SHARE`` of the n-grams of its size in some language, so there are at most so
many per language and size, whatever the corpus. The n-grams and about ``WORDS`` of the known words, shared out over the languages, are
broadcast. All other known words stay in a stored table; what they add is joined to the documents that have them, so
every known word counts as such, at any size.

The model has a column per language of the labelled texts; thousands of languages would make its rows long.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.shared import bitmap, bound_batches, has_bit, held
from tillspark.runtime import drop_materialized, materialize, materialize_counted

WORDS, GRAM_SHARE, LONGEST_GRAM = 150_000, 50_000, 5
#: Words and n-grams seen less often than this are not known.
LEAST_COUNT = 3
SMOOTHING = 0.5
#: Scores are natural logarithms in units of this.
UNIT = 1e-6
UNDETERMINED = "und"
#: Entries of a partial count before it is handed on.
PARTIAL = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, longest: int = LONGEST_GRAM) -> Iterator[tuple[int, str]]:
    framed = f" {word} "
    for n in range(1, longest + 1):
        for i in range(len(framed) - n + 1):
            yield n, framed[i:i + n]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
            names=["lang", "item", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > PARTIAL:
                yield out()
    yield out()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = [(*key, n) for key, n in counts.items()]
        counts.clear()
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["lang", "size", "item", "n"])

    for batch in batches:
        for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((lang, size, g) for size, g in grams_of(word))
            if len(counts) > PARTIAL:
                yield out()
    yield out()


def _items(counts: DataFrame, languages: list[str], sizes: dict) -> tuple[DataFrame, int]:
    """(size, item, by, scores), stored: items seen often enough, their counts and scores per language, and how many there are.

    ``sizes`` has for each (language, size) the number of all items and of different ones.
    """
    per_language = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in languages]
    items = counts.groupBy("size", "item").agg(F.sum("n").alias("total"), F.array(*per_language).alias("by")).filter(F.col("total") >= LEAST_COUNT)
    lengths = sorted({k for _, k in sizes})

    def logs(size: int) -> Column:
        # Sums of logarithms of what is counted and of what all counts make.
        wholes = [np.log(n + SMOOTHING * kinds) for x in languages for n, kinds in (sizes.get((x, size), (1, 1)),)]
        return F.transform("by", lambda n, i: F.round((F.log(n + SMOOTHING) - F.get(F.array(*map(F.lit, wholes)), i)) / UNIT).cast("long"))

    scores = F.lit(None).cast("array<long>")
    for k in lengths:
        scores = F.when(F.col("size") == k, logs(k)).otherwise(scores)
    return materialize_counted(items.select("size", "item", "by", scores.alias("scores")))


def _often(sizes: dict, languages: list[str]) -> Column:
    """Whether an item makes at least one in GRAM_SHARE of all of its size in some language."""
    out = F.lit(False)
    for k in sorted({k for _, k in sizes}):
        least = F.array(*(F.lit(-(-sizes.get((x, k), (0, 0))[0] // GRAM_SHARE)) for x in languages))
        out = out | ((F.col("size") == k) & F.exists(F.arrays_zip(F.col("by").alias("n"), least.alias("least")), lambda z: (z["n"] > 0) & (z["n"] >= z["least"])))
    return out


def quotas(kinds: dict[str, int], most: int) -> dict[str, int]:
    """What each group may keep of its items, ``most`` together: equal shares; what small groups leave goes to the others."""
    out = {}
    for i, (key, n) in enumerate(sorted(kinds.items(), key=lambda x: (x[1], x[0]))):
        out[key] = min(n, most // (len(kinds) - i))
        most -= out[key]
    return out


def _step(n: Column) -> Column:
    """Counts, from 32 on in steps of a sixteenth of a doubling."""
    return F.when(n < 32, n).otherwise(F.floor(16 * F.log2(n)) - 48).cast("int")


def _frequent(items: DataFrame, languages: list[str], n: int, most: int) -> Column:
    """A condition for the most frequent items of each language, about ``most`` or less of the ``n``.

    Of the step that does not fit, those are taken that a hash of their name puts first; the driver sees counts of steps.
    """
    if n <= most:
        return F.lit(True)
    steps: dict[int, dict[int, int]] = {}
    for r in items.select(F.posexplode("by").alias("lang", "n")).filter("n > 0").groupBy("lang", _step(F.col("n")).alias("step")).count().collect():
        steps.setdefault(r.lang, {})[r.step] = r["count"]
    bounds, draws = {}, 1 << 20
    for key, left in quotas({g: sum(c.values()) for g, c in steps.items()}, most).items():
        least, share = 0, draws
        for least in sorted(steps[key], reverse=True):
            here = steps[key][least]
            if here > left:
                # A little under, whatever the hash deals.
                share = int(draws * max(left - 4 * left**0.5, 0) / here)
                break
            left -= here
        bounds[key] = F.struct(F.lit(least).alias("step"), F.lit(share).alias("share"))
    none = F.struct(F.lit(1 << 30).alias("step"), F.lit(0).alias("share"))
    bound, draw = F.array(*(bounds.get(i, none) for i in range(len(languages)))), F.pmod(F.xxhash64("item"), F.lit(draws))
    taken = F.transform("by", lambda n, i: (n > 0) & (
        (_step(n) > F.get(bound, i)["step"]) | ((_step(n) == F.get(bound, i)["step"]) & (draw < F.get(bound, i)["share"]))))
    return F.exists(taken, lambda x: x)


_PRIME = np.uint64(0x100000001B3)


def _gram_keys(points: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the n-grams of ``size`` code points from each place on."""
    out = np.full(len(points) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ points[i:len(points) - size + 1 + i]) * _PRIME
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


@dataclass
class LanguageModel:
    """Scores, one row per word or n-gram, in whole units; columns belong to ``languages``.

    ``words`` are the known words that are broadcast, ``gram_keys`` and ``gram_scores`` per size the sorted hashes of the n-grams and
    their scores. ``rest`` has the known words that are not among ``words``, with what they add to their score as unknown
    words (item, more); None if there are none. ``bits`` is a bitmap of their hashes.
    """

    languages: list[str]
    words: list[str]
    word_scores: np.ndarray
    gram_keys: list[np.ndarray]
    gram_scores: list[np.ndarray]
    rest: DataFrame | None = None
    bits: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def backed_off(self, words: list[str]) -> np.ndarray:
        """For each word the mean over its positions of the longest known n-gram there; zeros where none is known."""
        out = np.zeros((len(words), len(self.languages)), np.int64)
        if not words:
            return out
        # A blank on both sides; the blank between two words is the end of one and the start of the next, so each has its own.
        framed = [f" {w} " for w in words]
        sizes = np.array([len(f) for f in framed])
        points, own = _points("".join(framed)), np.repeat(np.arange(len(words)), sizes)
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(own))
        found, open_places = np.zeros((len(own), len(self.languages)), np.int64), np.ones(len(own), bool)
        for size in range(min(LONGEST_GRAM, int(sizes.max())), 0, -1):
            keys, scores = self.gram_keys[size - 1], self.gram_scores[size - 1]
            if not len(keys):
                continue
            at = np.flatnonzero(open_places[:len(points) - size + 1] & (room[:len(points) - size + 1] >= size))
            asked = _gram_keys(points, size)[at]
            place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = keys[place] == asked
            found[at[hit]] = scores[place[hit]]
            open_places[at[hit]] = False
        known = np.add.reduceat(~open_places, np.cumsum(sizes) - sizes)
        sums = np.add.reduceat(found, np.cumsum(sizes) - sizes, axis=0)
        return np.where(known[:, None] > 0, np.rint(sums / np.maximum(known, 1)[:, None]), 0).astype(np.int64)


def _name(word: str) -> int:
    """A word's hash as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(word)).astype(np.int64))


@dataclass
class Predictor:
    """A model with the scores of words seen, up to a bound."""

    model: LanguageModel
    most: int = 400_000
    seen: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)
    #: Hashes of the words that may be in ``rest``, by their place; 0 for all others.
    names: np.ndarray | None = field(default=None, repr=False)

    def _add(self, new: list[str]) -> None:
        first, last, model = len(self.seen), len(self.seen) + len(new), self.model
        if last > len(self.scores):
            more = max(last, len(self.scores) * 5 // 4) - len(self.scores)
            self.scores = np.concatenate((self.scores, np.zeros((more, len(model.languages)), np.int64)))
            self.names = np.concatenate((self.names, np.zeros(more, np.int64)))
        self.scores[first:last] = model.backed_off(new)
        self.names[first:last] = 0
        if model.bits is not None:
            names = np.array([_name(w) for w in new], np.int64)
            self.names[first:last] = np.where(has_bit(model.bits, names), names, 0)
        self.seen.update(zip(new, range(first, last)))

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[Counter]]:
        """Per text the sums of the scores of its words, whether it has letters, and how often those occur that may be in ``rest``."""
        found = [words_of(t) for t in texts]
        model = self.model
        sums, some = np.zeros((len(texts), len(model.languages)), np.int64), np.zeros(len(texts), bool)
        others = [Counter() for _ in texts]
        if not model.languages:
            return sums, some, others
        if self.scores is None or len(self.seen) > self.most:
            self.seen = dict(zip(model.words, range(len(model.words))))
            self.scores, self.names = model.word_scores.copy(), np.zeros(len(model.words), np.int64)
        seen = self.seen
        places = [list(map(seen.get, words)) for words in found]
        new = list(dict.fromkeys(w for words, at in zip(found, places) if None in at for w, x in zip(words, at) if x is None))
        for first in range(0, len(new), 20_000):
            self._add(new[first:first + 20_000])
        for i, (words, at) in enumerate(zip(found, places)):
            if not words:
                continue
            some[i] = any(c.isalpha() for w in words for c in w)
            at = np.array(list(map(seen.__getitem__, words)) if None in at else at)
            sums[i] = self.scores[at].sum(axis=0)
            if model.bits is not None:
                names = self.names[at]
                others[i] = Counter(names[names != 0].tolist())
        return sums, some, others

    def best(self, sums: np.ndarray, some: np.ndarray) -> pa.StructArray:
        """The language and its share of the likelihood; ties go to the first name."""
        names, shares = np.full(len(sums), UNDETERMINED, object), np.zeros(len(sums))
        if some.any():
            own = sums[some]
            best = own.argmax(axis=1)
            names[some] = np.array(self.model.languages, object)[best]
            shares[some] = 1 / np.exp((own - own.max(axis=1)[:, None]) * UNIT).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares)], names=["lang_pred", "score"])

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of one text; ``rest`` is not asked."""
        found = self.best(*self.totals([text])[:2])[0].as_py()
        return found["lang_pred"], found["score"]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS) -> LanguageModel:
    """Counts over all rows of ``labelled``; those without language or text are left out.

    With nothing to learn from, every prediction is ``und``.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    partial = rows.mapInArrow(_count_words, "lang string, item string, n long")
    counts = materialize(partial.groupBy("lang", "item").agg(F.sum("n").alias("n")).withColumn("size", F.lit(0)))
    every = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")]
    sizes = {(r.lang, 0): (r.n, r.kinds) for r in counts.groupBy("lang").agg(*every).collect()}
    languages = sorted(x for x, _ in sizes)
    if not languages:
        drop_materialized(counts)
        return LanguageModel([], [], np.zeros((0, 0), np.int64), [np.zeros(0, np.uint64)] * LONGEST_GRAM, [np.zeros((0, 0), np.int64)] * LONGEST_GRAM)
    items, n_words = _items(counts, languages, sizes)
    wanted = _frequent(items, languages, n_words, words)
    known = items.filter(wanted).select("item", "scores").toArrow()
    parts = materialize(
        counts.select("lang", "item").mapInArrow(_count_grams, "lang string, size int, item string, n long")
        .groupBy("lang", "size", "item").agg(F.sum("n").alias("n")))
    gram_sizes = {(r.lang, r.size): (r.n, r.kinds) for r in parts.groupBy("lang", "size").agg(*every).collect()}
    grown, _ = _items(parts, languages, gram_sizes)
    frequent = grown.filter(_often(gram_sizes, languages)).select("size", "item", "scores").toArrow()
    gram_keys, gram_scores = [], []
    scores, lengths = _matrix(frequent["scores"], len(languages)), frequent["size"].to_numpy()
    names = np.array(frequent["item"].to_pylist(), object)
    for size in range(1, LONGEST_GRAM + 1):
        own = np.flatnonzero(lengths == size)
        keys = _gram_keys(_points("".join(names[own])), size)[::size] if len(own) else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        gram_keys.append(keys[order])
        gram_scores.append(scores[own][order])
    model = LanguageModel(languages, known["item"].to_pylist(), _matrix(known["scores"], len(languages)), gram_keys, gram_scores)
    if len(model.words) < n_words:
        sent = labelled.sparkSession.sparkContext.broadcast(model)

        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column(0).to_pylist()
                added = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1) - sent.value.backed_off(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_name(w) for w in names], pa.int64()), batch.column(0), pa.array(added.tolist(), pa.list_(pa.int64()))],
                    names=["name", "item", "more"])

        rest, left = materialize_counted(items.filter(~wanted).select("item", "scores").mapInArrow(more, "name long, item string, more array<long>"))
        model.rest, model.bits = rest, bitmap(rest, left, F.col("name"))
    for done in (counts, parts, items, grown):
        drop_materialized(done)
    return model


def predictor(spark, model: LanguageModel):
    """A column function: text to (lang_pred, score), for a model without ``rest``."""
    sent, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        known = held(("language", name), lambda: Predictor(sent.value))
        return known.best(*known.totals(texts.to_pylist())[:2])

    return predict


def held_out(doc: Column) -> Column:
    """The third of the documents that nothing is learned from. A NULL id is in neither part: not held out, not learned."""
    return F.coalesce(F.crc32(doc.cast("string")) % 3 == 1, F.lit(False))


def _identify_with_rest(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Sums by what is broadcast are stored per row; the other words go, as hashes, to the table and their sums back to the rows.

    Different words of one hash count as unknown words here: none of them is taken for another.
    """
    spark, width = docs.sparkSession, len(model.languages)
    sent, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    some = pa.list_(pa.struct([("name", pa.int64()), ("n", pa.int32())]))

    @F.arrow_udf("struct<sums:array<long>,letters:boolean,others:array<struct<name:long,n:int>>>")
    def totals(texts: pa.Array) -> pa.Array:
        known = held(("language", name), lambda: Predictor(sent.value))
        sums, letters, others = known.totals(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(letters),
             pa.array([[{"name": w, "n": n} for w, n in o.items()] for o in others], some)], names=["sums", "letters", "others"])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def best(sums: pa.Array, letters: pa.Array, added: pa.Array) -> pa.Array:
        whole = sums.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
        there = np.flatnonzero(added.is_valid().to_numpy(zero_copy_only=False))
        if len(there):
            whole = whole.copy()
            whole[there] += added.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
        return Predictor(sent.value).best(whole, letters.to_numpy(zero_copy_only=False).astype(bool))

    summed = materialize(docs.select("doc_id", totals("text").alias("s")).select("doc_id", "s.*", F.monotonically_increasing_id().alias("row")))
    asked = summed.select("row", F.explode("others").alias("o")).select("row", "o.*")
    single = model.rest.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.first("more").alias("more")).filter("k = 1").drop("k")
    # The words of the table are rare, each; what they add is summed by partial sums.
    met = asked.join(single.hint("merge"), "name").select("row", *((F.col("n") * F.get("more", F.lit(i))).alias(f"s{i}") for i in range(width)))
    added = met.groupBy("row").agg(F.array(*(F.sum(f"s{i}") for i in range(width))).alias("added"))
    found = summed.drop("others").join(added, "row", "left").select("doc_id", best("sums", "letters", "added").alias("found"))
    return found.select("doc_id", "found.*")


def identify(docs: DataFrame, model: LanguageModel, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``, from the text alone.

    NULL texts and texts without letters give ``und`` with score 0. NULL and repeated ids stay. Other columns are
    ignored. No rows in, no rows out.
    """
    bound_batches(docs.sparkSession)
    if model.rest is not None:
        return _identify_with_rest(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), model)
    found = predictor(docs.sparkSession, model)(F.col(text))
    return docs.select(F.col(doc).alias("doc_id"), found.alias("found")).select("doc_id", "found.*")
