from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tillspark.llm import language, shared, toxicity


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_words_then_grams(spark, docs_of):
    rows = [(i, "the house and the garden with other things", "en") for i in range(5)]
    rows += [(i, "das haus und der garten mit anderen dingen", "de") for i in range(5, 10)]
    model = language.learn(labelled(spark, [*rows, (11, None, "fr"), (12, "und", None)]))
    assert model.languages == ["de", "en"]
    predict = language.Predictor(model).predict
    assert predict("THE House")[0] == "en" and predict("der garten")[0] == "de"
    # Words never seen, by their n-grams.
    assert "gardening" not in model.words and predict("gardening otherthing")[0] == "en"
    assert predict("anderungen haustand")[0] == "de"
    docs = docs_of([(1, None), (2, ""), (3, "123 !? _ ²"), (4, "the garden"), (4, "the garden"), (None, "der garten"), (5, "the " * 50_000), (6, "qqq zzz")])
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in language.identify(docs, model).collect())
    assert [g[:2] for g in got] == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("5", "en"), ("6", "de"), ("None", "de")]
    assert all(0 <= s <= 1 for _, _, s in got) and all(s == 0 for _, x, s in got if x == "und")
    assert language.identify(docs_of([]), model).count() == 0


def test_language_words_beyond_the_bound_count_exactly(spark, sf, monkeypatch):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole, tight = language.learn(docs), language.learn(docs, words=400)
    assert whole.rest is None and len(tight.words) <= 400 < len(whole.words) == len(tight.words) + tight.rest.count()
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (-1, "12"), (-1, "")], "doc_id long, text string"))
    want, got = (sorted((str(r.doc_id), r.lang_pred, r.score) for r in language.identify(texts, m).collect()) for m in (whole, tight))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)
    kept = sorted(r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, sf).collect())
    monkeypatch.setattr(language, "learn", lambda _: tight)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, sf).collect()) == kept


def test_language_bound_is_shared_out(spark):
    rows = [(i, " ".join(f"the{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(500)), "en") for i in range(40)]
    rows += [(i, " ".join(f"zu{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(100)), "de") for i in range(40, 44)]
    model = language.learn(labelled(spark, rows), words=200)
    assert sum(w.startswith("zu") for w in model.words) >= 60 and sum(w.startswith("the") for w in model.words) >= 50
    assert len(model.words) <= 200
    assert language.quotas({"a": 10, "b": 900, "c": 900}, 300) == {"a": 10, "b": 145, "c": 145}


def plain_language(learned, texts):
    """Language and score of each text, straight from the definition; ``learned`` are (text, language)."""
    langs = sorted({x for _, x in learned})
    words, grams = {}, {}
    for text, lang in learned:
        for w in language.words_of(text):
            words.setdefault(w, Counter())[lang] += 1
    for w, by in words.items():
        for size, g in language.grams_of(w):
            for lang in by:
                grams.setdefault((size, g), Counter())[lang] += 1

    def logs(by, whole):
        return [round((np.log(by[x] + language.SMOOTHING) - np.log(whole[x][0] + language.SMOOTHING * whole[x][1])) / language.UNIT) for x in langs]

    def whole(items):
        return {x: (sum(by[x] for by in items), sum(by[x] > 0 for by in items)) for x in langs}

    sizes = {n: whole([by for (k, _), by in grams.items() if k == n]) for n in range(1, language.LONGEST_GRAM + 1)}
    for n, of in sizes.items():
        sizes[n] = {x: v if v[1] else (1, 1) for x, v in of.items()}
    word_sizes = whole(words.values())
    known = {w: logs(by, word_sizes) for w, by in words.items() if by.total() >= language.LEAST_COUNT}
    some = {key: logs(by, sizes[key[0]]) for key, by in grams.items() if by.total() >= language.LEAST_COUNT and any(
        by[x] and by[x] >= -(-sizes[key[0]][x][0] // language.GRAM_SHARE) for x in langs)}

    def score(word):
        if word in known:
            return known[word]
        framed, found = f" {word} ", []
        for i in range(len(framed)):
            for n in range(language.LONGEST_GRAM, 0, -1):
                if i + n <= len(framed) and (n, framed[i:i + n]) in some:
                    found.append(some[n, framed[i:i + n]])
                    break
        return [int(np.rint(sum(f[k] for f in found) / len(found))) for k in range(len(langs))] if found else [0] * len(langs)

    out = []
    for text in texts:
        found = language.words_of(text)
        if not any(c.isalpha() for w in found for c in w):
            out.append(("und", 0.0))
            continue
        sums = np.sum([score(w) for w in found], axis=0)
        best = int(np.argmax(sums))
        out.append((langs[best], 1 / np.exp((sums - sums[best]) * language.UNIT).sum()))
    return out


def test_language_equals_a_plain_scorer(spark, sf, monkeypatch):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts = [t[:600] for _, t, _ in docs] + ["zzz qqq", "é", "a", "1 2", "", "the " * 9, "unknownwordofsomelength und ähnliches 漢字"]
    for share in (language.GRAM_SHARE, 300):
        monkeypatch.setattr(language, "GRAM_SHARE", share)
        model = language.learn(labelled(spark, docs))
        got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
        got = [(r.lang_pred, r.score) for r in sorted(got, key=lambda r: r.doc_id)]
        want = plain_language([(t, x) for _, t, x in docs], texts)
        assert [g[0] for g in got] == [w[0] for w in want]
        # Units are rounded in two logarithms of a word.
        assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-3)


def test_nothing_to_learn_from(spark, docs_of):
    model = language.learn(labelled(spark, [(1, "a b", None)]))
    assert [tuple(r) for r in language.identify(docs_of([(1, "a b")]), model).collect()] == [(1, "und", 0.0)]


def test_language_accuracy_held_out(spark, sf):
    from tillspark.llm.queries import QUERIES

    found = QUERIES["op8_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    # The held-out third does not change what is learned.
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    assert found.filter("held_out").count() == docs.filter(fold == 1).count()


def log_likelihood(x, grades, w, cuts):
    above = 1 / (1 + np.exp(-(x @ w)[:, None] + cuts[None, :]))
    p = np.column_stack((np.ones(len(x)), above, np.zeros(len(x))))
    at = np.arange(len(x))
    return np.log(p[at, grades] - p[at, grades + 1]).mean() - toxicity.RIDGE / 2 * (w**2).sum()


def test_cumulative_link_fit():
    rng = np.random.default_rng(0)
    x = (rng.random((4000, 5)) < 0.3).astype(float)
    true, cuts = np.array([2.0, -1.5, 0.0, 1.0, 3.0]), np.array([0.5, 2.0, 3.5])
    grades = ((x @ true + rng.logistic(size=4000))[:, None] > cuts).sum(axis=1)
    rows, places = np.nonzero(x)
    w, found = toxicity.fit_cumulative_link(rows, places, x[rows, places], grades, 5, 3)
    assert np.abs(w - true).max() < 0.35 and np.abs(found - cuts).max() < 0.35 and (np.diff(found) > 0).all()
    best = log_likelihood(x, grades, w, found)
    for _ in range(30):
        assert log_likelihood(x, grades, w + rng.normal(size=5) * 0.05, found) <= best + 1e-4


def test_threshold_has_the_fewest_errors():
    p, high = np.array([0.01, 0.02, 0.2, 0.3, 0.9]), np.array([False, False, True, True, True])
    assert 0.02 < toxicity.fit_threshold(p, high) <= 0.2


def test_toxicity_finds_labelled_kinds(spark, docs_of, prose):
    rows = [(i, prose(60, i) + (" you nasty fool" if i % 5 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn_severity(docs_of(rows), labels)
    fresh = [(500, prose(80, 900) + " nasty fool"), (501, prose(80, 901)), (502, None), (503, ""), (501, prose(80, 901)), (None, prose(40, 3)), (504, prose(60_000, 5))]
    got = [(r.doc_id, r.toxic, r.severity) for r in toxicity.score(docs_of(fresh), model).collect()]
    assert len(got) == len(fresh) and [d for d, t, _ in got if t] == [500]
    assert all(0 <= s <= len(model.cuts) for *_, s in got)
    assert toxicity.score(docs_of([]), model).count() == 0


def test_toxicity_counts_cover_all_labels(spark, docs_of, prose, monkeypatch):
    docs = docs_of([(i, prose(30, i) + (" you nasty fool" * (1 + i % 3) if i % 5 == 0 else "")) for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 400)], "doc_id long, toxic int").repartition(3)
    whole = toxicity.learn_severity(docs, labels)
    counted, fitted, count, fit = [], [], toxicity.document_counts, toxicity.fit_cumulative_link
    monkeypatch.setattr(toxicity, "document_counts", lambda rows, *a: counted.append(rows.count()) or count(rows, *a))
    monkeypatch.setattr(toxicity, "fit_cumulative_link", lambda r, p, v, grades, *a: fitted.append(len(grades)) or fit(r, p, v, grades, *a))
    monkeypatch.setattr(toxicity, "FIT_ROWS", 60)
    model = toxicity.learn_severity(docs, labels)
    # The sample bounds the fit only: the same features and as many grades as with all rows.
    assert counted == [300] and 0 < fitted[0] <= 80
    assert model.index == whole.index and len(model.cuts) == len(whole.cuts) == 2


def test_toxicity_tells_long_words_with_one_beginning(spark, docs_of, prose):
    rows = [(i, prose(30, i) + (" achkeiter" if i % 5 == 0 else " achkeiten")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.learn_severity(docs_of(rows), labels)
    assert {"achkeiter$", "achkeiten$"} <= set(model.index) and not {"achk", "achkei"} & set(model.index)
    said = [model.above(prose(30, 900 + i) + f" {w}")[0] >= model.threshold for i in range(5) for w in ("achkeiter", "achkeiten")]
    assert said == [True, False] * 5


def test_bitmap_has_every_key(spark):
    keys = spark.range(5000).filter("id % 5 = 0")
    bits = shared.bitmap(keys, 1000, F.xxhash64("id"))
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h")).toPandas()
    found = shared.has_bit(bits, rows.h.to_numpy())
    assert found[rows.id % 5 == 0].all() and found.mean() < 0.35


def test_toxicity_without_a_second_grade(spark, docs_of):
    for marks in ([], [(1, 0)], [(1, 1)]):
        labels = spark.createDataFrame(marks, "doc_id long, toxic int")
        model = toxicity.learn_severity(docs_of([(1, "a b c")]), labels)
        assert [r.severity for r in toxicity.score(docs_of([(1, "a b c")]), model).collect()][0] < 1e-3


def test_toxicity_query_on_labelled_documents(spark, sf):
    from tillspark.llm.queries import QUERIES

    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables have a handful of toxic rows
    found = QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "said"), "doc_id")
    clean = found.filter("said = 0").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    caught = found.filter("said = 1").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    assert clean < 0.01 and caught > 0.75


def test_of_labels_that_differ_toxic_counts(spark, docs_of):
    docs = docs_of([(i, f"some words and {'poison vile' if i < 30 else 'garden calm'} number{i % 7}") for i in range(90)])
    once = [(i, int(i < 30)) for i in range(90)]
    told = []
    for marks in (once, once + [(i, 0) for i in range(30)] + [(i, None) for i in range(90)] + once[:5]):
        labels = spark.createDataFrame(marks, "doc_id long, toxic int")
        found = toxicity.score(docs, toxicity.learn_severity(docs, labels)).collect()
        told.append(sorted((r.doc_id, r.toxic, round(r.severity, 5)) for r in found))
    assert told[0] == told[1] and {d for d, toxic, _ in told[0] if toxic} == set(range(30))
