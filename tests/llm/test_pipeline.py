import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_dups import brute_groups, brute_repeats

from tillspark.llm import near_dups, toxicity


def table(docs_of, rows):
    return docs_of(rows).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))


def ids(df):
    return sorted(str(r.doc_id) for r in df.collect())


def test_language_stage(spark, docs_of, prose):
    docs = table(docs_of, [(1, prose(30)), (2, None), (3, "12 -- 34"), (4, ""), (None, prose(20, 2)), (1, prose(30))])
    kept = corpus_pipeline.keep_known_language(spark, docs, "")
    assert ids(kept) == ["1", "1", "None"] and kept.columns == docs.columns
    assert corpus_pipeline.keep_known_language(spark, docs.limit(0), "").count() == 0


def test_toxicity_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    model = toxicity.learn_severity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = sorted(str(r.doc_id) for r in docs.collect() if not model.above(r.text)[0] >= model.threshold)
    assert ids(kept) == want and kept.columns == docs.columns and len(want) < docs.count()


def test_near_duplicate_stage(spark, docs_of, prose):
    rows = [(5, prose(90, 1)), (4, prose(90, 1)), (4, prose(90, 1) + " tail"), (9, prose(90, 1) + " tail"), (None, prose(90, 1)), (7, None), (8, None), (7, None)]
    docs = table(docs_of, rows)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert ids(kept) == ["4", "7", "8", "None"] and kept.columns == docs.columns
    assert corpus_pipeline.keep_one_of_each_group(spark, docs.limit(0), "").count() == 0


def test_near_duplicate_stage_keeps_each_text_of_a_repeated_id(spark, docs_of, prose):
    one, other = prose(80, 1), prose(80, 2)
    rows = [(3, one), (5, one), (5, other), (5, other), (6, other), (2, None), (2, "")]
    kept = corpus_pipeline.keep_one_of_each_group(spark, table(docs_of, rows), "")
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(2, ""), (3, one), (5, other)]
    found = near_dups.near_duplicates(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in found) == [
        (2, 2, True), (2, 2, True), (3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (6, 5, False)]


def test_repeats_stage(spark, docs_of, prose):
    shared = prose(100, 3)
    rows = [(1, "é" + shared + " one"), (2, "è" + shared + " two"), (3, None), (None, "short"), (4, shared[:399])]
    docs = table(docs_of, rows)
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()}
    for (doc, text), (_, kept) in zip(rows, brute_repeats([t for _, t in rows])):
        want = None if text is None else kept.decode("utf-8", "ignore")
        assert (got[doc].text, got[doc].n_chars) == (want, None if want is None else len(want))


def test_passage_stage_goes_by_words(spark, docs_of, prose):
    short = prose(56, 3, alphabet="aeinst")
    long, few, ends = " ".join(f"{w}é" for w in prose(51, 4).split()), prose(50, 5), [prose(70, s) for s in range(10, 18)]
    assert len(short.encode()) < 400 and len(short.split()) == 56
    rows = [(1, f"{ends[0]} {short} {ends[1]}"), (2, f"{ends[2]}\n\"{short}\"\n{ends[3]}"), (3, f"{ends[4]} {long}"), (4, f"{long} {ends[5]}"),
            (5, f"{ends[6]} {few} x"), (6, f"y {few} {ends[7]}"), (7, short), (8, None), (9, "")]
    docs = table(docs_of, rows)
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["repeated_passages"](spark, docs, "").collect()}
    want = {1: f"{ends[0]} {ends[1]}", 2: f"{ends[2]}\n{ends[3]}", 3: f"{ends[4]} ", 4: ends[5], 5: rows[4][1], 6: rows[5][1], 7: "", 8: None, 9: ""}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())


def test_stages_one_after_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        at = stage(spark, at, sf)
    before = [(r.doc_id, r.text) for r in at.collect()]
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(before, "doc_id long, text string"), sf)
    want = sorted({str(g) for g in brute_groups(before)})
    assert ids(kept) == want
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert sorted({str(p.doc_id) for p in pieces}) == want
    length = {}
    for p in pieces:
        length[p.sequence_id] = length.get(p.sequence_id, 0) + p.length
    assert max(length.values()) <= 2048
    assert np.mean([p.length > 0 for p in pieces]) == 1
