"""A corpus made ready for training: five stages, each an operator of ``tillspark.llm`` over all that the stage before kept.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written and read again as the next
stage's documents. All but the last return the columns of their input. In every stage NULL ids stay, NULL texts count
as empty, and no rows give no rows.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm import language, near_dups, packing, repeats, toxicity
from tillspark.llm.shared import bound_batches, spare
from tillspark.runtime import drop_materialized, materialize

#: A document whose likeliest language has less than this share of the likelihood is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: Passages of over fifty words are removed where they repeat.
PASSAGE_WORDS = 51
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def keep_known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in.

    Rejected: NULL texts, texts without letters, and texts whose language is not told from the others. Where no
    document has a language, nothing can be learned and nothing but these is known to be foreign, so texts with
    letters stay.
    """
    bound_batches(spark)
    model = language.learn(docs)
    found = spare(docs, "found")
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    if model.rest is not None:
        # The language depends on the text alone, so the texts rejected are told by their hashes.
        names = [spare(docs, f"text_{i}") for i in (1, 2)]
        hashes = dict(zip(names, (F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))))
        told = language.identify(docs.select(F.struct(*(h.alias(n) for n, h in hashes.items())).alias("doc_id"), "text"), model)
        fine = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
        rejected = materialize(told.filter(~fine).select("doc_id.*").distinct())
        return docs.withColumns(hashes).join(rejected, names, "left_anti").select(*docs.columns)
    told = docs.withColumn(found, language.predictor(spark, model)(F.col("text")))
    fine = (F.col(found)["lang_pred"] != language.UNDETERMINED) & (F.col(found)["score"] >= LEAST_LANGUAGE_SCORE)
    return told.filter(fine).drop(found)


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the severity model, learned from the labelled ones among them, does not call toxic."""
    bound_batches(spark)
    model = toxicity.learn_severity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    found = spare(docs, "found")
    told = docs.withColumn(found, toxicity.scorer(spark, model)(F.col("text")))
    return told.filter(~F.col(found)["toxic"]).drop(found)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, as ``near_duplicates`` names it by id and text; of
    rows equal in both the least one.

    Rows with a NULL id are kept, as nothing can name them.
    """
    full = F.coalesce("text", F.lit(""))
    names = {spare(docs, "text_1"): F.xxhash64(full), spare(docs, "text_2"): F.xxhash64(F.lit(1), full)}
    key = ["doc_id", *names]
    kept = near_dups.near_duplicates(docs).filter(F.col("kept") & F.col("doc_id").isNotNull())
    kept = materialize(kept.select("doc_id", *(F.col(c).alias(n) for c, n in zip(("text_1", "text_2"), names))).groupBy(*key).count())
    named = docs.withColumns(names).join(kept.select(*key).hint("merge"), key, "left_semi")
    repeated = kept.filter("count > 1").select(*key)
    if not repeated.isEmpty():
        row = F.struct(*(F.col(c) for c in docs.columns))
        least = named.join(repeated, key, "left_semi").groupBy(*key).agg(F.min(row).alias("row")).select("row.*")
        named = named.join(repeated, key, "left_anti").select(*docs.columns).unionByName(least)
    return named.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str, words: int | None = None) -> DataFrame:
    """All documents, without their passages of ``words`` words that occur elsewhere, too; by default, strings of 400 bytes.

    Characters that lose some of their bytes go as a whole. NULL texts stay NULL; n_chars, where there is one, follows the text.
    """
    cut = spare(docs, "cut")
    left = repeats.remove_repeats(docs, words=words)
    text = F.when(F.col("text").isNotNull(), F.col(cut)["kept_text"])
    columns = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return left.withColumns(columns).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, BYTE_BPE).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language_id", keep_known_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("repeated_passages", partial(drop_repeated_passages, words=PASSAGE_WORDS)),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; the tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder, and deleted when the next is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = materialize(stage(spark, docs, sf_dir))
        if i:
            drop_materialized(docs)
        docs = done
    return docs
