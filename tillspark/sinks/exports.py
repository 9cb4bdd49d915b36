"""Text forms of results for other programs. Each is a distributed write, not one driver string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.operators.baskets import as_text, json_rows
from tillspark.schemas import ITEMSET, RECOMMENDATION, RULE


def export_baskets_csv(baskets: DataFrame, path: str, sep: str = ", ") -> None:
    as_text(baskets, sep).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def export_baskets_json(baskets: DataFrame, path: str) -> None:
    json_rows(baskets).write.mode("overwrite").text(path)


def itemsets_csv(itemsets: DataFrame, sep: str = " | ") -> DataFrame:
    return itemsets.select(F.concat_ws(sep, "items").alias("items"), "freq", "support")


def export_itemsets_csv(itemsets: DataFrame, path: str) -> None:
    itemsets_csv(itemsets).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def run_json(run: DataFrame, itemsets: DataFrame, rules: DataFrame) -> DataFrame:
    """A run as JSON lines: one object with its parameters, then one per itemset and rule.

    One object per row, because a single document would have to pass through one task.
    """
    head = run.select(
        F.lit("run").alias("kind"),
        F.to_json(F.struct(
            "algorithm",
            F.struct("min_support", "min_confidence", "transaction_count").alias("parameters"),
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        )).alias("value"),
    )
    parts = [head]
    for kind, df in (("frequent_itemset", itemsets), ("association_rule", rules)):
        parts.append(df.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def export_run_json(run: DataFrame, itemsets: DataFrame, rules: DataFrame, path: str) -> None:
    run_json(run, itemsets, rules).write.mode("overwrite").partitionBy("kind").text(path)


def import_run_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(itemsets, rules) of an exported run."""
    def read(kind, schema):
        text = spark.read.text(path).filter(F.col("kind") == kind)
        return text.select(F.from_json("value", schema).alias("v")).select("v.*")

    return read("frequent_itemset", ITEMSET), read("association_rule", RULE)


def save_state(itemsets: DataFrame, rules: DataFrame, recs: DataFrame, folder: str) -> None:
    """The three tables behind recommendations, as JSON."""
    for name, df in (("itemsets", itemsets), ("rules", rules), ("recommendations", recs)):
        df.write.mode("overwrite").json(f"{folder}/{name}")


def load_state(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.read.schema(ITEMSET).json(f"{folder}/itemsets"),
        spark.read.schema(RULE).json(f"{folder}/rules"),
        spark.read.schema(RECOMMENDATION).json(f"{folder}/recommendations"),
    )
