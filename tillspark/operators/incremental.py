"""Profile of lines that arrive part by part (such as by month), without reading earlier lines again.

Distinct values get numbers once, in a table that only grows; numbers may leave gaps, at most one for each known value of a part. What a part holds is a set of bitmaps over these numbers, 4 KB
for 32,768 values, and two row counts. The profile of any parts is the union of their bitmaps, so distinct counts
are exact though parts share invoices and products. Loading a part again replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.operators.clean import clean
from tillspark.runtime import exists, materialize, scratch

_VALUES = "kind string, value string, number long"
_BITS = "kind string, bucket long, bits binary, part string"
_ROWS = "raw_row_count long, cleaned_row_count long, part string"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _held(cleaned: DataFrame) -> DataFrame:
    """Distinct (kind, value): invoices, products, baskets (invoices with a product; lines without a number are one), and what is in them."""
    key = F.coalesce(F.concat(F.lit("="), F.col("InvoiceNo")), F.lit("-"))
    known = F.col("Description").isNotNull()
    pair = F.concat(F.length(key).cast("string"), F.lit(":"), key, F.col("Description"))
    kinds = F.array(
        F.struct(F.lit("invoice").alias("kind"), F.col("InvoiceNo").alias("value")),
        F.struct(F.lit("product").alias("kind"), F.col("Description").alias("value")),
        F.struct(F.lit("basket").alias("kind"), F.when(known, key).alias("value")),
        F.struct(F.lit("pair").alias("kind"), pair.alias("value")),
    )
    return cleaned.select(F.explode(kinds).alias("v")).select("v.*").filter("value IS NOT NULL").distinct()


def load_part(lines: DataFrame, folder: str, part: str) -> None:
    """Add raw ``lines`` to the profile under ``folder`` as ``part``, or replace that part.

    One load runs at a time. A load that fails leaves at most numbers that no part uses.
    """
    spark = lines.sparkSession
    with scratch(spark):
        lines = materialize(lines.select("InvoiceNo", "StockCode", "Description", "Quantity", "UnitPrice", "CustomerID"))
        cleaned = clean(lines)
        known = _stored(spark, f"{folder}/values", _VALUES)
        last = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        # Places in the stored table: the part of it in the upper bits, the row there in the lower 33.
        held = materialize(_held(cleaned).join(known, ["kind", "value"], "left").withColumn("place", F.monotonically_increasing_id()))
        part_of = F.shiftright("place", 33)
        new = held.filter("number IS NULL")
        before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        shifts = new.groupBy(part_of.alias("_part")).agg(F.min("place").alias("_first"), F.max("place").alias("_last")).select(
            "_part", (F.lit(last) + 1 + F.coalesce(F.sum(F.col("_last") - F.col("_first") + 1).over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
        numbers = materialize(
            held.withColumn("_part", part_of).join(F.broadcast(shifts), "_part", "left")
            .select("kind", "value", F.coalesce("number", F.col("place") + F.col("_shift")).alias("number"), F.col("number").isNull().alias("new")))
        numbers.filter("new").select("kind", "value", "number").write.mode("append").parquet(f"{folder}/values")
        bits = numbers.groupBy("kind", F.bitmap_bucket_number("number").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
        )
        rows = lines.agg(F.count(F.lit(1)).alias("raw_row_count"), F.lit(part).alias("part")).withColumn(
            "cleaned_row_count", cleaned.agg(F.count(F.lit(1))).scalar()
        )
        _replace_part(bits.withColumn("part", F.lit(part)), f"{folder}/bits", part, _BITS)
        _replace_part(rows.select("raw_row_count", "cleaned_row_count", "part"), f"{folder}/rows", part, _ROWS)


def _replace_part(df: DataFrame, path: str, part: str, schema: str) -> None:
    # A part without rows leaves no folder, so what an earlier load left goes through a row that says nothing.
    empty = df.sparkSession.createDataFrame([(None,) * (len(df.columns) - 1) + (part,)], schema)
    df.unionByName(empty).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def profile(spark: SparkSession, folder: str, parts: list[str] | None = None) -> DataFrame:
    """One row as ``transaction_stats`` gives it, of all loaded parts or the named ones; lines are not read."""
    bits, rows = _stored(spark, f"{folder}/bits", _BITS), _stored(spark, f"{folder}/rows", _ROWS)
    if parts is not None:
        bits, rows = bits.filter(F.col("part").isin(parts)), rows.filter(F.col("part").isin(parts))
    united = bits.filter("bits IS NOT NULL").groupBy("kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    held = united.agg(*(count(k) for k in ("invoice", "product", "basket", "pair")))
    total = lambda c: F.coalesce(rows.agg(F.sum(c)).scalar(), F.lit(0)).alias(c)
    mean = F.coalesce(F.round(F.try_divide(F.col("pair").cast("double"), F.col("basket").cast("double")), 2), F.lit(0.0))
    return held.select(
        total("raw_row_count"), total("cleaned_row_count"), F.col("invoice").alias("transaction_count"),
        F.col("product").alias("unique_products"), mean.alias("avg_basket_size"),
    )
