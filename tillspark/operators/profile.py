"""Counts, quality checks and basket statistics of retail lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.functions.text import non_blank
from tillspark.operators.baskets import basket_items


def row_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("row_count"))


def distinct_counts(lines: DataFrame) -> DataFrame:
    """Distinct invoices and descriptions; NULL counts as neither.

    Both come from one list of tagged values, so lines are read once and only distinct values are shuffled.
    """
    tagged = F.array(F.struct(F.lit("i").alias("t"), F.col("InvoiceNo").alias("v")), F.struct(F.lit("d").alias("t"), F.col("Description").alias("v")))
    values = lines.select(F.inline(tagged)).filter("v IS NOT NULL").distinct()
    return values.agg(
        F.count_if(F.col("t") == "i").alias("transaction_count"), F.count_if(F.col("t") == "d").alias("unique_products"),
    )


def average_basket_size(lines: DataFrame) -> DataFrame:
    """Mean number of distinct descriptions per invoice, to 2 places, 0 when there are none."""
    sizes = (
        lines.filter(F.col("Description").isNotNull()).groupBy("InvoiceNo")
        .agg(F.count_distinct("Description").alias("k"))
    )
    return sizes.agg(F.coalesce(F.round(F.avg("k"), 2), F.lit(0.0)).alias("avg_basket_size"))


def transaction_stats(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Row counts before and after cleaning, invoices, products and mean basket size.

    The cleaned lines are scanned and shuffled once, as counts per (invoice, description); everything
    but the raw count follows from those.
    """
    pairs = cleaned.groupBy("InvoiceNo", "Description").agg(F.count("*").alias("k"))
    invoices = pairs.groupBy("InvoiceNo").agg(
        F.sum("k").alias("rows"), F.count("Description").alias("items")
    )
    # The sum is kept so that both groupings start from the same shuffle.
    products = pairs.groupBy("Description").agg(F.sum("k").alias("rows")).filter("rows > 0").agg(F.count("Description"))
    size = F.round(F.avg(F.when(F.col("items") > 0, F.col("items"))), 2)
    return invoices.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("cleaned_row_count"),
        F.count("InvoiceNo").alias("transaction_count"),
        F.coalesce(size, F.lit(0.0)).alias("avg_basket_size"),
    ).select(
        row_count(raw).scalar().alias("raw_row_count"), "cleaned_row_count", "transaction_count",
        products.scalar().alias("unique_products"), "avg_basket_size",
    )


def load_report(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The same counts as (metric, value) rows."""
    return transaction_stats(raw, cleaned).select(
        F.stack(
            F.lit(4),
            F.lit("raw_rows"), F.col("raw_row_count"),
            F.lit("cleaned_rows"), F.col("cleaned_row_count"),
            F.lit("unique_transactions"), F.col("transaction_count"),
            F.lit("unique_products"), F.col("unique_products"),
        ).alias("metric", "value")
    )


def item_frequency(lines: DataFrame) -> DataFrame:
    """Per description, the distinct invoices it is on and its number of lines."""
    return (
        lines.filter(non_blank(F.col("Description"))).groupBy("Description", "InvoiceNo")
        .agg(F.count("*").alias("k"))
        .groupBy("Description")
        .agg(F.count("InvoiceNo").alias("transaction_count"), F.sum("k").alias("row_count"))
    )


def item_counts(basket_df: DataFrame) -> DataFrame:
    """Number of baskets holding each item."""
    return (
        basket_df.select(F.explode(F.array_distinct(F.array_compact("items"))).alias("item"))
        .groupBy("item").agg(F.count("*").alias("freq"))
    )


def most_common_items(basket_df: DataFrame, n: int = 10) -> DataFrame:
    return item_counts(basket_df).orderBy(F.desc("freq"), "item").limit(n)


def duplicate_items(lines: DataFrame) -> DataFrame:
    """Items listed more than once on one invoice."""
    return (
        lines.filter(non_blank(F.col("Description"))).groupBy("InvoiceNo", "Description")
        .agg(F.count("*").alias("DuplicateCount")).filter("DuplicateCount > 1")
    )


def quality_counters(lines: DataFrame) -> DataFrame:
    """NULL and blank descriptions; the sums are NULL on an empty table, as in SQL."""
    d = F.col("Description")

    def ones(condition):
        return F.sum(F.when(condition, 1).otherwise(0))

    return lines.agg(
        F.count("*").alias("TotalRows"),
        ones(d.isNull()).alias("NullDescriptions"),
        ones(F.trim(d) == "").alias("EmptyDescriptions"),
        ones(d.isNull() | (F.trim(d) == "")).alias("InvalidDescriptions"),
    )


def size_counts(lines: DataFrame) -> DataFrame:
    """Number of baskets of each size."""
    return (
        basket_items(lines, trim=False).groupBy("InvoiceNo").agg(F.count("*").alias("ItemCount"))
        .groupBy("ItemCount").agg(F.count("*").alias("TransactionCount"))
    )


def size_distribution(lines: DataFrame) -> DataFrame:
    """Basket sizes with their count and their share of all baskets in percent."""
    sizes = size_counts(lines)
    total = sizes.agg(F.sum("TransactionCount")).scalar()
    return sizes.withColumn(
        "Percentage", F.col("TransactionCount").cast("double") * 100 / total.cast("double")
    )


def basket_statistics(basket_df: DataFrame) -> DataFrame:
    """Baskets, distinct items, and mean, least, greatest and median basket size.

    The median is exact and taken over the table of sizes, which has one row per size, so no task
    sees all baskets. An empty input gives an empty result.
    """
    sizes = basket_df.groupBy(F.size("items").alias("k")).agg(F.count("*").alias("n"))
    items = item_counts(basket_df).agg(F.count("*")).scalar()
    return (
        sizes.agg(
            F.sum("n").alias("total_transactions"),
            F.round(F.sum(F.col("k") * F.col("n")) / F.sum("n"), 2).alias("avg_items"),
            F.min("k").alias("min_items"),
            F.max("k").alias("max_items"),
            F.round(F.percentile("k", 0.5, F.col("n")), 2).alias("median_items"),
        )
        .filter("total_transactions > 0")
        .select("total_transactions", items.alias("unique_items"), "avg_items", "min_items",
                "max_items", "median_items")
    )


def basket_totals(basket_df: DataFrame) -> DataFrame:
    """Number of baskets and mean items per basket, unrounded."""
    return basket_df.agg(
        F.count("*").alias("TotalTransactions"),
        (F.sum(F.size("items")) / F.count("*")).alias("AvgItemsPerTransaction"),
    )


def basket_checksum(lines: DataFrame) -> DataFrame:
    """Rows per invoice and a checksum of its descriptions that ignores their order.

    It adds up 60 bits of a hash of each row, so repeats count.
    """
    return (
        lines.filter(non_blank(F.col("Description"))).groupBy("InvoiceNo")
        .agg(
            F.count("*").alias("ItemCount"),
            F.sum(F.conv(F.substring(F.md5("Description"), 1, 15), 16, 10).cast("decimal(38,0)")).alias("DescriptionChecksum"),
        )
    )


def sample_baskets(basket_df: DataFrame, n: int = 10, seed: int | None = None) -> DataFrame:
    """``n`` random baskets with their size; with a seed the same ones every time."""
    order = F.rand() if seed is None else F.md5(F.concat("InvoiceNo", F.lit(f"/{seed}")))
    return (
        basket_df.withColumn("NumberOfItems", F.size("items"))
        .orderBy(order, "InvoiceNo").limit(n)
    )


def first_baskets(basket_df: DataFrame, n: int | None) -> DataFrame:
    """Baskets in the order of their invoice numbers, the first ``n`` or all."""
    ordered = basket_df.orderBy("InvoiceNo")
    return ordered if n is None else ordered.limit(n)
