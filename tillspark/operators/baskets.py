"""Baskets: the set of distinct items on each invoice.

The distinct (invoice, item) pairs come first. That shuffle is keyed by both columns and
de-duplicates on the map side, so an invoice that holds a large share of all lines (for instance
lines without an invoice number) is spread over many tasks, and what reaches the task that
gathers one basket is never more than the items of that basket. Lines with a ``key`` of their invoice, as those of order tables,
need no shuffle of pairs: they lie together by it, or meet as sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.functions.text import non_blank, strip
from tillspark.runtime import materialize, salted_join


def _invoice_items(lines: DataFrame, trim: bool, fold_case: bool, *more: str) -> DataFrame:
    item = F.col("Description")
    item = strip(item) if trim else item
    item = F.lower(item) if fold_case else item
    return lines.filter(non_blank(F.col("Description"))).select(*more, "InvoiceNo", item.alias("item"))


def basket_items(lines: DataFrame, trim: bool = True, fold_case: bool = False) -> DataFrame:
    """Distinct (InvoiceNo, item) rows with a non-blank item."""
    return _invoice_items(lines, trim, fold_case).distinct()


def baskets(
    lines: DataFrame, min_items: int = 2, trim: bool = True, fold_case: bool = False, key: str | None = None
) -> DataFrame:
    """One row per invoice with its items, sorted; only baskets of at least ``min_items``.

    ``key`` names a column of which each invoice has one value, and few invoices share one. Lines that lie together by it
    become baskets where they are; elsewhere sets of items meet in one shuffle, made of the lines of a task first.
    """
    if key is not None:
        gathered = (
            _invoice_items(lines, trim, fold_case, key).groupBy(key, "InvoiceNo")
            .agg(F.sort_array(F.collect_set("item")).alias("items")).drop(key)
        )
    else:
        gathered = (
            basket_items(lines, trim, fold_case).groupBy("InvoiceNo")
            .agg(F.sort_array(F.collect_list("item")).alias("items"))
        )
    return at_least(gathered, min_items) if min_items > 1 else gathered


def frequent_transactions(lines: DataFrame, min_count: int, min_items: int = 2) -> DataFrame:
    """Mining baskets without the items on fewer than ``min_count`` of them, most frequent item first.

    The baskets are built and stored once; counting and filtering read that table, not the lines.
    """
    stored = materialize(baskets(lines, min_items))
    pairs = stored.select("InvoiceNo", F.explode("items").alias("item"))
    counts = pairs.groupBy("item").agg(F.count("*").alias("freq")).filter(F.col("freq") >= min_count)
    return (
        salted_join(pairs, counts, ["item"], ["InvoiceNo"])
        .groupBy("InvoiceNo")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("f"), "item"))).alias("rows"))
        .select("InvoiceNo", F.col("rows.item").alias("items"))
    )


def at_least(basket_df: DataFrame, min_items: int) -> DataFrame:
    return basket_df.filter(F.size("items") >= min_items)


def more_than(basket_df: DataFrame, n: int) -> DataFrame:
    return basket_df.filter(F.size("items") > n)


def containing(basket_df: DataFrame, text: str, exact: bool = True) -> DataFrame:
    """Baskets with the item ``text``, or with an item holding it as a part."""
    if exact:
        return basket_df.filter(F.array_contains("items", text))
    return basket_df.filter(F.exists("items", lambda i: F.contains(i, F.lit(text))))


def as_text(basket_df: DataFrame, sep: str = ", ", name: str = "Items") -> DataFrame:
    return basket_df.select("InvoiceNo", F.array_join("items", sep).alias(name))


def as_json(lines: DataFrame) -> DataFrame:
    """Items of each invoice as a JSON array, repeated items kept.

    Equal items are counted before the shuffle by invoice and repeated after it.
    """
    return (
        lines.filter(non_blank(F.col("Description"))).groupBy("InvoiceNo", "Description")
        .agg(F.count("*").cast("int").alias("n"))
        .groupBy("InvoiceNo").agg(F.sort_array(F.collect_list(F.struct("Description", "n"))).alias("runs"))
        .select(
            "InvoiceNo",
            F.to_json(
                F.flatten(F.transform("runs", lambda r: F.array_repeat(r["Description"], r["n"])))
            ).alias("ItemsJSON"),
        )
    )


def json_rows(basket_df: DataFrame) -> DataFrame:
    """One JSON object per basket."""
    return basket_df.select(F.to_json(F.struct("InvoiceNo", F.col("items").alias("Items"))).alias("value"))


def with_size_stats(basket_df: DataFrame) -> DataFrame:
    """Baskets with their size and the mean, least and greatest size over all baskets.

    The three numbers are one scalar subquery, not a window over everything.
    """
    size = F.size("items")
    stats = basket_df.agg(
        F.struct(
            F.avg(size).alias("a"), F.min(size).cast("double").alias("b"),
            F.max(size).cast("double").alias("c"),
        ).alias("s")
    ).scalar()
    return (
        basket_df.withColumn("s", stats)
        .select(
            "InvoiceNo", "items", F.size("items").alias("ItemCount"),
            F.col("s.a").alias("AvgItemsPerTransaction"), F.col("s.b").alias("MinItemsPerTransaction"),
            F.col("s.c").alias("MaxItemsPerTransaction"),
        )
    )


def with_item_frequencies(lines: DataFrame) -> DataFrame:
    """Baskets with, for each item in order, the number of invoices it is on.

    Items and frequencies meet before the baskets are gathered: the distinct pairs are stored once,
    counted per item, joined to the counts and grouped.
    """
    pairs = materialize(basket_items(lines, trim=False))
    freqs = pairs.groupBy("item").agg(F.count("InvoiceNo").alias("transaction_count"))
    return (
        salted_join(pairs, freqs, ["item"], ["InvoiceNo"])
        .groupBy("InvoiceNo")
        .agg(F.sort_array(F.collect_list(F.struct("item", "transaction_count"))).alias("rows"))
        .select(
            "InvoiceNo", F.col("rows.item").alias("items"),
            F.col("rows.transaction_count").alias("frequencies"),
        )
    )


def basket_view(lines: DataFrame, name: str = "market_basket_transactions") -> DataFrame:
    """Register the baskets, as text, under a name usable from SQL."""
    view = as_text(baskets(lines, min_items=1, trim=False))
    view.createOrReplaceTempView(name)
    return view
