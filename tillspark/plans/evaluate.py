"""How well recommendations find an item held out of unseen baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.operators.recommend import cross_sell


def split_baskets(baskets: DataFrame, test_share: float = 0.2, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the invoice number, the same split on every run.

    Baskets without an invoice number are for training.
    """
    digest = F.conv(F.substring(F.md5(F.concat("InvoiceNo", F.lit(f"/{seed}"))), 1, 8), 16, 10).cast("long")
    is_test = F.coalesce(digest < int(test_share * 2**32), F.lit(False))
    return baskets.filter(~is_test), baskets.filter(is_test)


def hit_rate(test: DataFrame, recs: DataFrame, n: int = 5, seed: int = 7) -> DataFrame:
    """Share of test baskets whose held-out item is among the ``n`` best for their other items.

    The item held out is the one with the least hash, so the choice does not follow the alphabet.
    """
    order = F.transform(
        "items", lambda i: F.struct(F.md5(F.concat(i, "InvoiceNo", F.lit(f"/{seed}"))).alias("h"), i.alias("i"))
    )
    held = test.filter(F.size("items") >= 2).withColumn("held", F.array_min(order)["i"])
    carts = held.select(
        F.col("InvoiceNo").alias("cart_id"), F.explode(F.array_remove("items", F.col("held"))).alias("product")
    )
    hits = cross_sell(carts, recs, n).select("cart_id", F.col("product").alias("held"), F.lit(1).alias("hit"))
    return (
        held.select(F.col("InvoiceNo").alias("cart_id"), "held").join(hits, ["cart_id", "held"], "left")
        .agg(F.count("*").alias("baskets"), F.count("hit").alias("hits"))
        .withColumn("hit_rate", F.try_divide(F.col("hits").cast("double"), F.col("baskets")))
    )
