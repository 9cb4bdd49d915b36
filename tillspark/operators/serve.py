"""What the shop pages show, computed for all products and carts at once.

Stored recommendations have the columns product, rec_product, confidence, support, lift, algorithm
and, per (product, algorithm, rec_product), one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.operators.recommend import cart_classes, join_outside_cart, of_members, rank_within, ranked
from tillspark.runtime import materialize, salted_join, scratch, with_rank


def stored_recommendations(
    recs: DataFrame, catalog: DataFrame, algorithm: str, n: int = 10
) -> DataFrame:
    """The ``n`` best per product, then only those whose two products are in the catalog."""
    names = catalog.select(F.col("description").alias("product"))
    top = ranked(recs).filter(F.col("rank") <= n)
    known = salted_join(top, names, ["product"], ["rec_product"], "left_semi")
    return (
        salted_join(known.withColumnRenamed("product", "p").withColumnRenamed("rec_product", "product"),
                    names, ["product"], ["p"], "left_semi")
        .select(
            F.col("p").alias("product"), F.col("product").alias("rec_product"),
            "confidence", "support", "lift", F.lit(algorithm).alias("algorithm"),
        )
    )


def latest_per_target(stored: DataFrame, n: int = 4) -> DataFrame:
    """The ``n`` best distinct targets by lift per product and algorithm."""
    keys = ["product", "algorithm"]
    best = stored.groupBy(*keys, "rec_product").agg(
        F.max(F.struct("lift", "confidence", "support")).alias("m")
    ).select(*keys, "rec_product", "m.*")
    order = [F.desc("lift"), F.desc("confidence"), F.desc("support"), "rec_product"]
    return best.withColumn("rank", rank_within(keys, order)).filter(F.col("rank") <= n)


def product_page(stored: DataFrame, products: DataFrame, n: int = 4) -> DataFrame:
    """First-degree section of each product page and algorithm, with current prices.

    ``products`` has name and price; targets it lacks are left out.
    """
    prices = products.select(F.col("name").alias("rec_product"), "price")
    return salted_join(latest_per_target(stored, n), prices, ["rec_product"], ["product"]).select(
        "product", "algorithm", "rank", "rec_product", "price", "confidence", "lift"
    )


def also_like(stored: DataFrame, first: int = 4, per_target: int = 6, n: int = 4) -> DataFrame:
    """Second degree: what the first-degree targets recommend, by support.

    The product itself and its first degree are left out; a target reached on several ways counts
    with its best support.
    """
    one = latest_per_target(stored, first).select("product", "algorithm", F.col("rec_product").alias("via"))
    best = stored.groupBy("product", "algorithm", "rec_product").agg(F.max("support").alias("support"))
    two = (
        best.withColumn("at", rank_within(["product", "algorithm"], [F.desc("support"), "rec_product"]))
        .filter(F.col("at") <= per_target)
        .select(F.col("product").alias("via"), "algorithm", "rec_product", "support")
    )
    reached = (
        salted_join(one, two, ["via", "algorithm"], ["product"])
        .filter("rec_product != product")
        .groupBy("product", "algorithm", "rec_product").agg(F.max("support").alias("support"))
        .join(one.withColumnRenamed("via", "rec_product"), ["product", "algorithm", "rec_product"], "left_anti")
    )
    order = [F.desc("support"), "rec_product"]
    return reached.withColumn("rank", rank_within(["product", "algorithm"], order)).filter(F.col("rank") <= n)


def cart_suggestions(
    carts: DataFrame, stored: DataFrame, products: DataFrame, per_item: int = 4, n: int = 4
) -> DataFrame:
    """``n`` suggestions per cart: best targets of its items by lift, then catalog products by name.

    Suggestions are never in the cart and never repeat. ``source`` tells which step gave one. They are found once for all
    carts of the same products.
    """
    with scratch(carts.sparkSession) as job:
        members, kinds = cart_classes(carts)
        return job.keep(of_members(members, _suggestions(kinds, stored, products, per_item, n)))


def _suggestions(inside: DataFrame, stored: DataFrame, products: DataFrame, per_item: int, n: int) -> DataFrame:
    # Per item the best rows over both algorithms.
    order = [F.desc("lift"), F.desc("confidence"), F.desc("support"), "rec_product", "algorithm"]
    best = (
        stored.withColumn("at", rank_within(["product"], order)).filter(F.col("at") <= per_item)
        .groupBy("product", "rec_product").agg(F.max("lift").alias("lift"))
    )
    targets = (
        join_outside_cart(inside, best, "lift", float("inf"))
        .groupBy(F.col("cart_id"), F.col("rec_product").alias("product")).agg(F.max("lift").alias("lift"))
        .filter(F.col("lift") < float("inf"))
        .withColumn("rank", rank_within(["cart_id"], [F.desc("lift"), "product"]))
        .filter(F.col("rank") <= n)
        .select("cart_id", "product", "rank", F.lit("rule").alias("source"))
    )
    targets = materialize(targets)
    return targets.unionByName(_top_up(inside, targets, products, n))


def _top_up(inside: DataFrame, targets: DataFrame, products: DataFrame, n: int) -> DataFrame:
    """For carts short of ``n`` suggestions, the first catalog products not yet in use.

    Only position numbers of a cart's own products are looked at, in their order; it never meets the whole catalog, and no
    row holds a cart.
    """
    names = with_rank(products.select(F.col("name").alias("product")), "product", "at")
    size = names.agg(F.count("*")).scalar()
    full = targets.filter(F.col("rank") == n).select("cart_id")
    used = inside.unionByName(targets.select("cart_id", "product")).join(full, "cart_id", "left_anti")
    has = targets.groupBy("cart_id").agg(F.count("*").alias("has"))
    # A used position less its rank among them is the number of free positions before it, so the k-th free position is
    # k and the number of used ones with fewer than k free before them. What leaves the window are n counts.
    order = W.partitionBy("cart_id").orderBy(F.col("at").asc_nulls_last())
    free_before = salted_join(used, names, ["product"], ["cart_id"], "left").select(
        "cart_id", (F.col("at") - F.row_number().over(order)).alias("free_before"))
    places = [F.struct(F.lit(k - 1).alias("pos"), (k + F.count_if(F.col("free_before") < k)).alias("at")) for k in range(1, n + 1)]
    short = free_before.groupBy("cart_id").agg(F.array(*places).alias("places")).join(has, "cart_id", "left")
    free = (
        short.select("cart_id", F.coalesce("has", F.lit(0)).alias("has"), F.explode("places").alias("place"))
        .select("cart_id", "has", "place.*").filter((F.col("pos") < n - F.col("has")) & (F.col("at") <= size))
    )
    return salted_join(free, names, ["at"], ["cart_id"]).select(
        "cart_id", "product", (F.col("has") + F.col("pos") + 1).cast("int").alias("rank"),
        F.lit("catalog").alias("source"),
    )
