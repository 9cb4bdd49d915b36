"""Similarity of all pairs of items by the baskets they share, also of items no miner finds frequent.

An item is the set of its baskets. Small baskets are counted whole: as far as the pairs in them stay in
proportion to their items, every pair of items that meets there is counted. Of larger baskets an item brings
only its first few, in one order of baskets, small ones first: two sets whose Jaccard similarity reaches a limit share one
of these. Sizes and positions bound what a pair can still share, and what the pairs left share in
larger baskets is counted exactly. Items with the very same baskets are one class, compared with others once.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.runtime import heavy_keys, materialize, salted_join, scratch

#: Pairs for each entry (an item in a basket) that the baskets counted whole hold at most, taken together.
PAIRS_PER_ENTRY = 16

def _entries(basket_df: DataFrame) -> DataFrame:
    """(item, basket, size) of distinct items; invoices without a number are one basket."""
    items = F.array_distinct(F.array_compact("items"))
    key = F.coalesce(F.concat(F.lit("="), F.col("InvoiceNo")), F.lit("-"))
    return basket_df.select(key.alias("basket"), F.size(items).alias("size"), F.explode(items).alias("item"))


def _whole_size(entries: DataFrame) -> int:
    """The largest size up to which baskets together hold at most ``PAIRS_PER_ENTRY`` pairs for each entry there is."""
    held = entries.groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    pairs = F.sum(F.col("k") * (F.col("size") - 1) / 2).over(W.orderBy("size"))  # one row per size
    sizes = held.select("size", pairs.alias("pairs"), F.sum("k").over(W.partitionBy()).alias("entries"))
    return sizes.filter(F.col("pairs") <= PAIRS_PER_ENTRY * F.col("entries")).agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]


def _prefix_length(num: int, den: int, n: str = "n") -> Column:
    return F.expr(f"{n} - ({n} * {num} + {den - 1}) DIV {den} + 1")


def _prefixes(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(class, n, light, basket, pos): the large baskets among the first n - ceil(limit * n) + 1 of each class, smallest first.

    ``entries`` are those of large baskets; ``light`` counts the small ones of the class, which come before. Baskets are numbered
    inside pieces (size and leading bits of a hash) and shifted by the pieces before, so the baskets of a very common item are
    never sorted in one task.
    """
    h = F.xxhash64("basket")
    length = _prefix_length(num, den)
    cut = entries.filter(F.col("light") < length).withColumns({"h": h, "piece": F.shiftright(h, 56)})
    keys = ["class", "size", "piece"]
    before = W.partitionBy("class").orderBy("size", "piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = (
        cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"), F.first("n").alias("n"), F.first("light").alias("light"))
        .withColumn("before", F.col("light") + F.coalesce(F.sum("held").over(before), F.lit(0)))
        .filter(F.col("before") < length).select(*keys, "before")
    )
    inside = F.row_number().over(W.partitionBy(*keys).orderBy("h", "basket"))
    return (
        cut.join(pieces, keys).withColumn("pos", F.col("before") + inside)
        .filter(F.col("pos") <= length).select("class", "n", "light", "basket", "pos")
    )


def _classes(entries: DataFrame, whole: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item, class, n), the classes (class, n, light) and the heavy items; ``light`` counts baskets of up to ``whole`` items."""
    name = ["n", "h1", "h2"]
    sets = materialize(entries.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("basket")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(1), "basket")).alias("h2"), F.count_if(F.col("size") <= whole).alias("light"),
    ))
    same = materialize(sets.groupBy(*name).agg(
        F.min("item").alias("class"), F.min("light").alias("light"), F.count(F.lit(1)).alias("members")))
    classes = salted_join(sets.drop("light"), same.select(*name, "class"), name, ["item"], heavy=heavy_keys(same, name, "members"))
    return classes.select("item", "class", "n"), same.select("class", "n", "light"), heavy_keys(sets, ["item"], "n")


def item_classes(basket_df: DataFrame) -> DataFrame:
    """(item, class, n): items with the same n baskets have one class, named by the least of them."""
    with scratch(basket_df.sparkSession) as job:
        return job.keep(_classes(materialize(_entries(basket_df)), 0)[0])


def similar_pairs(basket_df: DataFrame, at_least: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes) of all items of ``basket_df``, one row per invoice.

    ``classes``: what ``item_classes`` gives.
    ``pairs``: (product, rec_product, together, jaccard, cosine) of classes whose Jaccard similarity is ``at_least``
    or more, in both directions. Items of one class have similarity 1 and no row here. The limit is taken as the
    decimal written and compared in whole numbers; it lies above 0 and up to 1. NULL baskets and items are left out.
    """
    limit = Fraction(str(at_least))
    if not 0 < limit <= 1:
        raise ValueError("the limit lies above 0 and up to 1")
    num, den = limit.numerator, limit.denominator
    with scratch(basket_df.sparkSession) as job:
        entries = materialize(_entries(basket_df))
        whole = _whole_size(entries)
        classes, shown, heavy_items = _classes(entries, whole)
        classes = job.keep(classes)
        entries = materialize(
            salted_join(entries, shown.withColumnRenamed("class", "item").hint("merge"), ["item"], ["basket"], heavy=heavy_items)
            .withColumnRenamed("item", "class")
        )
        # Counted whole, and the first of the large ones. A small basket has the place of the last small one.
        small = entries.filter(F.col("size") <= whole).select("class", "n", "light", "basket", F.col("light").alias("pos"))
        large = entries.filter(F.col("size") > whole)
        first = materialize(_prefixes(large, num, den))
        kept = small.withColumn("small", F.lit(1)).unionByName(first.withColumn("small", F.lit(0)))
        crowds = first.groupBy("basket").agg(F.count(F.lit(1)).alias("k"))
        side = lambda c, *more: kept.select("basket", *more, *(F.col(x).alias(f"{x}_{c}") for x in ("class", "n", "light", "pos")))
        met = salted_join(
            side("a", "small"), side("b").hint("merge"), ["basket"], ["class_a"], heavy=heavy_keys(crowds, ["basket"], "k")
        ).filter((F.struct("n_a", "class_a") < F.struct("n_b", "class_b")) & (F.col("n_a") * den >= F.col("n_b") * num))
        enough = lambda shared: shared * (num + den) >= (F.col("n_a") + F.col("n_b")) * num
        # A shared basket that was not met is large, comes after the last one met, and is left out of the item whose baskets
        # end first; so there are at most as many as follow the last one met, and as one of the items leaves out.
        left_out = [F.col(f"n_{c}") - F.greatest(f"light_{c}", _prefix_length(num, den, f"n_{c}")) for c in "ab"]
        unmet = F.least(F.col("n_a") - F.col("last_a"), F.col("n_b") - F.col("last_b"), F.greatest(*left_out))
        pair = ["class_a", "class_b", "n_a", "n_b"]
        likely = materialize(
            met.groupBy(*pair, "light_a", "light_b").agg(
                F.count(F.lit(1)).alias("met"), F.sum("small").alias("met_small"), F.max("pos_a").alias("last_a"), F.max("pos_b").alias("last_b"))
            .withColumn("unmet", unmet).filter(enough(F.col("met") + F.col("unmet")))
            .select(*pair, "met", "met_small", "unmet", (F.col("n_a") - F.col("light_a")).alias("large_a"))
        )
        # Most pairs end here: all their shared baskets were met.
        done = likely.filter("unmet = 0").select(*pair, F.col("met").alias("together"))
        open_pairs = likely.filter("unmet > 0").select(*pair, "met_small")
        rows_by_pair = likely.filter("unmet > 0").agg(F.coalesce(F.sum("large_a"), F.lit(0))).first()[0]
        if rows_by_pair:
            rows_by_basket = large.agg(F.sum(F.col("size").cast("double")) / 2).first()[0]
            ids = large.select("class", "basket")
            a, b = ids.withColumnRenamed("class", "class_a"), ids.withColumnRenamed("class", "class_b").hint("merge")
            if rows_by_basket <= rows_by_pair:
                crowds = ids.groupBy("basket").agg(F.count(F.lit(1)).alias("k"))
                rows = salted_join(a, b, ["basket"], ["class_a"], heavy=heavy_keys(crowds, ["basket"], "k"))
            else:
                heavy = heavy_items.select(F.col("item").alias("class_a"))
                rows = salted_join(a, open_pairs.select("class_a", "class_b").hint("merge"), ["class_a"], ["basket"], heavy=heavy)
                rows = rows.join(b, ["class_b", "basket"], "left_semi")
            counted = rows.groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("met_large"))
            done = done.unionByName(
                open_pairs.join(counted, ["class_a", "class_b"], "left")
                .select(*pair, (F.col("met_small") + F.coalesce("met_large", F.lit(0))).alias("together")))
        found = done.filter(enough(F.col("together"))).select(
            "class_a", "class_b", "together",
            (F.col("together") / (F.col("n_a") + F.col("n_b") - F.col("together"))).alias("jaccard"),
            (F.col("together") / F.sqrt(F.col("n_a").cast("double") * F.col("n_b"))).alias("cosine"),
        )
        both = F.explode(F.array(
            F.struct(F.col("class_a").alias("product"), F.col("class_b").alias("rec_product")),
            F.struct(F.col("class_b").alias("product"), F.col("class_a").alias("rec_product")),
        ))
        return job.keep(found.select(both.alias("p"), "together", "jaccard", "cosine").select("p.*", "together", "jaccard", "cosine")), classes
