"""Recommendations from rules and itemsets, in long form: one row per (product, rec_product).

Tables of recommendations grow with rules and itemsets, not with the number of sales. Ranks that are
cut at a few rows use ``row_number`` with a filter, which Spark turns into a partial top-k before
its shuffle, so a product with very many recommendations is not sorted whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.functions.metrics import weight
from tillspark.functions.text import holds_text
from tillspark.mining.rules import rule_order
from tillspark.runtime import materialize, salted_join, scratch

METRICS = ["confidence", "support", "lift"]


def rank_within(keys: list[str], order: list, name: str = "rank") -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias(name)


def best_order() -> list:
    return [F.desc("lift"), F.desc("confidence"), F.desc("support"), "rec_product"]


# ---- building -----------------------------------------------------------------------------

def rule_recommendations(rules: DataFrame) -> DataFrame:
    """Each antecedent recommends each consequent with the metrics of the rule, one row per rule."""
    return (
        rules.select(F.explode("antecedents").alias("product"), "consequents", *METRICS)
        .select("product", F.explode("consequents").alias("rec_product"), *METRICS,
                F.lit("rule").alias("source"))
    )


def itemset_recommendations(itemsets: DataFrame, complete: bool = False) -> DataFrame:
    """Items of one itemset recommend each other with the greatest support they share.

    In a complete list, as the miners give it, that is the support of the two-item set itself;
    ``complete=True`` then reads no others. Lists that lack subsets of their itemsets need the default.
    """
    sets = itemsets.filter(F.size("items") == 2 if complete else F.size("items") >= 2)
    both = (
        sets.select(F.explode("items").alias("product"), "items", "support")
        .select("product", F.explode("items").alias("rec_product"), "support")
        .filter("product != rec_product")
    )
    return both.groupBy("product", "rec_product").agg(F.max("support").alias("support")).select(
        "product", "rec_product", F.lit(0.0).alias("confidence"), "support",
        F.lit(0.0).alias("lift"), F.lit("itemset").alias("source"),
    )


def all_recommendations(
    itemsets: DataFrame, rules: DataFrame, dedupe: bool = True, complete: bool = False
) -> DataFrame:
    """Recommendations of rules, then of itemsets for pairs without a rule.

    ``dedupe`` keeps the best row per pair; without it a pair has one row per rule.
    """
    from_rules = rule_recommendations(rules)
    from_sets = itemset_recommendations(itemsets, complete)
    if dedupe:
        # A rule has a confidence above 0, so it always beats the itemset row of its pair.
        return best_per_pair(from_rules.unionByName(from_sets))
    covered = from_rules.select("product", "rec_product").distinct()
    return from_rules.unionByName(
        from_sets.join(covered, ["product", "rec_product"], "left_anti")
    )


def best_per_pair(recs: DataFrame, keys: tuple[str, ...] = ("product", "rec_product")) -> DataFrame:
    """The row with the greatest lift, then confidence, then support of each pair."""
    best = F.max(F.struct("lift", "confidence", "support", "source")).alias("m")
    return recs.groupBy(*keys).agg(best).select(
        *keys, "m.confidence", "m.support", "m.lift", "m.source"
    )


def ranked(recs: DataFrame, keys: tuple[str, ...] = ("product",)) -> DataFrame:
    """Recommendations with their rank for each product, best first."""
    return recs.withColumn("rank", rank_within(list(keys), best_order()))


# ---- reading ------------------------------------------------------------------------------

def top_recommendations(recs: DataFrame, n: int = 5, product: str | None = None) -> DataFrame:
    """The ``n`` best of every product, or of one."""
    chosen = recs if product is None else recs.filter(F.col("product") == product)
    return ranked(chosen).filter(F.col("rank") <= n)


def bought_together(recs: DataFrame, product: str | None = None) -> DataFrame:
    return top_recommendations(recs, 4, product)


def bundles(itemsets: DataFrame, min_items: int = 2, max_items: int = 5, n: int = 10) -> DataFrame:
    """The most frequent itemsets of two to five items."""
    return (
        itemsets.filter(F.size("items").between(min_items, max_items))
        .orderBy(F.desc("support"), "items").limit(n).select("items", "support", "freq")
    )


def rules_for_product(rules: DataFrame, product: str, n: int = 5) -> DataFrame:
    """Best rules with the product on either side."""
    either = F.array_contains("antecedents", product) | F.array_contains("consequents", product)
    return rules.filter(either).orderBy(*rule_order()).limit(n)


def rules_with_text(rules: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Rules with the text in their antecedents or consequents; with a ``limit`` the best of them."""
    found = rules.filter(
        holds_text(F.col("antecedents"), text) | holds_text(F.col("consequents"), text)
    )
    return found if limit is None else found.orderBy(*rule_order()).limit(limit)


def itemsets_with_text(
    itemsets: DataFrame, text: str = "", min_items: int = 2, limit: int | None = None
) -> DataFrame:
    """Itemsets of some size with the text in their items; with a ``limit`` the most frequent of them."""
    found = itemsets.filter((F.size("items") >= min_items) & holds_text(F.col("items"), text))
    return found if limit is None else found.orderBy(F.desc("support"), "items").limit(limit)


def recommendations_with_text(stored: DataFrame, text: str) -> DataFrame:
    """Stored recommendations with the text in the row as shown."""
    shown = F.concat_ws(" ", "product", "rec_product", "algorithm")
    return stored.filter(holds_text(shown, text))


# ---- carts --------------------------------------------------------------------------------

# Scores are added up as whole numbers of this unit, so they do not depend on the order of additions.
SCORE_UNITS = 1e9


def cart_classes(carts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, kinds): carts of the very same products have one answer, worked out once for the class they are.

    ``members``: (cart_id, n, h1, h2), where the last three name the class. ``kinds``: (cart_id, product) rows as of carts, with
    a struct of the three as ``cart_id``. Both are stored. No row holds a cart, and a cart without an id is one, too.
    """
    inside = materialize(carts.select("cart_id", "product").distinct())
    members = materialize(inside.groupBy("cart_id").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("product")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(1), "product")).alias("h2"),
    ))
    key = F.coalesce(F.concat(F.lit("="), F.col("cart_id").cast("string")), F.lit("-")).alias("key")
    chosen = members.groupBy("n", "h1", "h2").agg(F.min(key).alias("key"))
    kinds = inside.select(key, "product").join(chosen, "key")
    return members, materialize(kinds.select(F.struct("n", "h1", "h2").alias("cart_id"), "product"))


def of_members(members: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers of classes, with their ``cart_id`` as made by ``cart_classes``, as rows of the carts themselves."""
    named = answers.select("cart_id.*", *(c for c in answers.columns if c != "cart_id"))
    return members.join(named, ["n", "h1", "h2"]).drop("n", "h1", "h2")


def join_outside_cart(carts: DataFrame, pairs: DataFrame, value: str, marker) -> DataFrame:
    """(cart_id, rec_product, value) for every pair whose product is in the cart, items in it marked.

    Every target also points to itself with the ``marker`` value. A cart item then meets its own
    marker in the same join, and one grouping tells which targets are in the cart, without a second
    scan of the carts.
    """
    marks = pairs.select("rec_product").distinct().select(
        F.col("rec_product").alias("product"), "rec_product", F.lit(marker).alias(value)
    )
    inside = carts.select("cart_id", "product").distinct()
    return salted_join(
        inside, pairs.select("product", "rec_product", value).unionByName(marks), ["product"], ["cart_id"]
    ).select("cart_id", "rec_product", value)


def cart_scores(carts: DataFrame, recs: DataFrame) -> DataFrame:
    """Every product recommended by a product of the cart but not in it, with its summed weight.

    Weights are added up per pair of products before they meet the carts.
    """
    units = F.round(weight(F.col("lift"), F.col("support")) * SCORE_UNITS).cast("long")
    pairs = recs.groupBy("product", "rec_product").agg(F.sum(units).alias("units"))
    return (
        join_outside_cart(carts, pairs, "units", None)
        .groupBy(F.col("cart_id"), F.col("rec_product").alias("product"))
        .agg(F.sum("units").alias("units"), F.bool_or(F.col("units").isNull()).alias("inside"))
        .filter("NOT inside").drop("inside")
    )


def cross_sell(carts: DataFrame, recs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best products to add to each cart."""
    with scratch(carts.sparkSession) as job:
        members, kinds = cart_classes(carts)
        best = (
            cart_scores(kinds, recs)
            .withColumn("rank", rank_within(["cart_id"], [F.desc("units"), "product"]))
            .filter(F.col("rank") <= n)
        )
        return job.keep(of_members(members, best).select(
            "cart_id", "product", F.round(F.col("units") / SCORE_UNITS, 4).alias("score"), "rank"))


# ---- similarity ---------------------------------------------------------------------------

def similar_items(itemsets: DataFrame, n: int | None = None) -> DataFrame:
    """Co-occurrence similarity of items frequent together: Jaccard and cosine of their baskets."""
    singles = itemsets.filter(F.size("items") == 1).select(
        F.col("items")[0].alias("item"), F.col("freq").alias("f")
    )
    pairs = itemsets.filter(F.size("items") == 2).select("items", "freq")
    both = pairs.select(F.col("items")[0].alias("product"), F.col("items")[1].alias("rec_product"), "freq")
    both = both.unionByName(both.select(
        F.col("rec_product").alias("product"), F.col("product").alias("rec_product"), "freq"
    ))
    similar = (
        both.join(singles.select(F.col("item").alias("product"), F.col("f").alias("fa")), "product")
        .join(singles.select(F.col("item").alias("rec_product"), F.col("f").alias("fb")), "rec_product")
        .select(
            "product", "rec_product", F.col("freq").alias("together"),
            (F.col("freq") / (F.col("fa") + F.col("fb") - F.col("freq"))).alias("jaccard"),
            (F.col("freq") / F.sqrt(F.col("fa").cast("double") * F.col("fb"))).alias("cosine"),
        )
    )
    if n is None:
        return similar
    order = [F.desc("jaccard"), "rec_product"]
    return similar.withColumn("rank", rank_within(["product"], order)).filter(F.col("rank") <= n)


def hybrid_recommendations(
    itemsets: DataFrame, rules: DataFrame, n: int = 5, rule_share: float = 0.5
) -> DataFrame:
    """Blend of two rankings: ``rule_share`` / rank by rules + the rest / rank by similarity.

    A pair that one ranking lacks gets nothing from it.
    """
    by_rule = ranked(best_per_pair(rule_recommendations(rules))).select(
        "product", "rec_product", "confidence", "lift", F.col("rank").alias("r")
    )
    by_similarity = similar_items(itemsets).select(
        "product", "rec_product",
        rank_within(["product"], [F.desc("jaccard"), "rec_product"], "s"),
    )
    part = lambda share, rank: F.coalesce(F.lit(share) / F.col(rank), F.lit(0.0))
    return (
        by_rule.join(by_similarity, ["product", "rec_product"], "full_outer")
        .withColumn("score", part(rule_share, "r") + part(1 - rule_share, "s"))
        .withColumn("rank", rank_within(["product"], [F.desc("score"), "rec_product"]))
        .filter(F.col("rank") <= n)
        .select(
            "product", "rec_product", "confidence", "lift", "score", "rank",
            F.concat(F.lit("Customers who bought "), "product", F.lit(" also bought "), "rec_product")
            .alias("reason"),
        )
    )
