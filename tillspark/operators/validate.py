"""Checks that recompute results from the baskets. Each gives rows (check_name, total, violations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.mining.counting import count_itemsets
from tillspark.mining.job import prepared
from tillspark.runtime import materialize

# How far stored metrics may lie from recomputed ones.
SUPPORT_TOLERANCE = 1e-4
CONFIDENCE_TOLERANCE = 1e-3
LIFT_TOLERANCE = 1e-2


def _result(df: DataFrame, check: str, violation) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.count_if(violation).alias("violations")
    ).select(F.lit(check).alias("check_name"), "total", "violations")


def recount(baskets: DataFrame, itemsets: DataFrame) -> DataFrame:
    """(items, counted) for each given itemset, 0 for those in no basket."""
    wanted = materialize(itemsets.select(F.sort_array("items").alias("items")).distinct())
    counted = count_itemsets(materialize(prepared(baskets)), wanted)
    return wanted.join(counted, "items", "left").select(
        "items", F.coalesce("freq", F.lit(0)).alias("counted")
    )


def check_itemsets(baskets: DataFrame, itemsets: DataFrame, n: int) -> DataFrame:
    """Every itemset counted again: equal count, and support within tolerance."""
    sets = itemsets.select(F.sort_array("items").alias("items"), "freq", "support")
    bad = (F.col("counted") != F.col("freq")) | (
        F.abs(F.col("counted") / F.lit(n) - F.col("support")) >= SUPPORT_TOLERANCE
    )
    return _result(sets.join(recount(baskets, sets), "items"), "itemset_recount", bad)


def check_rules(baskets: DataFrame, rules: DataFrame, n: int) -> DataFrame:
    """Support, confidence and lift of every rule from fresh counts of its three itemsets."""
    rules = materialize(rules).select(
        F.sort_array("antecedents").alias("a"), F.sort_array("consequents").alias("c"),
        F.sort_array(F.array_union("antecedents", "consequents")).alias("ac"),
        "support", "confidence", "lift",
    )
    sides = [rules.select(F.col(s).alias("items")) for s in ("a", "c", "ac")]
    counts = materialize(recount(baskets, sides[0].union(sides[1]).union(sides[2])))
    fresh = rules
    for s in ("a", "c", "ac"):
        fresh = fresh.join(
            counts.select(F.col("items").alias(s), F.col("counted").alias(f"n_{s}")), s
        )
    zero = F.lit(0.0)
    confidence = F.when(F.col("n_a") > 0, F.col("n_ac") / F.col("n_a")).otherwise(zero)
    lift = F.when(F.col("n_c") > 0, confidence / (F.col("n_c") / F.lit(n))).otherwise(zero)
    bad = (
        (F.abs(F.col("n_ac") / F.lit(n) - F.col("support")) >= SUPPORT_TOLERANCE)
        | (F.abs(confidence - F.col("confidence")) >= CONFIDENCE_TOLERANCE)
        | (F.abs(lift - F.col("lift")) >= LIFT_TOLERANCE)
    )
    return _result(fresh, "rule_recompute", bad)


def check_thresholds(rules: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules below the thresholds they were mined with."""
    return _result(
        rules, "rule_min_support", F.col("support") < min_support - SUPPORT_TOLERANCE
    ).unionByName(_result(
        rules, "rule_min_confidence", F.col("confidence") < min_confidence - CONFIDENCE_TOLERANCE
    ))


def check_unique(itemsets: DataFrame) -> DataFrame:
    """Itemsets listed more than once, in whatever order of items."""
    groups = itemsets.groupBy(F.sort_array("items").alias("items")).agg(F.count("*").alias("k"))
    return groups.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("violations"),
    ).select(F.lit("itemset_unique").alias("check_name"), "total", "violations")


def positive_share(rules: DataFrame) -> DataFrame:
    """Share of rules with lift above 1, NULL when there are no rules."""
    return rules.agg(
        F.count("*").alias("rules"), F.count_if(F.col("lift") > 1).alias("positive"),
        F.avg((F.col("lift") > 1).cast("int")).alias("positive_share"),
    )


def _keyed(rules: DataFrame, *metrics: str) -> DataFrame:
    return rules.select(
        F.sort_array("antecedents").alias("a"), F.sort_array("consequents").alias("c"), *metrics
    )


def rule_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rules of two runs: how many each has, how many both, and the overlap in percent."""
    both = (
        _keyed(left).distinct().withColumn("l", F.lit(1))
        .join(_keyed(right).distinct().withColumn("r", F.lit(1)), ["a", "c"], "full_outer")
    )
    counts = both.agg(
        F.count("l").alias("left_rules"), F.count("r").alias("right_rules"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"),
    )
    return counts.select(
        "left_rules", "right_rules", "common",
        (F.col("left_rules") - F.col("common")).alias("left_only"),
        (F.col("right_rules") - F.col("common")).alias("right_only"),
        F.try_divide(F.col("common") * 100.0, F.greatest("left_rules", "right_rules").cast("double"))
        .alias("overlap_pct"),
    )


def rule_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rules only one of two runs has."""
    a, b = _keyed(left).distinct(), _keyed(right).distinct()
    return a.subtract(b).withColumn("only_in", F.lit("left")).unionByName(
        b.subtract(a).withColumn("only_in", F.lit("right"))
    ).select(F.col("a").alias("antecedents"), F.col("c").alias("consequents"), "only_in")


def check_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Confidence and lift of the rules both runs have."""
    metrics = ("confidence", "lift")
    r = _keyed(right, *metrics).withColumnsRenamed({"confidence": "confidence_r", "lift": "lift_r"})
    bad = (F.abs(F.col("confidence") - F.col("confidence_r")) >= CONFIDENCE_TOLERANCE) | (
        F.abs(F.col("lift") - F.col("lift_r")) >= LIFT_TOLERANCE
    )
    return _result(_keyed(left, *metrics).join(r, ["a", "c"]), "rule_agreement", bad)


def recommendation_evidence(stored: DataFrame, rules: DataFrame, itemsets: DataFrame) -> DataFrame:
    """For each recommendation what backs it: a rule, else an itemset, else NONE.

    A rule or itemset backs a pair when it holds both products. Its items are paired up inside its own row, each
    distinct set once, so a popular product is never a key by itself.
    """
    pairs = stored.select("product", "rec_product").distinct()
    sets = rules.select(
        F.sort_array(F.array_union("antecedents", "consequents")).alias("items"), F.lit(2).alias("strength")
    ).unionByName(itemsets.select(F.sort_array("items").alias("items"), F.lit(1).alias("strength")))
    once = sets.groupBy("items").agg(F.max("strength").alias("strength"))
    holders = (
        once.select("items", "strength", F.explode("items").alias("product"))
        .select("strength", "product", F.explode("items").alias("rec_product"))
    )
    found = holders.groupBy("product", "rec_product").agg(F.max("strength").alias("strength"))
    backed = F.when(F.col("strength") == 2, "rule").when(F.col("strength") == 1, "itemset").otherwise("NONE")
    return pairs.join(found, ["product", "rec_product"], "left").select(
        "product", "rec_product", backed.alias("backed_by")
    )


def check_recommendations(stored: DataFrame, rules: DataFrame, itemsets: DataFrame) -> DataFrame:
    return _result(
        recommendation_evidence(stored, rules, itemsets), "recommendation_backed",
        F.col("backed_by") == "NONE",
    )


def check_baskets(baskets: DataFrame, min_items: int = 2) -> DataFrame:
    """Baskets with repeated items, and baskets that are too small."""
    return _result(
        baskets, "basket_distinct_items", F.size("items") != F.size(F.array_distinct("items"))
    ).unionByName(_result(baskets, "basket_min_items", F.size("items") < min_items))


