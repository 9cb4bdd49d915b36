"""Association rules from frequent itemsets, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.runtime import materialize_counted

#: Itemsets of up to so many items have at most 62 splits, which are listed at once.
SHORT = 6


def _splits(itemsets: DataFrame, max_consequent: int | None) -> DataFrame:
    """Every itemset of two or more items, split into antecedents and consequents."""
    sets = itemsets.filter(F.size("items") >= 2)
    if max_consequent == 1:
        return sets.select(
            "items", "freq", F.explode("items").alias("one")
        ).select(
            F.filter("items", lambda x: x != F.col("one")).alias("antecedents"),
            F.array("one").alias("consequents"), "freq",
        )
    if max_consequent is not None:
        # Consequents of 1 to max_consequent items, each grown from a shorter one by later items.
        places = F.sequence(F.lit(0), F.size("items") - 1)
        level = F.transform(places, lambda i: F.array(i))
        levels = [level]
        for _ in range(max_consequent - 1):
            level = F.flatten(F.transform(level, lambda c: F.transform(
                F.filter(places, lambda j: j > F.element_at(c, -1)), lambda j: F.concat(c, F.array(j)))))
            levels.append(level)
        chosen = F.filter(F.concat(*levels), lambda c: F.size(c) < F.size("items"))
        return sets.select("items", "freq", F.explode(chosen).alias("chosen")).select(
            F.filter("items", lambda x, i: ~F.array_contains("chosen", i)).alias("antecedents"),
            F.transform("chosen", lambda i: F.get("items", i)).alias("consequents"), "freq")
    # One bit per item.
    masks = sets.withColumn("mask", F.expr("explode(sequence(1L, shiftleft(1L, size(items)) - 2))"))
    return masks.select(
        F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 1)").alias("antecedents"),
        F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 0)").alias("consequents"),
        "freq",
    )


def _grown(itemsets: DataFrame, sides: DataFrame, min_confidence: float, max_consequent: int | None, longest: int) -> DataFrame:
    """(antecedents, consequents, freq, freq_a, confidence) of the rules of long itemsets, level by level.

    What a consequent gains its antecedent loses, so the antecedent gets more frequent and the confidence falls. A
    consequent is therefore grown, by items after its last one, only while the rule with it is confident enough.
    """
    a = sides.select(F.col("items").alias("antecedents"), F.col("freq").alias("freq_a"))
    ends = F.sequence(F.lit(0), F.size("items") - 1)
    open_rows, levels = itemsets.select("items", "freq", F.array().cast("array<int>").alias("chosen")), []
    for _ in range(min(longest - 1, max_consequent or longest)):
        one_more = open_rows.select("items", "freq", "chosen", F.explode(
            F.filter(ends, lambda j: j > F.coalesce(F.try_element_at("chosen", F.lit(-1)), F.lit(-1)))).alias("next"))
        tried = one_more.select("items", "freq", F.concat("chosen", F.array("next")).alias("chosen")).filter(F.size("chosen") < F.size("items"))
        tried = tried.withColumn("antecedents", F.filter("items", lambda x, i: ~F.array_contains("chosen", i)))
        level, rows = materialize_counted(
            tried.join(a, "antecedents").withColumn("confidence", F.col("freq") / F.col("freq_a")).filter(F.col("confidence") >= min_confidence))
        if not rows:
            break
        levels.append(level.select(
            "antecedents", F.transform("chosen", lambda i: F.get("items", i)).alias("consequents"), "freq", "freq_a", "confidence"))
        open_rows = level
    return reduce(DataFrame.unionByName, levels) if levels else None


def association_rules(
    itemsets: DataFrame, n: int, min_confidence: float, max_consequent: int | None = None,
    min_lift: float | None = None, longest: int | None = None,
) -> DataFrame:
    """Rules A -> C with confidence of at least ``min_confidence``, metrics unrounded.

    Itemsets carry sorted ``items`` and their ``freq`` among ``n`` baskets. The counts of both sides
    come from equi-joins on the sorted arrays; confidence is tested before the second join. Itemsets of up to ``SHORT`` items
    list all their splits at once; consequents of longer ones are grown, as far as rules with them are confident enough.
    ``longest`` is the size of the longest itemset, where it is known.
    """
    if longest is None:
        longest = itemsets.agg(F.max(F.size("items"))).first()[0]
    sides = itemsets.select("items", "freq")
    a = sides.select(F.col("items").alias("antecedents"), F.col("freq").alias("freq_a"))
    c = sides.select(F.col("items").alias("consequents"), F.col("freq").alias("freq_c"))
    short = itemsets if (longest or 0) <= SHORT else itemsets.filter(F.size("items") <= SHORT)
    rules = (
        _splits(short, max_consequent).join(a, "antecedents")
        .withColumn("confidence", F.col("freq") / F.col("freq_a"))
        .filter(F.col("confidence") >= min_confidence)
    )
    if (longest or 0) > SHORT:
        grown = _grown(itemsets.filter(F.size("items") > SHORT), sides, min_confidence, max_consequent, longest)
        rules = rules if grown is None else rules.unionByName(grown)
    rules = (
        rules
        .join(c, "consequents", "left")
        .withColumn("n", F.lit(n).cast("long"))
        .withColumn("support", F.col("freq") / F.col("n"))
        .withColumn(
            "lift", F.coalesce(F.col("confidence") / (F.col("freq_c") / F.col("n")), F.lit(0.0))
        )
        .select("antecedents", "consequents", "confidence", "support", "lift",
                "freq", "freq_a", "freq_c", "n")
    )
    return rules if min_lift is None else with_min_lift(rules, min_lift)


def with_min_lift(rules: DataFrame, min_lift: float) -> DataFrame:
    return rules.filter(F.col("lift") >= min_lift)


def rule_order():
    """Best lift first; a total order, so that top rules do not depend on the run."""
    return [F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedents", "consequents"]


def top_rules(rules: DataFrame, n: int = 10) -> DataFrame:
    return rules.orderBy(*rule_order()).limit(n)


def top_itemsets(itemsets: DataFrame, n: int = 10) -> DataFrame:
    return itemsets.orderBy(F.desc("support"), "items").limit(n)


def itemsets_of_size(itemsets: DataFrame, k: int) -> DataFrame:
    return itemsets.filter(F.size("items") == k)
