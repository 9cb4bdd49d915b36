"""Level-wise Apriori: itemsets of size k are looked for among joins of those of size k - 1."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.mining.counting import PAIR_COUNTERS, SLOTS_PER_PASS, by_prefix, count_prefixed, frequent_pairs
from tillspark.operators.profile import item_counts
from tillspark.runtime import materialize, materialize_counted


def candidates(level: DataFrame) -> DataFrame:
    """Next candidates as (prefix, extensions).

    Two itemsets join when they agree in all but their last item; each itemset becomes a prefix
    extended by the later last items of its group, as far as all other subsets are frequent, too: with any one item
    of the prefix left out, the extension must be one of what remains. Groups have no more rows than there are
    frequent items, and a prefix meets one row per item.
    """
    groups = by_prefix(level)
    grown = (
        groups.select(F.col("prefix").alias("stem"), "extensions", F.explode("extensions").alias("last"))
        .select(
            F.concat("stem", F.array("last")).alias("prefix"),
            F.filter("extensions", lambda x: x > F.col("last")).alias("extensions"),
        )
        .filter(F.size("extensions") > 0)
    )
    left_out = grown.select("prefix", "extensions", F.explode("prefix").alias("out")).select(
        "prefix", "extensions", F.array_except("prefix", F.array("out")).alias("rest"))
    others = groups.select(F.col("prefix").alias("rest"), F.col("extensions").alias("frequent"))
    checked = left_out.join(others, "rest", "left").withColumn(
        "fits", F.array_intersect("extensions", F.coalesce("frequent", F.array().cast("array<string>"))))
    return (
        checked.groupBy("prefix").agg(F.collect_list("fits").alias("all_fits"))
        .select("prefix", F.aggregate(
            F.slice("all_fits", 2, F.size("all_fits")), F.get("all_fits", F.lit(0)), lambda a, b: F.array_intersect(a, b)).alias("extensions"))
        .select("prefix", F.sort_array("extensions").alias("extensions")).filter(F.size("extensions") > 0)
    )


def frequent_items(baskets: DataFrame, least: int) -> DataFrame:
    return item_counts(baskets).filter(F.col("freq") >= least)


def _stored(parts: Iterator[DataFrame]) -> DataFrame | None:
    """The parts of one level, each computed once; None when all are empty."""
    kept = [df for df, rows in map(materialize_counted, parts) if rows]
    return reduce(DataFrame.unionByName, kept) if kept else None


def apriori_itemsets(
    baskets: DataFrame, least: int, slots: int = SLOTS_PER_PASS, counters: int = PAIR_COUNTERS,
) -> DataFrame:
    """(items, freq) of all itemsets in at least ``least`` baskets."""
    singles = materialize(
        frequent_items(baskets, least).select(F.array("item").alias("items"), "freq")
    )
    names = sorted(r[0][0] for r in singles.select("items").collect())
    levels = [singles]
    if len(names) > 1:
        level = _stored(iter([frequent_pairs(baskets, names, least, counters)]))
        while level is not None:
            levels.append(level)
            level = _stored(count_prefixed(baskets, candidates(level), least, slots))
    return reduce(DataFrame.unionByName, levels)
