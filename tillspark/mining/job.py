"""One entry for all miners: the same itemsets and rules whichever algorithm runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillspark.mining.apriori import apriori_itemsets
from tillspark.mining.fpgrowth import fpgrowth_itemsets
from tillspark.mining.rules import association_rules
from tillspark.mining.son import son_itemsets
from tillspark.mining.threshold import min_count
from tillspark.runtime import drop_materialized, materialize, materialize_counted
from tillspark.schemas import ITEMSET, RULE, MiningSettings


@dataclass(frozen=True)
class Mined:
    """What one run found: DataFrames of itemsets and rules, and the two numbers behind them."""

    itemsets: DataFrame
    rules: DataFrame
    n_baskets: int
    min_count: int
    settings: MiningSettings


def prepared(baskets: DataFrame) -> DataFrame:
    """Items only: no NULL baskets, no NULL items, no repeats."""
    return baskets.filter(F.col("items").isNotNull()).select(
        F.sort_array(F.array_distinct(F.array_compact("items"))).alias("items")
    )


def mine(baskets: DataFrame, settings: MiningSettings | None = None, **changes) -> Mined:
    """Frequent itemsets and rules of ``baskets`` (a DataFrame with an ``items`` array).

    The baskets are written once to the shared scratch folder for the passes of a run and deleted
    at its end; the itemsets found stay there. The driver sees only counts and the lists of
    itemsets that one counting pass looks for.
    """
    return mine_all(baskets, [settings or MiningSettings(**changes)])[0]


def mine_all(baskets: DataFrame, runs: list[MiningSettings]) -> list[Mined]:
    """Several runs over one stored copy of the baskets. Runs alike in algorithm and support share their itemsets."""
    items, n = materialize_counted(prepared(baskets))
    found: dict[tuple, tuple[DataFrame, int]] = {}
    try:
        for settings in runs if n else []:
            case = settings.algorithm, settings.min_support
            if case not in found:
                found[case] = _itemsets(items, n, settings)
        return [_with_rules(*found.get((settings.algorithm, settings.min_support), (None, 0)), n, settings, items.sparkSession) for settings in runs]
    finally:
        drop_materialized(items)


def _itemsets(items: DataFrame, n: int, settings: MiningSettings) -> tuple[DataFrame, int]:
    """The stored itemsets, and the size of the longest."""
    least = min_count(settings.min_support, n)
    if settings.algorithm == "fpgrowth":
        found = fpgrowth_itemsets(items, least, n)
    elif settings.algorithm == "apriori":
        found = apriori_itemsets(items, least)
    else:
        found = son_itemsets(items, settings.min_support, least, n)
    sizes = Observation()
    found = found.select("items", "freq", (F.col("freq") / F.lit(n)).alias("support"))
    itemsets = materialize(found.observe(sizes, F.max(F.size("items")).alias("longest")))
    return itemsets, sizes.get["longest"] or 0


def _with_rules(itemsets: DataFrame | None, longest: int, n: int, settings: MiningSettings, spark: SparkSession) -> Mined:
    least = min_count(settings.min_support, n)
    if itemsets is None:
        return Mined(spark.createDataFrame([], ITEMSET), spark.createDataFrame([], RULE), 0, least, settings)
    rules = association_rules(
        itemsets, n, settings.min_confidence, settings.max_consequent, settings.min_lift, longest
    )
    return Mined(itemsets, rules, n, least, settings)
