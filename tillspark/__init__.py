"""Market-basket analytics on Spark: retail lines to baskets, itemsets, rules and recommendations."""

from tillspark.mining import Mined, mine
from tillspark.schemas import MiningSettings

__all__ = ["Mined", "MiningSettings", "mine"]
