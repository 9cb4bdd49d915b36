"""Frequent itemsets and association rules over baskets.

``counting``, ``fpgrowth`` and ``son`` hold the small functions that run inside tasks; they travel with the
job, so executors need no copy of this package.
"""

from pyspark import cloudpickle

from tillspark.mining import counting, fpgrowth, son
from tillspark.mining.job import Mined, mine, mine_all

for _module in (counting, fpgrowth, son):
    cloudpickle.register_pickle_by_value(_module)

__all__ = ["Mined", "mine", "mine_all"]
