"""Frequent itemsets by FP-Growth, with each kind of basket counted once.

Equal baskets are one path of a tree with their number on it. They are grouped first, so the trees grow with the kinds of baskets, not
with the sales. A path goes to groups of items by its beginnings, and equal beginnings are added up before a task makes the
tree of one group. Where there are more than ``KINDS`` kinds, trees may not fit a worker; the FP-Growth of Spark ML then takes the baskets.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.mining.counting import ITEMSET_COUNTS, flatten, itemset_batch
from tillspark.runtime import drop_materialized, materialize_counted

# Kinds of baskets that the trees of one worker may hold, and groups of items, each a tree.
KINDS, GROUPS = 1 << 21, 64
# Items of paths, and itemsets, sent at a time.
ITEMS_AT_ONCE, ITEMSETS_AT_ONCE = 1 << 20, 10_000


class Tree:
    """Paths of item numbers with their counts; equal beginnings share nodes."""

    def __init__(self):
        self.items, self.parents, self.times = [-1], [0], [0]
        self.child, self.nodes = {}, defaultdict(list)

    def add(self, path, times: int) -> None:
        at = 0
        for item in path:
            node = self.child.get((at, item))
            if node is None:
                node = self.child[at, item] = len(self.items)
                self.items.append(item)
                self.parents.append(at)
                self.times.append(0)
                self.nodes[item].append(node)
            self.times[node] += times
            at = node

    def above(self, node: int) -> list[int]:
        """The items before a node, first one first."""
        path, at = [], self.parents[node]
        while at:
            path.append(self.items[at])
            at = self.parents[at]
        return path[::-1]

    def without_rare(self, item: int, least: int) -> Tree:
        """The tree of what comes before ``item``, less the items that are rare there."""
        counts = Counter()
        for node in self.nodes[item]:
            at, times = self.parents[node], self.times[node]
            while at:
                counts[self.items[at]] += times
                at = self.parents[at]
        kept, smaller = {i for i, n in counts.items() if n >= least}, Tree()
        if kept:
            for node in self.nodes[item]:
                smaller.add([i for i in self.above(node) if i in kept], self.times[node])
        return smaller


def grow(tree: Tree, least: int, last=lambda item: True, after: tuple = ()) -> Iterator[tuple[tuple, int]]:
    """(item numbers, freq) of all frequent itemsets of a tree, ``after`` added to each; ``last`` tells which may end one."""
    for item in tree.nodes:
        freq = sum(tree.times[node] for node in tree.nodes[item]) if last(item) else 0
        if freq >= least:
            found = (item, *after)
            yield found, freq
            yield from grow(tree.without_rare(item, least), least, after=found)


def paths(vocabulary: pa.Array, groups: int):
    """Turns (items, times) into (group, path, times): for each group the beginning of the basket up to its last item of the group."""
    def run(batches):
        groups_of, ends, flat, times = [], [0], [], []

        def out():
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(groups_of, pa.int32()), lists, pa.array(times, pa.int64())], ["grp", "path", "times"])

        for batch in batches:
            n_rows, rows, ids = flatten(batch.column(0), vocabulary)
            order = np.lexsort((ids, rows))
            starts = np.searchsorted(rows, np.arange(n_rows + 1)).tolist()
            ids = ids[order].tolist()
            for at, n in enumerate(batch.column(1).to_pylist()):
                path, seen = ids[starts[at]:starts[at + 1]], set()
                for end in range(len(path), 0, -1):
                    group = path[end - 1] % groups
                    if group not in seen:
                        seen.add(group)
                        groups_of.append(group)
                        flat += path[:end]
                        ends.append(len(flat))
                        times.append(n)
                        if len(flat) > ITEMS_AT_ONCE:
                            yield out()
                            groups_of, ends, flat, times = [], [0], [], []
                    if len(seen) == groups:
                        break
        if times:
            yield out()

    return run


def tree_of_group(vocabulary: pa.Array, groups: int, least: int):
    """The task of one group: the frequent itemsets whose last item is of the group."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree, found = key[0].as_py(), Tree(), []
        for batch in batches:
            for path, times in zip(batch.column("path").to_pylist(), batch.column("times").to_pylist()):
                tree.add(path, times)
        for itemset in grow(tree, least, lambda item: item % groups == group):
            found.append(itemset)
            if len(found) == ITEMSETS_AT_ONCE:
                yield itemset_batch([s for s, _ in found], [f for _, f in found], vocabulary)
                found = []
        yield itemset_batch([s for s, _ in found], [f for _, f in found], vocabulary)

    return run


def by_kinds(kinds: DataFrame, least: int, groups: int = GROUPS) -> DataFrame:
    """(items, freq) from (items, times) rows.

    The driver sees the frequent items: at most mean basket size / min support of them.
    """
    counts = kinds.select(F.explode("items").alias("item"), "times").groupBy("item").agg(F.sum("times").alias("freq"))
    names = [r["item"] for r in counts.filter(F.col("freq") >= least).orderBy(F.desc("freq"), "item").collect()]
    vocabulary = pa.array(names, pa.string())
    return (
        kinds.select("items", "times").mapInArrow(paths(vocabulary, groups), "grp int, path array<int>, times long")
        .groupBy("grp", "path").agg(F.sum("times").alias("times"))
        .groupBy("grp").applyInArrow(tree_of_group(vocabulary, groups, least), ITEMSET_COUNTS)
        .select(F.sort_array("items").alias("items"), "freq")
    )


def by_baskets(baskets: DataFrame, least: int, n: int, partitions: int | None = None) -> DataFrame:
    """(items, freq) by Spark ML.

    The ratio handed over lies half a basket below the threshold, so that rounding on the other
    side cannot lose an itemset that meets it exactly.
    """
    learner = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n))
    if partitions:
        learner = learner.setNumPartitions(partitions)
    return learner.fit(baskets.select("items")).freqItemsets.select(F.sort_array("items").alias("items"), "freq")


def fpgrowth_itemsets(
    baskets: DataFrame, least: int, n: int, partitions: int | None = None, most_kinds: int = KINDS,
) -> DataFrame:
    """(items, freq) of all itemsets in at least ``least`` of the ``n`` baskets; items of a basket are sorted and distinct."""
    kinds, rows = materialize_counted(baskets.groupBy("items").agg(F.count(F.lit(1)).alias("times")))
    if rows <= most_kinds:
        return by_kinds(kinds, least)
    drop_materialized(kinds)
    return by_baskets(baskets, least, n, partitions)
