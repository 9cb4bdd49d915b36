"""Partitioned mining in two phases (SON).

Phase one mines chunks of baskets on their own with the same support ratio; an itemset frequent
overall is frequent in at least one chunk. Phase two counts the distinct candidates over all
baskets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.mining.apriori import frequent_items
from tillspark.mining.counting import (
    SLOTS_PER_PASS, Batch, count_itemsets, flatten, itemset_batch, narrow,
)
from tillspark.mining.threshold import support_ratio
from tillspark.runtime import materialize

# Least local count aimed at. A chunk so small that one basket meets the ratio would call every
# subset of each of its baskets frequent.
LOCAL_COUNT = 20
# Items a chunk is filled with, 8 bytes each: as many as a worker's memory takes, because the larger the
# chunks, the fewer itemsets are frequent in one by chance.
CHUNK_ITEMS = 4_000_000
# Baskets in partitions too small for a chunk are left to the second phase while they are at most this share of the
# least count; the ratio of the chunks is lowered to make up for them.
SKIPPED_SHARE = 0.1


# ---- inside tasks -------------------------------------------------------------------------

def joined(parts: list):
    """``join_parts`` in half the bytes, which a chunk's numbers fit in; each part goes as it is copied."""
    total = sum(len(ids) for _, _, ids in parts)
    rows, ids, n, at = np.empty(total, np.int32), np.empty(total, np.int32), 0, 0
    parts.reverse()
    while parts:
        n_rows, r, i = parts.pop()
        rows[at:at + len(r)] = r + np.int32(n)
        ids[at:at + len(i)] = i
        n, at = n + n_rows, at + len(r)
    return n, rows, ids


def chunks(batches, vocabulary: pa.Array, size: int, entries: int = CHUNK_ITEMS):
    """Batches joined into chunks of at least ``size`` baskets and about ``entries`` items; a short rest joins the last."""
    ready, open_parts, open_rows, held = None, [], 0, 0
    for batch in batches:
        n_rows, rows, ids = flatten(batch.column(0), vocabulary)
        open_parts.append((n_rows, rows.astype(np.int32), ids.astype(np.int32)))
        open_rows += n_rows
        held += len(ids)
        if open_rows >= size and held >= entries:
            if ready:
                yield joined(ready)
            ready, open_parts, open_rows, held = open_parts, [], 0, 0
    if ready and open_rows >= size:
        yield joined(ready)
        ready = None
    if ready or open_parts:
        yield joined((ready or []) + open_parts)


def local_itemsets(n_rows: int, rows: np.ndarray, ids: np.ndarray, n_items: int, least: int):
    """Itemsets in at least ``least`` baskets of one chunk, grown item by item.

    What is open shares the arrays of what it grew from, and is narrowed when its turn comes; so there are as many
    arrays at once as the longest itemset has items, not as many as there are itemsets open.
    """
    batch = Batch(n_rows, rows, ids, n_items)
    open_sets = [((), rows, ids)]
    while open_sets:
        prefix, r, i = open_sets.pop()
        if prefix:
            r, i = narrow(r, i, prefix[-1]) if len(prefix) > 1 else batch.narrow_first(prefix[0])
        if len(r):
            for item in np.flatnonzero(np.bincount(i, minlength=n_items) >= least).tolist():
                yield prefix + (item,)
                open_sets.append((prefix + (item,), r, i))


def phase_one(vocabulary: pa.Array, ratio: tuple[int, int], size: int, skip_short: bool = False):
    num, den = ratio

    def run(batches):
        for n_rows, rows, ids in chunks(batches, vocabulary, size):
            if skip_short and n_rows < size:
                continue
            least = max(1, -(-num * n_rows // den))
            found = []
            for itemset in local_itemsets(n_rows, rows, ids, len(vocabulary), least):
                found.append(itemset)
                if len(found) == 10_000:
                    yield itemset_batch(found, [0] * len(found), vocabulary)
                    found = []
            if found:
                yield itemset_batch(found, [0] * len(found), vocabulary)

    return run


# ---- on the driver ------------------------------------------------------------------------

def chunk_size(min_support: float) -> int:
    num, den = support_ratio(min_support)
    return -(-LOCAL_COUNT * den // num)


def son_candidates(baskets: DataFrame, min_support: float, least: int, n: int) -> DataFrame:
    """Distinct itemsets frequent in at least one chunk.

    Partitions too small for a chunk are left out while they hold few baskets: an itemset in ``least`` baskets is in
    at least ``least`` less their number elsewhere, and the chunks look for that share. Where they hold more,
    all baskets are dealt out evenly first.
    """
    names = sorted(r[0] for r in frequent_items(baskets, least).select("item").collect())
    size = chunk_size(min_support)
    spread = baskets.select("items")
    short, parts = (
        spread.groupBy(F.spark_partition_id()).agg(F.count("*").alias("k"))
        .agg(F.coalesce(F.sum(F.when(F.col("k") < size, F.col("k"))), F.lit(0)), F.count("*")).first()
    )
    ratio, skip = support_ratio(min_support), 0 < short <= SKIPPED_SHARE * least and short < n
    if skip:
        ratio = (least - short, n - short)
    elif short and parts > 1:
        spread = spread.repartition(max(1, min(parts, n // size)))
    return (
        spread.mapInArrow(
            phase_one(pa.array(names, pa.string()), ratio, size, skip),
            "items array<string>, freq long",
        )
        .select("items").distinct()
    )


def son_itemsets(
    baskets: DataFrame, min_support: float, least: int, n: int, slots: int = SLOTS_PER_PASS
) -> DataFrame:
    """(items, freq) of all itemsets in at least ``least`` of the ``n`` baskets."""
    found = materialize(son_candidates(baskets, min_support, least, n))
    return count_itemsets(baskets, found, least, slots)
