"""Counting itemsets against baskets without emitting item combinations.

A pass over the baskets holds, in every task, one counter per itemset looked for. Baskets come in blocks, vertically: per item
one bitmap of the block's baskets. The bitmap of a prefix is the AND of its items', kept while its extensions
and longer prefixes are counted; an extension is one more AND and a bit count. Where a prefix stands in so few baskets that
their items are fewer than the words of its extensions' bitmaps, one histogram over these baskets counts all of them
instead. A task sends one partial count per itemset, whatever the sizes of its baskets, and Spark adds them up.

Pairs are counted before there is a list of them. One scan adds up a table of counters, a pair's counter given by a hash of its
two items; where the table has room for all pairs each has its own, and this is all. Otherwise counters below the threshold
rule out all their pairs, and a second scan counts the others one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Counters a task keeps in one pass (8 bytes each). More itemsets mean more passes.
SLOTS_PER_PASS = 2_000_000
# Counters of pairs (4 bytes each), at most; so 2,048 frequent items are counted without collisions.
PAIR_COUNTERS = 1 << 22
# Counters that travel together, and pairs that a task lists at once or holds before it sends their counts.
COUNTERS_PER_ROW, PAIRS_AT_ONCE, PAIRS_HELD = 1 << 15, 2_000_000, 4_000_000
# Bytes of a block's bitmaps, and its baskets at most.
BITMAP_BYTES, BLOCK_ROWS = 64 << 20, 1 << 16


# ---- inside tasks -------------------------------------------------------------------------

def flatten(column, vocabulary: pa.Array):
    """A batch of baskets as (number of baskets, row, item number); unknown items are left out."""
    found = pc.index_in(column.flatten(), value_set=vocabulary.cast(column.type.value_type))
    known = pc.is_valid(found).to_numpy(zero_copy_only=False)
    rows = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)[known]
    ids = pc.drop_null(found).to_numpy(zero_copy_only=False)
    return len(column), rows.astype(np.int64), ids.astype(np.int64)


class Batch:
    """Flat baskets with an index from item to rows, for fast narrowing by the first item."""

    def __init__(self, n_rows: int, rows: np.ndarray, ids: np.ndarray, n_items: int):
        self.rows, self.ids = rows, ids
        self.starts = np.searchsorted(rows, np.arange(n_rows + 1))
        order = np.argsort(ids, kind="stable")
        self.by_item = rows[order]
        self.bounds = np.searchsorted(ids[order], np.arange(n_items + 1))

    def narrow_first(self, item: int):
        """Rows holding ``item``, with their later items only."""
        hit = self.by_item[self.bounds[item]:self.bounds[item + 1]]
        sizes = self.starts[hit + 1] - self.starts[hit]
        at = np.repeat(self.starts[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        ids = self.ids[at]
        later = ids > item
        return np.repeat(hit, sizes)[later], ids[later]


def narrow(rows: np.ndarray, ids: np.ndarray, item: int):
    """The same for arrays narrowed before."""
    keep = np.isin(rows, rows[ids == item]) & (ids > item)
    return rows[keep], ids[keep]


def join_parts(parts: list):
    shifts = np.cumsum([0] + [n for n, _, _ in parts])
    rows = np.concatenate([r + s for (_, r, _), s in zip(parts, shifts)])
    return int(shifts[-1]), rows, np.concatenate([i for _, _, i in parts])


class Block:
    """Baskets as bitmaps per item, and as flat arrays by basket."""

    def __init__(self, n_rows: int, rows: np.ndarray, ids: np.ndarray, n_items: int):
        self.words, self.rows, self.ids = -(-n_rows // 64), rows, ids
        self.starts = np.searchsorted(rows, np.arange(n_rows + 1))
        # Entries by item and basket: those of one byte are neighbours.
        entries = np.sort(ids * (self.words * 64) + rows)
        at = entries >> 3
        heads = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
        bits = np.zeros(n_items * self.words * 8, np.uint8)
        if len(at):
            bits[at[heads]] = np.bitwise_or.reduceat(np.left_shift(1, entries & 7).astype(np.uint8), heads)
        self.bitmaps = bits.view(np.uint64).reshape(n_items, self.words)

    def items_of(self, bitmap: np.ndarray) -> np.ndarray:
        """The items of all baskets in the bitmap."""
        hit = np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        sizes = self.starts[hit + 1] - self.starts[hit]
        return self.ids[np.repeat(self.starts[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


def partial_counts(block: Block, wanted: list):
    """For each (prefix, extensions) in prefix order, the baskets holding prefix plus extension."""
    bitmaps = block.bitmaps
    n_items, mean = len(bitmaps), len(block.ids) / max(len(block.starts) - 1, 1)
    path: list[tuple[tuple, np.ndarray | None]] = [((), None)]
    for prefix, extensions in wanted:
        while path[-1][0] != prefix[:len(path[-1][0])]:
            path.pop()
        for item in prefix[len(path[-1][0]):]:
            done, bitmap = path[-1]
            path.append((done + (item,), bitmaps[item] if bitmap is None else bitmap & bitmaps[item]))
        bitmap = path[-1][1]
        if bitmap is None:
            yield np.bincount(block.ids, minlength=n_items)[extensions]
            continue
        baskets = int(np.bitwise_count(bitmap).sum())
        if not baskets:
            yield np.zeros(len(extensions), np.int64)
        elif baskets * mean < len(extensions) * block.words:
            yield np.bincount(block.items_of(bitmap), minlength=n_items)[extensions]
        else:
            yield np.bitwise_count(bitmaps[extensions] & bitmap).sum(axis=1, dtype=np.int64)


def blocks(batches, vocabulary: pa.Array):
    """Batches cut and joined into blocks of bounded size."""
    n_items = max(len(vocabulary), 1)
    most = int(min(BLOCK_ROWS, max(512, BITMAP_BYTES * 8 // n_items)))
    parts, held = [], 0
    for batch in batches:
        column = batch.column(0)
        at = 0
        while at < len(column):
            part = flatten(column.slice(at, most - held), vocabulary)
            at, held = at + part[0], held + part[0]
            parts.append(part)
            if held == most:
                yield join_parts(parts)
                parts, held = [], 0
    if parts:
        yield join_parts(parts)


def task_totals(batches, vocabulary: pa.Array, wanted: list):
    """(baskets of the task, their counts for each prefix)."""
    n, totals = 0, [np.zeros(len(extensions), dtype=np.int32) for _, extensions in wanted]
    for n_rows, rows, ids in blocks(batches, vocabulary):
        n += n_rows
        for total, part in zip(totals, partial_counts(Block(n_rows, rows, ids, len(vocabulary)), wanted)):
            np.add(total, part, out=total, casting="unsafe")
    return n, totals


def counter(vocabulary: pa.Array, wanted: list):
    """The task of one pass: sends (slot, freq) once, with slots numbered through ``wanted``."""
    def run(batches):
        counts = np.concatenate(task_totals(batches, vocabulary, wanted)[1])
        slots = np.flatnonzero(counts)
        for at in range(0, len(slots), 100_000):
            part = slots[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part].astype(np.int64))], ["slot", "freq"])

    return run


def pairs_of(n_rows: int, rows: np.ndarray, ids: np.ndarray, n_items: int, at_once: int = PAIRS_AT_ONCE):
    """All pairs of items of a basket as numbers ``low item * n_items + high item``, about ``at_once`` at a time."""
    place = rows * n_items + ids
    if (place[1:] < place[:-1]).any():
        place.sort()
        rows, ids = np.divmod(place, n_items)
    later = np.searchsorted(rows, rows, "right") - np.arange(len(rows)) - 1
    ends = np.cumsum(later)
    first = 0
    while first < len(rows):
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + at_once, "right")), first + 1)
        sizes = later[first:last]
        low = np.repeat(np.arange(first, last), sizes)
        high = low + 1 + np.arange(len(low)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield ids[low] * n_items + ids[high]
        first = last


def places_of(pairs: np.ndarray, n_items: int, counters: int) -> np.ndarray:
    """The counter of each pair: its own while there is one for each, one by a hash otherwise."""
    if n_items * n_items <= counters:
        return pairs
    mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - counters.bit_length() + 1)).astype(np.int64)


def pair_counters(vocabulary: pa.Array, counters: int):
    """The task of the first scan: sends its counters in rows of COUNTERS_PER_ROW; no more of them for a short task than for a long one."""
    def run(batches):
        n_items, totals = len(vocabulary), np.zeros(counters, np.int64)
        for n_rows, rows, ids in blocks(batches, vocabulary):
            for pairs in pairs_of(n_rows, rows, ids, n_items):
                totals += np.bincount(places_of(pairs, n_items, counters), minlength=counters)
        width = min(COUNTERS_PER_ROW, counters)
        parts = totals.reshape(-1, width)
        used = np.flatnonzero(parts.any(axis=1))
        # Numbers that fit are sent in half the bytes.
        for at in used.tolist():
            small = parts[at].max() < 1 << 32
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([small]), pa.array([parts[at].astype("<u4" if small else "<u8").tobytes()], pa.binary())],
                                             ["part", "small", "counts"])

    return run


def add_counters(least: int):
    """Sums of the counters of one part: (counter, freq) of those of at least ``least``. Rows are added as they come."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for small, raw in zip(batch.column("small").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(raw, "<u4" if small else "<u8").astype(np.int64)
                total = counts if total is None else total + counts
        kept = np.flatnonzero(total >= least)
        yield pa.RecordBatch.from_arrays([pa.array(kept + key[0].as_py() * len(total)), pa.array(total[kept])], ["counter", "freq"])

    return run


def pair_totals(vocabulary: pa.Array, counters: int, possible: np.ndarray):
    """The task of the second scan: (pair, freq) of the pairs whose counter is in the bitmap."""
    def run(batches):
        n_items, held, n = len(vocabulary), [], 0

        def out():
            pairs = np.concatenate([p for p, _ in held])
            every, back = np.unique(pairs, return_inverse=True)
            return every, np.bincount(back, weights=np.concatenate([f for _, f in held])).astype(np.int64)

        for n_rows, rows, ids in blocks(batches, vocabulary):
            for pairs in pairs_of(n_rows, rows, ids, n_items):
                place = places_of(pairs, n_items, counters)
                held.append(np.unique(pairs[possible[place >> 3] >> (place & 7) & 1 > 0], return_counts=True))
                n += len(held[-1][0])
                if n > PAIRS_HELD:
                    held = [out()]
                    n = len(held[0][0])
                    if n > PAIRS_HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["pair", "freq"])
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out()], ["pair", "freq"])

    return run


def name_pairs(vocabulary: pa.Array):
    """Turns (pair, freq) rows into (items, freq)."""
    def run(batches):
        for batch in batches:
            pairs = batch.column(0).to_numpy()
            both = np.stack([pairs // len(vocabulary), pairs % len(vocabulary)], axis=1)
            yield itemset_batch(both.tolist(), batch.column(1), vocabulary)

    return run


def decoder(vocabulary: pa.Array, wanted: list):
    """Turns (slot, freq) rows back into (items, freq)."""
    starts = np.cumsum([0] + [len(extensions) for _, extensions in wanted])

    def run(batches):
        for batch in batches:
            itemsets = []
            for slot in batch.column(0).to_numpy():
                p = int(np.searchsorted(starts, slot, side="right")) - 1
                prefix, extensions = wanted[p]
                itemsets.append(prefix + (int(extensions[slot - starts[p]]),))
            yield itemset_batch(itemsets, batch.column(1), vocabulary)

    return run


def itemset_batch(itemsets: list, freqs, vocabulary: pa.Array) -> pa.RecordBatch:
    """Itemsets of item numbers, with counts, as a batch of (items, freq)."""
    offsets = pa.array(np.cumsum([0] + [len(s) for s in itemsets]), pa.int32())
    flat = pa.array([item for s in itemsets for item in s], pa.int64())
    items = pa.ListArray.from_arrays(offsets, vocabulary.take(flat))
    return pa.RecordBatch.from_arrays([items, pa.array(freqs).cast(pa.int64())], ["items", "freq"])


# ---- on the driver ------------------------------------------------------------------------

ITEMSET_COUNTS = "items array<string>, freq long"
SLOT_COUNTS = "slot long, freq long"


def _one_pass(baskets: DataFrame, names: list[str], wanted: list, least: int = 1) -> DataFrame:
    """(items, freq) of the wanted itemsets in at least ``least`` baskets.

    Slots travel as numbers; only those kept are spelled out.
    """
    vocabulary = pa.array(names, pa.string())
    wanted = sorted(wanted, key=lambda w: w[0])
    return (
        baskets.select("items").mapInArrow(counter(vocabulary, wanted), SLOT_COUNTS)
        .groupBy("slot").agg(F.sum("freq").alias("freq")).filter(F.col("freq") >= least)
        .mapInArrow(decoder(vocabulary, wanted), ITEMSET_COUNTS)
    )


def frequent_pairs(baskets: DataFrame, frequent: list[str], least: int, counters: int = PAIR_COUNTERS) -> DataFrame:
    """(items, freq) of the pairs of the given sorted items in at least ``least`` baskets, in one or two scans.

    ``frequent`` has at most (mean basket size) / (min support) entries however many baskets there are; the driver sees a
    bitmap of ``counters`` bits (a power of two) at most.
    """
    n = len(frequent)
    # Room for all pairs where that is not more.
    counters = min(counters, 1 << max((n * n - 1).bit_length(), 3))
    vocabulary, items = pa.array(frequent, pa.string()), baskets.select("items")
    summed = (
        items.mapInArrow(pair_counters(vocabulary, counters), "part long, small boolean, counts binary")
        .groupBy("part").applyInArrow(add_counters(least), "counter long, freq long")
    )
    if n * n <= counters:
        found = summed.select(F.col("counter").alias("pair"), "freq")
    else:
        place = F.col("counter") + 1
        rows = summed.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
        possible = np.zeros((max(counters >> 15, 1), 1 << 12), np.uint8)
        for r in rows:
            possible[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
        possible = baskets.sparkSession.sparkContext.broadcast(possible.ravel())
        found = (
            items.mapInArrow(lambda batches: pair_totals(vocabulary, counters, possible.value)(batches), "pair long, freq long")
            .groupBy("pair").agg(F.sum("freq").alias("freq")).filter(F.col("freq") >= least)
        )
    return found.mapInArrow(name_pairs(vocabulary), ITEMSET_COUNTS)


def count_prefixed(
    baskets: DataFrame, prefixes: DataFrame, least: int = 1, slots: int = SLOTS_PER_PASS
):
    """Counts of the itemsets ``prefix + one of extensions``, one DataFrame per pass.

    ``prefixes`` has sorted ``prefix`` and ``extensions`` arrays, every extension after the prefix.
    It is split by a hash into passes of about ``slots`` itemsets; only one pass at a time is sent
    to the tasks, so neither driver nor tasks ever hold all of a long list.
    """
    total = prefixes.agg(F.sum(F.size("extensions"))).first()[0] or 0
    passes = -(-total // slots)
    part = F.pmod(F.xxhash64("prefix"), F.lit(max(passes, 1)))
    for p in range(passes):
        rows = prefixes.filter(part == p).select("prefix", "extensions").collect()
        names = sorted({x for r in rows for x in (*r["prefix"], *r["extensions"])})
        number = {x: i for i, x in enumerate(names)}
        wanted = [
            (tuple(number[x] for x in r["prefix"]), np.array([number[x] for x in r["extensions"]]))
            for r in rows
        ]
        if wanted:
            yield _one_pass(baskets, names, wanted, least)


def by_prefix(itemsets: DataFrame) -> DataFrame:
    """Itemsets as (prefix, extensions): all but the last item, and the last items seen after it."""
    k = F.size("items")
    return (
        itemsets.filter(k >= 1)
        .select(F.slice("items", F.lit(1), k - 1).alias("prefix"), F.element_at("items", -1).alias("last"))
        .groupBy("prefix").agg(F.sort_array(F.collect_set("last")).alias("extensions"))
    )


def count_itemsets(
    baskets: DataFrame, itemsets: DataFrame, least: int = 1, slots: int = SLOTS_PER_PASS
) -> DataFrame:
    """(items, freq) for those of the given sorted itemsets in at least ``least`` baskets."""
    counted = None
    for part in count_prefixed(baskets, by_prefix(itemsets), least, slots):
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return baskets.sparkSession.createDataFrame([], ITEMSET_COUNTS)
    return counted
