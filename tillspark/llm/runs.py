"""Periodic runs of words: internal pattern matching by dyadic blocks, a suffix order and a wavelet matrix.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST_LENGTH`` words and two periods long, that no
neighbouring word extends keeping the period. Texts are independent; a task takes some together, each ended by a separator
that equals nothing, so that its arrays are long enough to be worked on as a whole:

1. Suffix order by prefix doubling. Level k gives every position the class of the 2^k words from there on, as an interval of the
   order. Only positions whose class has others in it are sorted again.
2. Blocks of b = 2^k words, from places divisible by b. A run of period q has q words or more that recur q words later, so a
   whole block with 2b - 1 <= q lies among them, and recurs at distance q. Of each block the occurrences at the distances of
   its level are asked for: the range successors, in the interval of its class, of the ends of a neighbouring window, from a
   wavelet matrix over the suffix order. A level has at most about two occurrences per word.
3. Occurrences a short way d from each other form progressions of difference d, the period of the block. Members in the block's own
   stretch of period d are no new periods (d is found at a lower level) and are left out. The others are candidate periods.
4. Each candidate is extended to both sides by the classes of the levels; of equal stretches the least period stays.

Memory is some hundred bytes per word of ``CHUNK_WORDS`` or of the longest text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tillspark.llm.shared import bound_batches, spare

LEAST_LENGTH = 12
#: Texts are taken together up to so many words.
CHUNK_WORDS = 200_000


def suffix_order(ids: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The order of all suffixes by their first ``longest`` elements or more, and per level 2^k the first place in this order
    and the size of each position's class. The last element of ``ids`` must occur once."""
    n = len(ids)
    order = np.argsort(ids, kind="stable").astype(np.int64)
    new = np.empty(n, bool)
    starts, sizes, step = [], [], 1
    slots = np.arange(n)
    keys = ids[order].astype(np.int64)
    start, size = np.empty(n, np.int32), np.empty(n, np.int32)
    while True:
        # ``slots`` are the places whose class was not alone; ``keys`` their sorted keys.
        new = np.ones(len(slots), bool)
        new[1:] = keys[1:] != keys[:-1]
        heads = np.flatnonzero(new)
        lengths = np.diff(np.append(heads, len(slots)))
        at = order[slots]
        start, size = start.copy(), size.copy()
        start[at] = np.repeat(slots[heads], lengths)
        size[at] = np.repeat(lengths, lengths)
        starts.append(start)
        sizes.append(size)
        if step >= longest:
            return order, starts, sizes
        slots = slots[np.repeat(lengths, lengths) > 1]
        at = order[slots]
        after = at + step
        # A class with others in it holds no last element, so what follows is inside.
        keys = start[at].astype(np.int64) * (n + 1) + start[np.minimum(after, n - 1)]
        by = np.argsort(keys, kind="stable")
        order[slots], keys = at[by], keys[by]
        step *= 2


class WaveletMatrix:
    """Whole numbers below their number, in a given order: counts and least values within intervals of that order."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.depth = max(int(n - 1).bit_length(), 1)
        self.levels = []
        for bit in range(self.depth - 1, -1, -1):
            ones = (values >> bit) & 1 > 0
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = ones
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, int(n - ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many ones are before each place."""
        word = at >> 6
        part = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[word] + np.bitwise_count(part).astype(np.int64)

    def count_below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers in the places low to high are less than ``value``."""
        low, high, below = low.astype(np.int64), high.astype(np.int64), np.zeros(len(low), np.int64)
        whole = value >= 1 << self.depth
        below[whole] = (high - low)[whole]
        for k, (words, before, zeros) in enumerate(self.levels):
            one = (value >> (self.depth - 1 - k)) & 1 > 0
            ones_low, ones_high = self._ones(words, before, low), self._ones(words, before, high)
            zeros_low, zeros_high = low - ones_low, high - ones_high
            below += np.where(one & ~whole, zeros_high - zeros_low, 0)
            low, high = np.where(one, zeros + ones_low, zeros_low), np.where(one, zeros + ones_high, zeros_high)
        return below

    def smallest(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number of the given rank, from 0, among those in the places low to high."""
        low, high, rank, value = low.astype(np.int64), high.astype(np.int64), rank.astype(np.int64), np.zeros(len(low), np.int64)
        for words, before, zeros in self.levels:
            ones_low, ones_high = self._ones(words, before, low), self._ones(words, before, high)
            zeros_low, zeros_high = low - ones_low, high - ones_high
            one = rank >= zeros_high - zeros_low
            rank = np.where(one, rank - (zeros_high - zeros_low), rank)
            value = value * 2 + one
            low, high = np.where(one, zeros + ones_low, zeros_low), np.where(one, zeros + ones_high, zeros_high)
        return value


def common_after(starts: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements from i on equal those from j on, i < j."""
    same = np.zeros(len(i), np.int64)
    for k in range(len(starts) - 1, -1, -1):
        rows = np.arange(len(i))
        while len(rows):
            rows = rows[starts[k][i[rows] + same[rows]] == starts[k][j[rows] + same[rows]]]
            same[rows] += 1 << k
            if k < len(starts) - 1:
                break
    return same


def common_before(starts: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements before i equal those before j, i < j."""
    same = np.zeros(len(i), np.int64)
    for k in range(len(starts) - 1, -1, -1):
        rows = np.arange(len(i))
        while len(rows):
            rows = rows[i[rows] - same[rows] >= 1 << k]
            back = same[rows] + (1 << k)
            rows = rows[starts[k][i[rows] - back] == starts[k][j[rows] - back]]
            same[rows] += 1 << k
            if k < len(starts) - 1:
                break
    return same


def runs_of(ids: np.ndarray, longest: int, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of ``ids``, by start and period.

    No run crosses an element that occurs once; the first and last element must be such. ``longest`` is the greatest length
    a run may have.
    """
    n, most = len(ids), longest // 2
    none = np.zeros(0, np.int64)
    if longest < least:
        return none, none, none
    top = 1
    while 4 << top <= most + 1:
        top += 1
    order, starts, sizes = suffix_order(ids, 1 << top)
    tree = WaveletMatrix(order)
    found = []
    for k in range(1, top + 1):
        b = 1 << k
        # Distances 2b - 1 to 4b - 2 are this level's; the lowest level has the shorter ones, too.
        near, far = (1 if k == 1 else 2 * b - 1), min(4 * b - 2, most)
        p = np.arange(0, n - b, b)
        p = p[sizes[k][p] > 1]
        low = starts[k][p].astype(np.int64)
        high = low + sizes[k][p]
        first = tree.count_below(low, high, p + near)
        times = tree.count_below(low, high, p + far + 1) - first
        hit = times > 0
        p, low, high, first, times = p[hit], low[hit], high[hit], first[hit], times[hit]
        if not len(p):
            continue
        row = np.repeat(np.arange(len(p)), times)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        q = tree.smallest(low[row], high[row], first[row] + turn) - p[row]
        # Progressions: neighbours at most b/2 apart differ by the period of the block.
        gap = np.full(len(row), n)
        gap[1:] = np.where(row[1:] == row[:-1], np.diff(q), n)
        d = np.full(len(p), n)
        np.minimum.at(d, row, gap)
        periodic = np.flatnonzero(d <= b // 2)
        end = np.zeros(len(p), np.int64)
        end[periodic] = p[periodic] + d[periodic] + common_after(starts, p[periodic], p[periodic] + d[periodic])
        other = (p[row] + q + b > end[row]) | (q == d[row])
        row, q = row[other], q[other]
        here = p[row]
        left, right = common_before(starts, here, here + q), common_after(starts, here, here + q)
        length = left + right + q
        fits = length >= np.maximum(least, 2 * q)
        found.append(np.stack([here - left, length, q])[:, fits])
    every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    # Equal stretches: the least period first; it divides the others.
    by = np.lexsort((every[2], every[1], every[0]))
    every = every[:, by]
    new = np.ones(every.shape[1], bool)
    new[1:] = (every[0, 1:] != every[0, :-1]) | (every[1, 1:] != every[1, :-1])
    start, length, period = every[:, new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _texts_with_runs(texts: list[bytes], least: int) -> tuple[list[int], list[np.ndarray], list[str]]:
    """Per text its number of words, its runs as rows of three, and what is left of it without the repeats."""
    known: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    ids, firsts, at = [np.array([-1])], [], 1
    for i, w in enumerate(words):
        firsts.append(at)
        ids += [np.fromiter((known.setdefault(x, len(known)) for x in w), np.int64, len(w)), np.array([-2 - i])]
        at += len(w) + 1
    ids = np.concatenate(ids)
    start, length, period = runs_of(ids, max(map(len, words), default=0), least)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    dropped = np.cumsum(change) > 0
    first = np.array(firsts, np.int64)
    own = np.searchsorted(first, start, "right") - 1
    rows = np.stack([start - first[own], length, period], axis=1) if len(start) else np.zeros((0, 3), np.int64)
    cuts = np.searchsorted(own, np.arange(len(texts) + 1))
    left = []
    for i, w in enumerate(words):
        if cuts[i + 1] > cuts[i]:
            gone = dropped[firsts[i]:firsts[i] + len(w)].tolist()
            w = [x for x, g in zip(w, gone) if not g]
        left.append(b" ".join(w).decode())
    return [len(w) for w in words], [rows[cuts[i]:cuts[i + 1]] for i in range(len(texts))], left


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """All columns of ``docs`` and one named found (or found_ ...): n_words, runs and collapsed.

    Words are what white space (blank, tab to carriage return) separates, numbered from 0; NULL texts have none. ``runs`` are
    (start, length, period) by start, then period. ``collapsed`` is the text without the words that a run contains after
    its first period, joined by single blanks. Rows with equal ids or texts are judged each by itself.
    """
    bound_batches(docs.sparkSession)
    name = spare(docs, "found")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
            # A word and its gap are two bytes or more, mostly some six.
            chunk = np.cumsum(lengths) // (6 * CHUNK_WORDS)
            for c in np.unique(chunk):
                rows = np.flatnonzero(chunk == c)
                part = batch.slice(rows[0], len(rows))
                texts = [(t or "").encode() for t in part.column(batch.schema.get_field_index(text)).to_pylist()]
                n_words, runs, left = _texts_with_runs(texts, least)
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                offsets = np.cumsum([0] + [len(r) for r in runs])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(flat[:, i]) for i in range(3)], fields=list(run)))
                found = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), listed, pa.array(left, pa.string())],
                                                   names=["n_words", "runs", "collapsed"])
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    kind = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"
    return docs.mapInArrow(find, StructType([*docs.schema, *StructType.fromDDL(f"{name} {kind}")]))
