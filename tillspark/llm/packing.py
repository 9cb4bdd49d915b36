"""Packing of documents into training sequences, in input order, by dynamic programming.

Each task packs the documents of its input partition in their order, in blocks of about ``BLOCK`` tokens, so
nothing is shuffled. Within a block the places where a sequence may end are the ends of documents, the ends
of sentences (for a penalty; the last of some close together), and, where none of these lies within a window of the last, full windows (for a larger
one). The cheapest chain of windows is found with

    cost(j) = min over i of cost(i) + padding(j - i) + penalty(j) + opening cost

``padding`` is ``window - length``, so the minimum over all i within one window of j is that of
``cost(i) + position(i)``: a sliding minimum kept in a monotone queue. Lengths that are a power of two are
not padded; those few places are looked up besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm.shared import bound_batches
from tillspark.llm.tokenizing import encoder

WINDOW, END_ID, BLOCK = 2048, 1, 1 << 19
#: What an end at a sentence or inside one, and each sequence, cost, in tokens of padding.
AT_SENTENCE, INSIDE, OPENING = 2, 24, 12
#: The shortest power of two that is used as an unpadded length.
LEAST_POWER = 16
#: Of the sentence ends within so many tokens only the last is a place to end at.
NEAR = 16

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


def places(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """All places where a sequence may end, from 0 on, and their penalties. No two are over ``window`` apart."""
    cells = sentence_ends // NEAR
    last = np.flatnonzero(np.append(cells[1:] != cells[:-1], True)) if len(cells) else cells
    base = np.unique(np.concatenate(([0], doc_ends, sentence_ends[last])))
    gaps = np.diff(base)
    long = np.flatnonzero(gaps > window)
    every = np.concatenate((base, *(np.arange(base[i] + window, base[i + 1], window) for i in long)))
    penalty = np.full(len(every), INSIDE)
    penalty[:len(base)] = AT_SENTENCE
    penalty[:len(base)][np.isin(base, doc_ends)] = 0
    order = np.argsort(every, kind="stable")
    return every[order].tolist(), penalty[order].tolist()


def best_cuts(at: list[int], penalty: list[int], window: int) -> list[int]:
    """Where the windows of the cheapest chain end."""
    places_at = np.asarray(at)
    exact: dict[int, list[int]] = {}
    for k in range(window.bit_length()):
        if LEAST_POWER <= 1 << k <= window:
            back = places_at - (1 << k)
            i = np.searchsorted(places_at, back)
            j = np.flatnonzero((back >= 0) & (places_at[i] == back))
            for a, b in zip(j.tolist(), i[j].tolist()):
                exact.setdefault(a, []).append(b)
    # Of the places that may still be best: where they are, their keys and their numbers, from ``head`` on.
    cost, before = [0], [0]
    queue_at, queue_key, queue_no, head = [0], [0], [0], 0
    for j in range(1, len(at)):
        p = at[j]
        while queue_at[head] < p - window:
            head += 1
        i = queue_no[head]
        best = queue_key[head] + window - p
        if j in exact:
            for t in exact[j]:
                if cost[t] < best:
                    best, i = cost[t], t
        best += penalty[j] + OPENING
        cost.append(best)
        before.append(i)
        best += p
        while len(queue_key) > head and queue_key[-1] >= best:
            del queue_key[-1], queue_at[-1], queue_no[-1]
        queue_key.append(best)
        queue_at.append(p)
        queue_no.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = before[j]
    return cuts[::-1]


def _sentence_ends(path: str) -> np.ndarray:
    """For each id: whether a sentence or line may end after it."""
    known = encoder(path).tokenizer
    ends = np.zeros(known.get_vocab_size() + 1, dtype=bool)
    for token, i in known.get_vocab().items():
        ends[i] = token[-1:] in (".", "!", "?", "Ċ")
    return ends


def _pieces(block: list[tuple[int | None, np.ndarray]], ends: np.ndarray, window: int, first: int):
    """Rows of one block; ``first`` is the number of its first sequence. Returns them and the next number."""
    ids = np.concatenate([x for _, x in block])
    doc_ends = np.cumsum([len(x) for _, x in block])
    doc_starts = doc_ends - [len(x) for _, x in block]
    cuts = np.array(best_cuts(*places(doc_ends, np.flatnonzero(ends[ids]) + 1, window), window))
    starts = np.union1d(doc_starts, np.concatenate(([0], cuts[:-1])))
    lengths = np.diff(np.append(starts, len(ids)))
    d = np.searchsorted(doc_starts, starts, "right") - 1
    w = np.searchsorted(cuts, starts, "right")
    window_starts = np.concatenate(([0], cuts[:-1]))
    raw = ids.astype("<u4").tobytes()
    docs = [x for x, _ in block]
    return pa.RecordBatch.from_arrays([
        pa.array([docs[i] for i in d], pa.int64()), pa.array(starts - doc_starts[d], pa.int64()),
        pa.array(lengths, pa.int64()), pa.array([raw[4 * s:4 * (s + n)] for s, n in zip(starts, lengths)], pa.binary()),
        pa.array((doc_ends - doc_starts)[d], pa.int64()), pa.array(first + w, pa.int64()),
        pa.array(starts - window_starts[w], pa.int64()),
    ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]), first + len(cuts)


def pack(
    docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
    block: int = BLOCK,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, then ``end_id``. A sequence holds at most ``window`` ids; one whose length is a
    power of two needs no padding. Sequences are numbered by input partition, so a repeated task gives the same numbers.

    NULL texts are empty, so only ``end_id`` remains of them. NULL and repeated ids are kept, each row a document of
    its own. Other columns are ignored. No rows in, no rows out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ends = encoder(path), _sentence_ends(path)
        number = TaskContext.get().partitionId() << 40
        held, n = [], 0
        for batch in batches:
            texts = (value.as_py() or "" for value in batch.column(1))
            for key, raw in zip(batch.column(0), known.packed_all(texts)):
                held.append((key.as_py(), np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id))))
                n += len(held[-1][1])
                if n >= block:
                    rows, number = _pieces(held, ends, window, number)
                    yield rows
                    held, n = [], 0
        if held:
            yield _pieces(held, ends, window, number)[0]

    bound_batches(docs.sparkSession)
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
