"""Token counts of whole documents; huge ones are encoded in overlapping chunks on many tasks.

A document over ``chunk`` characters becomes windows of ``chunk + overlap`` characters that start every ``chunk``. Each
window is encoded alone, with offsets. Two neighbours are spliced at the first place in their overlap that is
a token boundary of both encodings and provably stable (white space after other text: the pre-token
pattern breaks there whatever stands around it). Where an overlap holds no such place, the overlaps of that
document are widened, its windows with them, and it is encoded again, up to the end of the document if need be, so the
counts are always those of the whole text. Each round encodes a text at most one and a quarter times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.shared import bound_batches
from tillspark.llm.tokenizing import STABLE, encoder
from tillspark.runtime import materialize

CHUNK, OVERLAP, WIDEN = 32_768, 256, 64
#: A window is at least so many overlaps long, so no round encodes much more than the text.
LEAST_OVERLAPS = 4
#: Characters of windows that leave a task at once.
BATCH_CHARS = 1 << 22
#: Boundaries reported per overlap; the first common one is used, and widening follows if none is.
MARKS = 64

_MARK = "array<struct<pos:long,before:long>>"
_WINDOW = f"key string, k long, n long, last boolean, head {_MARK}, tail {_MARK}"


def token_count(path: str) -> object:
    """A column function: text to its number of tokens, the text taken whole."""
    @F.arrow_udf("long")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = encoder(path)
        for batch in texts:
            yield pa.array([len(raw) // 4 for raw in known.packed_all(t.as_py() or "" for t in batch)], pa.int64())

    return count


def _marks(text: str, ends: np.ndarray, start: int, lo: int, hi: int) -> list[dict]:
    """Stable places of text[lo:hi] that are token boundaries, with the number of tokens before them."""
    found = []
    for m in STABLE.finditer(text, max(lo - 1, 0), min(hi + 1, len(text))):
        before = int(np.searchsorted(ends, m.end(), "right"))
        if lo < m.end() <= hi and before and ends[before - 1] == m.end():
            found.append({"pos": start + m.end(), "before": before})
            if len(found) == MARKS:
                break
    return found


def _cut_windows(chunk: int, overlap: int):
    """Rows (key, text) as windows (key, k, size, text), each text gone through once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "k", "size", "text"]
        for batch in batches:
            rows, chars = [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                key, text = key.as_py(), text.as_py()
                for k, start in enumerate(range(0, len(text), chunk)):
                    rows.append((key, k, len(text), text[start:start + chunk + overlap]))
                    chars += len(rows[-1][3])
                    if chars >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                        rows, chars = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return run


def _encode_windows(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path).tokenizer
        for batch in batches:
            rows = []
            for key, k, size, text in zip(*(c.to_pylist() for c in batch.columns)):
                encoding = known.encode(text, add_special_tokens=False)
                ends = np.maximum.accumulate(np.array([e for _, e in encoding.offsets] or [0], dtype=np.int64))
                start, last = k * chunk, (k + 1) * chunk >= size
                n = len(encoding.ids)
                # The end of the document is a boundary of every window that reaches it.
                end = [{"pos": size, "before": n}] if start + len(text) == size else []
                head = _marks(text, ends, start, 0, overlap) if k else []
                tail = [] if last else _marks(text, ends, start, chunk, chunk + overlap)
                rows.append((key, k, n, last, (head + end)[:MARKS + 1], [] if last else (tail + end)[:MARKS + 1]))
            struct = pa.list_(pa.struct([("pos", pa.int64()), ("before", pa.int64())]))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), struct, struct)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                names=["key", "k", "n", "last", "head", "tail"])

    return run


def _spliced(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, size, n_tokens), n_tokens NULL where some neighbours share no boundary."""
    cut = huge.select("key", "text").mapInArrow(_cut_windows(chunk, overlap), "key string, k long, size long, text string")
    # Equal texts are encoded once; the shuffle also deals the windows of one document out.
    once = cut.groupBy("key", "k").agg(F.first("size").alias("size"), F.first("text").alias("text"))
    encoded = materialize(once.mapInArrow(_encode_windows(path, chunk, overlap), _WINDOW))
    after = encoded.select("key", (F.col("k") - 1).alias("k"), F.col("head"))
    shared: Column = F.get(F.filter("tail", lambda t: F.exists("head", lambda h: h["pos"] == t["pos"])), F.lit(0))
    right = F.get(F.filter("head", lambda h: h["pos"] == F.col("cut.pos")), F.lit(0))["before"]
    joins = (
        encoded.filter(~F.col("last")).select("key", "k", "tail").join(after, ["key", "k"])
        .withColumn("cut", shared).select("key", (F.col("cut.before") - right).alias("n"))
    )
    counted = encoded.filter("last").select("key", "n").unionByName(joins)
    return counted.groupBy("key").agg(
        F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n_tokens"))


def count_tokens(
    docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): one row per row of ``docs``, by the tokenizer file at ``path``.

    NULL texts count as empty, with 0 tokens. Rows with NULL or repeated ids are counted each for itself. Other
    columns are ignored. No rows in, no rows out.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = rows.filter(F.length("text") <= chunk).select("doc_id", "n_bytes", token_count(path)("text").alias("n_tokens"))
    huge = rows.filter(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    left, found = huge.select("key", "text"), None
    while True:
        counts = materialize(_spliced(left, path, chunk, overlap))
        done = counts.filter(F.col("n_tokens").isNotNull())
        found = done if found is None else found.unionByName(done)
        failed = counts.filter(F.col("n_tokens").isNull()).select("key")
        if failed.isEmpty():
            break
        left, overlap = left.join(failed, "key", "left_semi"), overlap * WIDEN
        chunk = max(chunk, LEAST_OVERLAPS * overlap)
    return short.unionByName(huge.select("doc_id", "n_bytes", "key").join(found, "key").select("doc_id", "n_bytes", "n_tokens"))
