"""Removal of repeated byte strings, found by the triggers of prefix-free parsing and by counting.

A byte is removed if it lies in a string of ``LENGTH`` bytes that starts anywhere else, too. Texts are parsed at triggers: a
position triggers if its rolling hash of ``GRAM`` bytes is the least of the first ``reach_of`` positions of some string of
``LENGTH`` bytes. So each such string has one trigger, at the same place wherever the string occurs, and lies in
the end of the phrase before the trigger and in what follows the trigger. The strings of one trigger are one zone.

1. Parse: one row per trigger, about one per hundred bytes, with a hash of the bytes right of it that all of its strings
   share (the core) and one of the whole zone.
2. Dictionary: rows whose core is unique are dropped. Zones that occur twice, by their hashes, are repeated as a whole. What is left are
   the distinct zones of cores with several zones, at the edges of repeats; only their bytes are gathered, by core.
3. Edges: within a core, the phrase ends are sorted from the trigger backwards and what follows is sorted forwards,
   each with its array of common prefix lengths. No suffix array of dictionary or parse is built. A string of
   t bytes before the trigger is repeated if another zone has the same class in both orders, at depths t and LENGTH - t.

A core with more than ``HOT`` distinct zones is not gathered: its strings are counted by hash, with partial counts. Hashes
that decide alone have 128 bits. Everything is judged on the input; all counts run over the whole corpus.

The length is ``LENGTH`` unless another is given. Passages of so many words are found in the same way: each word stands as
the eight bytes of its hash, so a passage of n words is a string of 8 n bytes. A string that starts inside of a word adds
no whole word, and so removes none, that its neighbours do not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.shared import ByWord, bitmap, bound_batches, has_bit, held, spare
from tillspark.runtime import heavy_keys, materialize, materialize_counted, salted_join, scratch

LENGTH, GRAM = 400, 16
#: Distinct zones of a core up to which they are compared in one task, and zones compared at once.
HOT, AT_ONCE = 4096, 6000
#: Bytes parsed at once; a longer text is parsed in slices.
SLICE = 1 << 20

#: Words are what white space parts; of their edges, other signs than letters and digits do not count.
_WORD = re.compile(r"\S+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
WORD_BYTES = 8


def reach_of(length: int) -> int:
    """Positions of a string among which its trigger is looked for; what follows the last one is the core."""
    return length * 16 // 25


def _word_hash(word: str) -> bytes:
    return hashlib.blake2b((_EDGES.sub("", word) or word).encode(), digest_size=WORD_BYTES).digest()


def words_as_bytes(raw: bytes) -> bytes:
    """The hashes of the words of a text, WORD_BYTES each."""
    known = held("passage words", lambda: ByWord(_word_hash))
    return b"".join(map(known.__getitem__, _WORD.findall(raw.decode())))


def plain_bytes(raw: bytes) -> bytes:
    return raw


_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_PLACE = np.uint64(28)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray((len(data),), "<u8", data + b"\0" * 8, strides=(1,))


def _hash(eights: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the strings of ``length`` (at least 8) bytes from ``start`` on."""
    out = _mix(length.astype(np.uint64) + np.uint64(seed))
    order = np.argsort(-length, kind="stable")
    start, length, out = start[order], length[order], out[order]
    counts = np.searchsorted(-length, -8 * np.arange(int(length.max(initial=0)) // 8 + 1), "left")
    for k, live in enumerate(counts):
        live = int(live)
        if live:  # the strings longer than 8 k
            at = np.minimum(start[:live] + 8 * k, start[:live] + length[:live] - 8)
            out[:live] = _mix(out[:live] * _A + eights[at])
    back = np.empty_like(out)
    back[order] = out
    return back


def triggers(data: bytes, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Zones of the texts data[bounds[i]:bounds[i + 1]]: text, trigger, first and last start of a string, places in ``data``."""
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < length:
        return none
    reach = reach_of(length)
    eights = _eights(data)
    h = _mix(eights[:len(data) - GRAM + 1] * _A + eights[8:len(data) - GRAM + 9] * _C)
    # The place in the low bits: of equal hashes the leftmost is least.
    key = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
    # Least key of each run of reach + 1 places, from block-wise prefix and suffix minima.
    width = reach + 1
    blocks = np.append(key, np.full(-len(key) % width, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(bounds, bounds[1:]) if b - a >= length] or [none[0]])
    if not len(starts):
        return none
    least = np.minimum(behind[starts], ahead[starts + reach])
    trigger = (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero(np.append(True, (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first, last = starts[cut], starts[np.append(cut[1:], len(starts)) - 1]
    return np.searchsorted(bounds, first, "right") - 1, trigger[cut], first, last


#: ``span`` is how far before and after the trigger x the first and last string of the zone start, in its high and low half.
_ZONE = "t1 long, t2 long, x long, span long, core long, whole long"


def _slices(ids: list[tuple], texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[list[tuple], bytes, np.ndarray]]:
    """Groups of texts of about SLICE bytes; a longer text in slices that overlap by ``length`` - 1. ids get their offset."""
    held, parts, size = [], [], 0
    for key, text in zip(ids, texts):
        if len(text) > SLICE:
            for at in range(0, len(text) - length + 1, SLICE):
                part = text[at:at + SLICE + length - 1]
                yield [(*key, at)], part, np.array([0, len(part)])
        elif len(text) >= length:
            held.append((*key, 0))
            parts.append(text)
            size += len(text)
            if size >= SLICE:
                yield held, b"".join(parts), np.cumsum([0, *map(len, parts)])
                held, parts, size = [], [], 0
    if held:
        yield held, b"".join(parts), np.cumsum([0, *map(len, parts)])


def _parse(batches: Iterator[pa.RecordBatch], length: int, code: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for keys, data, bounds in _slices(ids, list(map(code, batch.column(2).to_pylist())), length):
            text, x, lo, hi = triggers(data, bounds, length)
            if not len(x):
                continue
            eights = _eights(data)
            shape = ((x - lo) << 16) | (x - hi)
            core = _hash(eights, x, np.full(len(x), length - reach_of(length)), 1)
            whole = _mix(_hash(eights, lo, hi - lo + length, 2) ^ _mix(shape.astype(np.uint64) * _A))
            shift = np.array([k[2] for k in keys]) - bounds[:-1]
            columns = [np.array([k[0] for k in keys])[text], np.array([k[1] for k in keys])[text], x + shift[text], _span(x, lo, hi),
                       *(c.astype(np.int64) for c in (core, whole))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t1", "t2", "x", "span", "core", "whole"])


def _span(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    # The trigger may lie on either side of the starts.
    return ((x - lo) << 32) | ((hi - x) & 0xFFFFFFFF)


def _first_start(x: Column, span: Column) -> Column:
    return x - F.shiftright(span, 32)


def _last_start(x: Column, span: Column) -> Column:
    return x + F.shiftright(F.shiftleft(span, 32), 32)


_TAKEN = "core long, t1 long, t2 long, x long, lo long, hi long, single boolean, bytes binary"


def _take(batches: Iterator[pa.RecordBatch], length: int, code: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
    """The bytes of the zones asked for."""
    for batch in batches:
        rows = []
        for t1, t2, text, zones in zip(*(c.to_pylist() for c in batch.columns)):
            if zones:
                text = code(text)
            rows += [(z["core"], t1, t2, z["x"], z["lo"], z["hi"], z["single"], text[z["lo"]:z["hi"] + length]) for z in zones]
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                         names=["core", "t1", "t2", "x", "lo", "hi", "single", "bytes"])


def _classes(strings: list[bytes], groups: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """depths x strings: equal numbers for strings of one group that agree on their first ``depth`` bytes."""
    order = sorted(range(len(strings)), key=lambda i: (groups[i], strings[i]))
    sizes = np.array([len(s) for s in strings])[order]
    width = int(sizes.max(initial=0)) + 1
    matrix = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in order), np.uint8).reshape(-1, width)
    differ = matrix[1:] != matrix[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    common[groups[order][1:] != groups[order][:-1]] = -1
    common = np.append(-1, common)
    ranked = np.cumsum(common[None, :] < depths[:, None], axis=1, dtype=np.int32)
    out = np.empty_like(ranked)
    out[:, order] = ranked
    return out


def repeated_strings(zones: list[tuple], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(zone, first t, last t): runs of strings that another zone of the same group has, too.

    ``zones`` are (group, bytes, first t, last t): the string of t has t bytes before the trigger.
    """
    groups = np.unique([z[0] for z in zones], return_inverse=True)[1]
    least, most = np.array([z[2] for z in zones]), np.array([z[3] for z in zones])
    ts = np.arange(least.min(), most.max() + 1)
    left = _classes([z[1][:z[3]][::-1] for z in zones], groups, ts)
    right = _classes([z[1][z[3]:] for z in zones], groups, length - ts)
    key = left.astype(np.int64) * (len(zones) + 1) + right
    outside = (ts[:, None] < least) | (ts[:, None] > most)
    key = np.where(outside, -1 - np.arange(len(zones))[None, :], key)
    order = np.argsort(key, axis=1, kind="stable")
    sorted_keys = np.take_along_axis(key, order, axis=1)
    same = sorted_keys[:, 1:] == sorted_keys[:, :-1]
    hit = np.zeros_like(same, shape=key.shape)
    hit[:, 1:] |= same
    hit[:, :-1] |= same
    flags = np.zeros_like(hit)
    np.put_along_axis(flags, order, hit, axis=1)
    edges = np.diff(np.pad(flags, ((1, 1), (0, 0))).astype(np.int8), axis=0)
    zone, begin = np.nonzero(edges.T == 1)
    _, end = np.nonzero(edges.T == -1)
    return list(zip(zone.tolist(), ts[begin].tolist(), ts[end - 1].tolist()))


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Zones come sorted by core; whole cores are compared, several at once."""
    def spans(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_strings([(r[0], r[7], r[3] - r[5], r[3] - r[4]) for r in rows], length) if rows else []
        # The strings of t from a to b start at x - t, so they cover x - b to x - a + length.
        out = [(rows[z][1], rows[z][2], rows[z][3] - b, rows[z][3] - a + length) for z, a, b in found if rows[z][6]]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["t1", "t2", "start", "stop"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held) >= AT_ONCE and row[0] != held[-1][0]:
                yield spans(held)
                held = []
            held.append(row)
    yield spans(held)


def _each_string(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for core, t1, t2, x, lo, hi, single, data in zip(*(c.to_pylist() for c in batch.columns)):
            n = hi - lo + 1
            names = [hashlib.blake2b(data[i:i + length], digest_size=16).digest() for i in range(n)]
            pair = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, t1)), pa.array(np.full(n, t2)), pa.array(np.arange(lo, hi + 1)), pa.array([single] * n),
                 pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["t1", "t2", "start", "single", "h1", "h2"])


def repeated_spans(rows: DataFrame, hot: int = HOT, length: int = LENGTH, code: Callable[[bytes], bytes] = plain_bytes) -> DataFrame:
    """(t1, t2, spans): per text, named by two hashes, the sorted runs (start, stop) of bytes to remove; texts without any are left out.

    ``rows`` has t1, t2 and raw, the bytes; ``code`` makes of them the bytes that are compared, in which the spans are given.
    """
    take = partial(_take, length=length, code=code)
    spark, zone, text = rows.sparkSession, ["core", "whole"], ["t1", "t2"]
    with scratch(spark) as job:
        parsed = materialize(rows.mapInArrow(partial(_parse, length=length, code=code), _ZONE))
        # Most cores stand once: a bitmap of the others keeps their zones out of all shuffles. What it lets through by chance
        # are zones of their own.
        twice, n_twice = materialize_counted(parsed.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"))
        shared = parsed.filter(_may_be(twice, n_twice, "core"))
        zones = materialize(shared.groupBy(*zone).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*text, "x", "span")).alias("at")))
        again = zones.filter("n > 1")
        whole = salted_join(shared, again.select(*zone), zone, ["t1", "x"], "left_semi", heavy=heavy_keys(again, zone, "n"))
        x, span = F.col("x"), F.col("span")
        whole = whole.select(*text, _first_start(x, span).alias("start"), (_last_start(x, span) + length).alias("stop"))
        mixed = zones.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") == 1).alias("singles")).filter("k > 1 and singles > 0")
        edge = salted_join(zones, mixed.select("core", "k"), ["core"], ["whole"], heavy=heavy_keys(mixed, ["core"], "k")).select(
            "at.t1", "at.t2", F.struct("core", "at.x", _first_start(F.col("at.x"), F.col("at.span")).alias("lo"),
                                       _last_start(F.col("at.x"), F.col("at.span")).alias("hi"), (F.col("n") == 1).alias("single"),
                                       (F.col("k") > hot).alias("hot")).alias("z"))
        asked, n_asked = materialize_counted(edge.groupBy(*text).agg(F.collect_list("z").alias("zones")))
        once = rows.filter(_may_be(asked, n_asked, "t1")).groupBy(*text).agg(F.first("raw").alias("raw")).join(asked.hint("merge"), text)
        pick = lambda flag: once.select(*text, "raw", F.filter("zones", lambda z: z["hot"] if flag else ~z["hot"]).alias("zones"))
        edges = pick(False).mapInArrow(take, _TAKEN).repartition("core").sortWithinPartitions("core").mapInArrow(
            partial(_compare, length=length), "t1 long, t2 long, start long, stop long")
        spans = whole.unionByName(edges)
        if not mixed.filter(F.col("k") > hot).isEmpty():
            # One function, as each would have a Python worker of its own.
            strings = materialize(pick(True).mapInArrow(
                lambda batches: _each_string(take(batches), length), "t1 long, t2 long, start long, single boolean, h1 long, h2 long"))
            seen = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            found = salted_join(strings.filter("single"), seen.select("h1", "h2"), ["h1", "h2"], ["t1", "start"], "left_semi")
            spans = spans.unionByName(found.select(*text, "start", (F.col("start") + length).alias("stop")))
        return job.keep(spans.groupBy(*text).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")))


def _may_be(keys: DataFrame, n: int, column: str) -> Column:
    """Whether the column is among ``keys``, a stored table of ``n`` rows, or seems so by a bitmap."""
    sent = keys.sparkSession.sparkContext.broadcast(bitmap(keys, n, F.col(column)))
    return F.arrow_udf(lambda found: pa.array(has_bit(sent.value, found.to_numpy())), "boolean")(column)


def _places_of_words(raw: bytes, spans: list[dict]) -> list[dict]:
    """From spans of words_as_bytes to the bytes of the text: whole words and the white space after them."""
    text = raw.decode()
    starts = [m.start() for m in _WORD.finditer(text)]
    words = [(-(-s["start"] // WORD_BYTES), s["stop"] // WORD_BYTES) for s in spans]
    sizes = np.append(0, np.cumsum([len(c.encode()) for c in text]))
    return [{"start": int(sizes[starts[a]]), "stop": int(sizes[starts[b]]) if b < len(starts) else len(raw)} for a, b in words if a < b]


_CUT = "struct<kept:binary,kept_text:string,spans:array<struct<start:long,stop:long>>>"


def _cut(raw: pa.Array, spans: pa.Array, places: Callable | None = None) -> pa.Array:
    rows = []
    for text, found in zip(raw.to_pylist(), spans.to_pylist()):
        merged: list[list[int]] = []
        for s in places(text, found) if found and places else found or []:
            if merged and s["start"] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s["stop"])
            else:
                merged.append([s["start"], s["stop"]])
        ends = [0, *(p for m in merged for p in m), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
        rows.append({"kept": kept, "kept_text": kept.decode("utf-8", "ignore"),
                     "spans": [{"start": a, "stop": b} for a, b in merged]})
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    return pa.array(rows, pa.struct([("kept", pa.binary()), ("kept_text", pa.string()), ("spans", pa.list_(span))]))


def remove_repeats(docs: DataFrame, text: str = "text", hot: int = HOT, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """``docs`` with a column ``cut``: ``kept``, the remaining bytes, ``kept_text``, their whole characters,
    and ``spans``, the maximal removed runs.

    Removed are strings of ``length`` bytes (at least 32) that occur elsewhere, too; with ``words`` (at least 4) instead
    passages of so many words, whatever white space is between them, and then the white space after them goes, too.

    NULL texts are empty; texts shorter than that stay whole. Matches never run from one text into another. Repeated
    rows are texts of their own, so of equal texts that are long enough nothing stays. All columns of ``docs`` are
    returned as they are; ``cut`` takes another name if there is one already, as ``shared.spare`` gives it. No rows in,
    no rows out.
    """
    bound_batches(docs.sparkSession)
    t1, t2, raw, cut = (spare(docs, n) for n in ("t1", "t2", "raw", "cut"))
    full = F.coalesce(F.col(text), F.lit(""))
    named = docs.withColumns({t1: F.xxhash64(full), t2: F.xxhash64(F.lit(1), full)})
    plain = docs.select(F.xxhash64(full).alias("t1"), F.xxhash64(F.lit(1), full).alias("t2"), F.encode(full, "UTF-8").alias("raw"))
    if words:
        # n words have n bytes and n - 1 between them at least.
        least, spans = 2 * words - 1, partial(repeated_spans, length=words * WORD_BYTES, code=words_as_bytes)
    else:
        least, spans = length, partial(repeated_spans, length=length)
    spans = spans(plain.filter(F.octet_length("raw") >= least), hot).select(
        F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("spans").alias(raw))
    cutter = F.arrow_udf((lambda raw, spans: _cut(raw, spans, _places_of_words)) if words else (lambda raw, spans: _cut(raw, spans)), _CUT)
    # Texts that lose nothing stay where they are, and need no Python but the filter's: a task with two Python functions has two
    # workers, which live on and fill the caches of whatever comes next. Only Python drops the bytes that are no characters.
    touched = _may_be(spans.select(t1), spans.count(), t1) | ~F.is_valid_utf8(full)
    joined = named.filter(touched).join(spans.hint("merge"), [t1, t2], "left").select(*named.columns, raw)
    joined = joined.withColumn(cut, cutter(F.encode(full, "UTF-8"), F.col(raw))).drop(raw)
    whole = F.struct(F.encode(full, "UTF-8").alias("kept"), full.alias("kept_text"), F.array().cast(spans.schema[raw].dataType).alias("spans"))
    rest = named.filter(~touched).withColumn(cut, whole.cast(_CUT))
    return joined.unionByName(rest).drop(t1, t2)
