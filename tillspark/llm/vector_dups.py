"""Near-duplicate vectors by lattice hashing: E8 cells in several tables, neighbouring cells probed, cosine verified.

In each table a unit vector is projected to ``BLOCKS`` times eight random dimensions, and each eight are decoded to the
nearest point of the E8 lattice; the points together name the vector's cell. A vector also probes the cells
reached by going, in one of the blocks, to the next nearest lattice points. Two vectors meet if one's cell is the other's
own or probed cell in some table.

Vectors of a cell are compared as matrices inside the tasks. No pairs are written: a cell gives each vector's number of links
and a forest that connects what is linked. A crowded cell is cut into chunks, and all pairs of
chunks are compared on different tasks. A pair that meets several times is counted only where it meets first, which
its two vectors alone decide. Equal vectors are compared once, as one vector with a weight.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm.shared import bound_batches, components
from tillspark.runtime import drop_materialized, materialize

COSINE = 0.9
#: At cosine 0.9 a pair is missed by all tables with a probability of some percent, at 0.95 below one in a thousand.
TABLES, BLOCKS, PROBES, SCALE = 10, 2, 3, 0.42
#: Vectors of a chunk of a crowded cell.
CHUNK = 1024


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two of eight places +-1, or all +-1/2 with an even number of minuses."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    out = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in zip(out, pairs):
        row[i], row[j] = a, b
    halves = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.concatenate((out, halves))


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """The nearest whole-number point with an even sum: round, and turn the worst coordinate if the sum is odd."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 = D8 and D8 + 1/2."""
    whole, half = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@lru_cache(maxsize=4)
def _projections(dims: int) -> np.ndarray:
    """TABLES x BLOCKS x dims x 8, the same in every process."""
    return np.random.default_rng([8, dims]).normal(size=(TABLES, BLOCKS, dims, 8)) * SCALE


def _names(points: np.ndarray) -> np.ndarray:
    """A 64-bit name of each lattice point; doubled coordinates are whole."""
    name = np.full(len(points), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for column in np.rint(2 * points).astype(np.int64).T:
        name = (name ^ column.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        name ^= name >> np.uint64(29)
    return name


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (rows x TABLES) and probed cells (rows x TABLES x PROBES) of unit vectors."""
    n, dims = unit.shape
    own, probed = np.zeros((n, TABLES), np.uint64), np.zeros((n, TABLES, PROBES), np.uint64)
    for t, blocks in enumerate(_projections(dims)):
        names, steps, gains = [], [], []
        for projection in blocks:
            x = unit @ projection
            point = decode(x)
            # |x - p - r|^2 = |x - p|^2 - 2 (x - p).r + 2 for a root r.
            gain = (x - point) @ roots().T
            best = np.argsort(-gain, axis=1, kind="stable")[:, :PROBES]
            names.append(_names(point))
            gains.append(np.take_along_axis(gain, best, axis=1))
            steps.append([_names(point + roots()[best[:, k]]) for k in range(PROBES)])
        salt = np.uint64(t * 1_000_003 + dims)
        join = lambda parts: _names_join(parts, salt)
        own[:, t] = join(names)
        # All single steps, the nearest first.
        choices = np.stack([join([*names[:b], steps[b][k], *names[b + 1:]]) for b in range(BLOCKS) for k in range(PROBES)], axis=1)
        order = np.argsort(-np.concatenate(gains, axis=1), axis=1, kind="stable")[:, :PROBES]
        probed[:, t] = np.take_along_axis(choices, order, axis=1)
    return own, probed


def _names_join(parts: list[np.ndarray], salt: np.uint64) -> np.ndarray:
    out = np.full(len(parts[0]), salt, dtype=np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return out


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(raw: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
        for rows in _by_length(raw):
            own, probed = cells(_unit([raw[i] for i in rows]))
            every = np.concatenate((own[:, :, None], probed), axis=2).reshape(len(rows), -1)
            is_own = np.tile(np.arange(PROBES + 1) == 0, TABLES)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(ids[rows], every.shape[1])), pa.array(every.ravel().astype(np.int64)),
                pa.array(np.tile(is_own, len(rows)))], names=["id", "cell", "own"])


def _local_groups(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row reachable over the links i-j, for each row."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            return low


def _compare(ids, weights, unit, own_here, left, right, cell, cosine):
    """(id, links, to) rows of one pair of chunks; ``left`` and ``right`` are row numbers, the same for one chunk."""
    score = unit[left] @ unit[right].T
    meets = (score >= cosine) & (own_here[left][:, None] | own_here[right][None, :])
    i, j = np.nonzero(meets)
    i, j = left[i], right[j]
    keep = ids[i] < ids[j] if left is right else ids[i] != ids[j]
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    used, place = np.unique(np.concatenate((i, j)), return_inverse=True)
    i, j = place[:len(i)], place[len(i):]
    own, probed = cells(unit[used])
    here = own_here[used]
    name, weight = ids[used], weights[used]
    counted, seen = np.zeros(len(i), bool), np.zeros(len(i), bool)
    for t in range(TABLES):
        same = own[i, t] == own[j, t]
        forth = (probed[i, t] == own[j, t][:, None]).any(axis=1)
        back = (probed[j, t] == own[i, t][:, None]).any(axis=1)
        # Of two cells in which a pair meets by probing, the one that the smaller id owns counts.
        i_owns, j_owns = own[i, t] == cell, own[j, t] == cell
        first = np.where(name[i] < name[j], i_owns, j_owns)
        at_this = (same & i_owns) | (~same & ((forth & j_owns & here[j]) | (back & i_owns & here[i])) & (first | ~(forth & back)))
        counted |= ~seen & at_this
        seen |= same | forth | back
    links = np.bincount(i[counted], weight[j[counted]], len(used)) + np.bincount(j[counted], weight[i[counted]], len(used))
    return name, links.astype(np.int64), name[_local_groups(len(used), i, j)]


def _link(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and chunk pair; each such run is one comparison."""
        def done(rows: list) -> list:
            cell, lo, hi = rows[0][:3]
            out = []
            for some in _by_length([r[6] for r in rows]):
                mine = [rows[k] for k in some]
                ids, weights = np.array([r[3] for r in mine]), np.array([r[5] for r in mine])
                part, own = np.array([r[7] for r in mine]), np.array([r[4] for r in mine])
                left = np.flatnonzero(part == lo)
                right = left if lo == hi else np.flatnonzero(part == hi)
                if len(left) and len(right):
                    found = _compare(ids, weights, _unit([r[6] for r in mine]), own, left, right, np.int64(cell).astype(np.uint64), cosine)
                    if found is not None:
                        out.append(found)
            return out

        def batch_of(found: list) -> pa.RecordBatch:
            columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((),) * 3)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "links", "to"])

        held: list = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[0][:3]:
                    found += done(held)
                    held = []
                held.append(row)
            yield batch_of(found)
        if held:
            yield batch_of(done(held))

    return run


def near_duplicate_vectors(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    A vector that is NULL, zero, or holds NULL or non-finite components links with nothing; so does a row with a
    NULL id, which is kept with a NULL component. Vectors of different lengths do not link. Rows that share an id share
    a component, and each counts the links of its own vector. Other columns are ignored. No rows in, no rows out.
    """
    bound_batches(vectors.sparkSession)
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(vec).cast("long").alias("vec_id"), F.when(
        F.coalesce(fine, F.lit(False)) & F.col(vec).isNotNull(), F.transform(x, lambda v: v + F.lit(0.0))).alias("x"))
    usable = rows.filter(F.col("x").isNotNull())

    @F.arrow_udf("binary")
    def packed(lists: pa.Array) -> pa.Array:
        return pa.array([np.asarray(v.values, dtype="<f8").tobytes() for v in lists], pa.binary())

    nodes = materialize(usable.groupBy("x").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
                        .select("x", "id", "weight", packed("x").alias("raw")))
    placed = materialize(nodes.select("id", "raw").mapInArrow(_place, "id long, cell long, own boolean"))
    crowd = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("owners"))
    crowd = crowd.filter((F.col("n") > 1) & (F.col("owners") > 0)).select("cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", "cell"), F.col("parts")).cast("int")
    dealt = placed.join(crowd, "cell").withColumn("part", part).select(
        "id", "cell", "own", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("id", "cell", "own", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    sent = dealt.join(nodes.select("id", "weight", "raw"), "id").select("cell", "lo", "hi", "id", "own", "weight", "raw", "part")
    found = materialize(sent.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
                        .mapInArrow(_link(cosine), "id long, links long, to long"))
    groups = materialize(components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = nodes.join(links, "id", "left").join(groups, "id", "left").select(
        "x", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    classes = materialize(usable.select("vec_id", "x").join(classes, "x").select("vec_id", "n_links", "component_id"))
    for old in (placed, nodes, found, groups):
        drop_materialized(old)
    rest = rows.filter(F.col("x").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return classes.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
