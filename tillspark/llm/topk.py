"""Exact top-k by integer inner product: a dual-tree search over cover trees of queries and data.

Vectors become whole numbers (floor(scale * x)). Data are dealt into cells around a bounded number of pivots, and cells into
blocks of bounded size; queries into blocks likewise. Each block gets its own cover tree: every node has a centre and a
covering radius, and the children of a node lie around centres at least half its radius apart. For a query node
(centre q, radius r) and a data node (centre c, radius s) no inner product exceeds

    q . c + r |c| + s |q| + r s

A pair of nodes is dropped when that is below the worst k-th score of the query node's queries so far; otherwise the larger
node is opened, and two leaves are multiplied out. The same bound, with what queries already found
in the blocks of their own cells, drops whole pairs of blocks before any vector is shipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.llm.shared import bound_batches
from tillspark.runtime import drop_materialized, materialize

SCALE = 256
#: The most pivots of the cells; and about the most vectors of a data or query block.
PIVOTS, BLOCK, QUERY_BLOCK = 1024, 4096, 512
#: Rows of a leaf of the data's tree, and of the queries', where small groups make the bounds tight.
LEAF, QUERY_LEAF = 48, 8


class CoverTree:
    """A cover tree over the rows of ``x`` (float64 holding whole numbers), stored as arrays in depth-first order."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order: list[np.ndarray] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.span: list[tuple[int, int]] = []
        self._placed = 0
        self._build(x, np.arange(len(x)), leaf)
        self.rows = np.concatenate(self.order) if self.order else np.zeros(0, int)
        self.x = x[self.rows]
        self.norm = [float(np.linalg.norm(c)) for c in self.centre]

    def _build(self, x: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        """Adds the node that covers ``rows``; its centre is one of them."""
        at = len(self.centre)
        centre = x[rows[np.argmin(((x[rows] - x[rows].mean(axis=0)) ** 2).sum(axis=1))]]
        far = np.sqrt(((x[rows] - centre) ** 2).sum(axis=1))
        self.centre.append(centre)
        self.radius.append(float(far.max()))
        self.children.append([])
        self.span.append((self._placed, self._placed + len(rows)))
        if len(rows) <= leaf or far.max() == 0:
            self.order.append(rows)
            self._placed += len(rows)
            return at
        # Centres of the next level: any two at least half the radius apart, and every row within that of one.
        half, near, owner, k = far.max() / 2, np.full(len(rows), np.inf), np.zeros(len(rows), int), 0
        while near.max() > half:
            pick = int(np.argmax(near)) if k else int(np.argmax(far))
            d = np.sqrt(((x[rows] - x[rows[pick]]) ** 2).sum(axis=1))
            closer = d < near
            near[closer], owner[closer] = d[closer], k
            k += 1
            if k * leaf > 4 * len(rows):  # no structure at this radius: what is left is halved by nearness
                break
        groups = [rows[owner == i] for i in range(k)]
        if k == 1 or k * leaf > 4 * len(rows):
            by = np.argsort(far, kind="stable")
            groups = [rows[by[:len(by) // 2]], rows[by[len(by) // 2:]]]
        for g in groups:
            if len(g):
                self.children[at].append(self._build(x, g, leaf))
        return at


def _rank(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    return np.lexsort((ids, -scores))[:k]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: in floating point while all sums stay below 2**53, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a @ b.T).astype(np.int64) if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


class Search:
    """Best lists of the queries of one block, against data blocks one after another."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, known: list[int | None], k: int):
        self.k, self.tree = k, CoverTree(x, QUERY_LEAF)
        self.ids = ids[self.tree.rows]
        # A score that k others are already known to reach; what is below it cannot be in the answer.
        self.worst = np.array([-np.inf if known[i] is None else known[i] for i in self.tree.rows])
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.data, self.data_ids = CoverTree(x), ids
        self.data_ids = ids[self.data.rows]
        stack = [(0, 0)]
        while stack:
            q, c = stack.pop()
            a, b = self.tree, self.data
            lo, hi = a.span[q]
            reach = (float(a.centre[q] @ b.centre[c]) + a.radius[q] * b.norm[c] + b.radius[c] * a.norm[q]
                     + a.radius[q] * b.radius[c])
            # Slack for the rounding of radii and norms; scores are whole numbers.
            if reach + abs(reach) * 1e-9 + 1e-6 < self.worst[lo:hi].min():
                continue
            if not a.children[q] and not b.children[c]:
                self._leaves(lo, hi, *b.span[c])
            elif not a.children[q] or b.children[c] and b.radius[c] >= a.radius[q]:
                kids = b.children[c]
                # The most promising child is searched first: it is pushed last.
                gains = [float(a.centre[q] @ b.centre[i]) + b.radius[i] * a.norm[q] for i in kids]
                stack += [(q, kids[i]) for i in np.argsort(gains)]
            else:
                stack += [(i, c) for i in a.children[q]]

    def _leaves(self, lo: int, hi: int, start: int, stop: int) -> None:
        scores = _product(self.tree.x[lo:hi], self.data.x[start:stop])
        ids = self.data_ids[start:stop]
        for i, row in enumerate(scores, lo):
            good = np.flatnonzero((row >= self.worst[i]) & (ids != self.ids[i]))
            if len(good):
                s, d = np.concatenate((self.best[i][0], row[good])), np.concatenate((self.best[i][1], ids[good]))
                keep = _rank(s, d, self.k)
                self.best[i] = s[keep], d[keep]
                if len(keep) == self.k:
                    self.worst[i] = max(self.worst[i], float(s[keep[-1]]))


_BLOCK = "cell int, block long, side int, n long, centre array<double>, radius double, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score long"


def _whole(vectors: DataFrame, vec: str, embedding: str, scale: int) -> DataFrame:
    """(id, x): usable vectors as whole numbers."""
    x = F.col(embedding).cast("array<double>")
    ok = x.isNotNull() & F.col(vec).isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return vectors.filter(ok).select(F.col(vec).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("x"))


def _pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """One block as one row, with its centre and covering radius."""
    ids, x = group["id"].to_numpy().astype("<i8"), np.stack(group["x"].to_numpy())
    centre = x.mean(axis=0)
    row = {"cell": key[1].as_py(), "block": key[2].as_py(), "side": key[0].as_py(), "n": len(ids), "centre": centre.tolist(),
           "radius": float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()), "ids": ids.tobytes(), "vectors": x.astype("<f8").tobytes()}
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.binary()]
    return pa.table({name: pa.array([value], kind) for (name, value), kind in zip(row.items(), kinds)})


def _cell(sent, most: int):
    """A column function: the nearest of the first ``most`` pivots; vectors of another length get cell -1 - length."""
    @F.arrow_udf("int")
    def cell(vectors: pa.Array) -> pa.Array:
        m = sent.value[:most]
        sizes = np.array([len(v) for v in vectors], dtype=np.int64)
        out = -1 - sizes
        fit = np.flatnonzero(sizes == m.shape[1]) if len(m) else []
        if len(fit):
            v = np.stack(vectors.take(pa.array(fit)).to_numpy(zero_copy_only=False)).astype(float)
            out[fit] = np.argmin((m**2).sum(axis=1) - 2 * v @ m.T, axis=1)
        return pa.array(out.astype(np.int32))

    return cell


def _blocks(x: DataFrame, is_query: Column, block: int, query_block: int) -> DataFrame:
    """All blocks, side 0 of data and side 1 of queries."""
    x = materialize(x.distinct())
    size = x.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    cells, query_cells = (min(PIVOTS, max(1, -(-n // b))) for n, b in ((size.n, block), (size.q, query_block)))
    pivots = [r.x for r in x.orderBy(F.xxhash64("id"), "id", "x").limit(cells).collect()]
    sent = x.sparkSession.sparkContext.broadcast(np.array([p for p in pivots if len(p) == len(pivots[0])]) if pivots else np.zeros((0, 0)))
    data = x.select("id", "x", _cell(sent, cells)("x").alias("cell"), F.lit(0).alias("side"))
    sides = data.unionByName(
        x.filter(is_query).select("id", "x", _cell(sent, query_cells)("x").alias("cell"), F.lit(1).alias("side")))
    placed = materialize(sides)
    # A crowded cell is cut by a hash of the rows; there are at most as many counts as pivots and vector lengths.
    most = F.when(F.col("side") == 0, block).otherwise(query_block)
    parts = placed.groupBy("side", "cell").agg(F.count(F.lit(1)).alias("n")).select("side", "cell", F.ceil(F.col("n") / most).alias("parts"))
    dealt = placed.join(parts, ["side", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", "x", F.lit(7)), F.col("parts")))
    blocks = materialize(dealt.groupBy("side", "cell", "block").applyInArrow(_pack, _BLOCK))
    drop_materialized(placed)
    drop_materialized(x)
    return blocks


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _may_reach(centre: str, radius: str) -> Column:
    """Whether a ball may hold a vector as good as the floor of a ball of queries (qcentre, qradius, qfloor)."""
    norm = lambda c: F.sqrt(_dot(c, c))
    reach = (_dot("qcentre", centre) + F.col("qradius") * norm(centre)
             + F.col(radius) * norm("qcentre") + F.col("qradius") * F.col(radius))
    return F.col("qfloor").isNull() | (reach + F.abs(reach) * 1e-9 + 1e-6 >= F.col("qfloor"))


def _pairs(queries: DataFrame, data: DataFrame) -> DataFrame:
    """(qcell, qblock, dcell, dblock): pairs of blocks that can still matter, by centres and radii alone.

    Blocks of queries meet the balls around whole cells first, which are no more than the pivots and vector lengths,
    and then the blocks of the cells that are left.
    """
    balls = data.select(F.col("cell").alias("dcell"), F.col("block").alias("dblock"), F.col("centre").alias("dcentre"),
                        F.col("radius").alias("dradius"))
    middles = balls.groupBy("dcell").agg(F.min_by("dcentre", "dblock").alias("centre"), F.max("dblock").alias("last"))
    gap = F.zip_with("centre", "dcentre", lambda a, b: a - b)
    cells = balls.join(middles, "dcell").groupBy("dcell").agg(
        F.first("centre").alias("centre"), F.first("last").alias("last"),
        F.max((F.sqrt(_dot(gap, gap)) + F.col("dradius")) * (1 + 1e-9)).alias("radius"))
    # All blocks of queries have the same key, the length of their vectors, so cells are repeated for each lane of them.
    lanes = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.select(*(F.col(c).alias(f"q{c}") for c in ("cell", "block", "centre", "radius", "floor"))).withColumns(
        {"lane": F.pmod(F.hash("qcell", "qblock"), F.lit(lanes)), "dim": F.size("qcentre")})
    around = cells.withColumns({"lane": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))), "dim": F.size("centre")})
    near = asked.join(around, ["dim", "lane"]).filter(_may_reach("centre", "radius"))
    near = near.drop("centre", "radius").withColumn("dblock", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    return near.join(balls, ["dcell", "dblock"]).filter(_may_reach("dcentre", "dradius")).select("qcell", "qblock", "dcell", "dblock")


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        arrays = lambda r: (np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], "<f8").reshape(r["n"], -1))
        queries = [r for r in rows if r["side"] == 1]
        out = []
        for q in queries:
            ids, x = arrays(q)
            search = Search(ids, x, q["known"] or [None] * len(ids), k)
            for d in sorted((r for r in rows if r["side"] == 0), key=lambda r: (r["cell"], r["block"])):
                search.add(*arrays(d))
            out += [(int(i), int(d), int(s)) for i, (scores, found) in zip(search.ids, search.best) for s, d in zip(scores, found)]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def top_k(
    vectors: DataFrame, is_query: Column, vec: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: int = SCALE,
    block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` best other rows, exactly; ties to the smaller id.

    ``is_query`` is a condition on a column ``id``, the row's id. Rows with a NULL id, vector or component, or a component
    that is not finite, take no part; a query of another length than a vector is not compared with it. Rows that
    share an id are compared by others each for itself, and never with each other; as queries they have one answer, the best
    scores of any of them. Rows alike in id and whole-number vector count once. Scores must fit a 64-bit integer. A
    query without other rows has no answer. Other columns are ignored. No rows in, no rows out.
    """
    bound_batches(vectors.sparkSession)
    blocks = _blocks(_whole(vectors, vec, embedding, scale), is_query, block, query_block)
    data = blocks.filter("side = 0").withColumn("known", F.lit(None).cast("array<long>"))
    queries = blocks.filter("side = 1")
    name = lambda t: F.concat_ws("/", f"{t}cell", f"{t}block")

    # First each query block meets one data block of its own cell: any k scores give a valid floor.
    first = queries.withColumn("known", F.lit(None).cast("array<long>")).withColumn("pair", name(""))
    meets = first.select("cell", "pair", F.pmod("block", F.lit(1 << 30)).alias("b")).join(
        data.groupBy("cell").agg(F.count(F.lit(1)).alias("parts")), "cell").select("pair", "cell", F.pmod("b", "parts").alias("block"))
    seeds = first.unionByName(data.join(meets, ["cell", "block"]).select(*data.columns, "pair"))
    found = materialize(seeds.groupBy("pair").applyInArrow(_search(k), _FOUND))
    floors = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))

    # The floors of a block's queries, in the order of its ids.
    @F.arrow_udf("array<long>")
    def split_ids(raw: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(r.as_py(), "<i8").tolist() for r in raw], pa.list_(pa.int64()))

    listed = queries.select("cell", "block", F.posexplode(split_ids("ids")).alias("at", "query_id")).join(floors, "query_id", "left")
    known = listed.groupBy("cell", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "floor"))), lambda s: s["floor"]).alias("known"),
        F.when(F.count("floor") == F.count(F.lit(1)), F.min("floor")).alias("floor"))
    queries = materialize(queries.join(known, ["cell", "block"]))

    pairs = materialize(_pairs(queries, data).withColumn("pair", F.concat_ws("/", "qcell", "qblock", "dcell", "dblock")))
    ends = lambda c: pairs.select(F.col(f"{c}cell").alias("cell"), F.col(f"{c}block").alias("block"), "pair")
    columns = [*data.columns, "pair"]
    work = queries.join(ends("q"), ["cell", "block"]).select(*columns).unionByName(data.join(ends("d"), ["cell", "block"]).select(*columns))
    every = work.groupBy("pair").applyInArrow(_search(k), _FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
