"""A Merkle manifest of a table: a tree of digests per part, a tree over the parts, and versions by path copying.

Leaves are numbered per part in order. A tree pairs neighbours, the last of an odd level goes up alone, until one node is
left. ``2 ** BLOCK_LEVELS`` neighbours form an aligned block, whose levels one task computes; the tops of the blocks are the
nodes of the next tier, and so on, so a tree of any size takes few tiers and no task sees more than a block. The tops of the parts
are numbered in the same way and form the upper tree.

The tree is persistent. A changed leaf makes a version of it: ``Tree.with_leaf`` copies the ancestors inside the block and shares all
other nodes, and goes on above with the copied node and the shared siblings, which come down, tier by tier, as
one path per block. So versions need no tables of their own, however many leaves are changed.

Digests are SHA-256 of their inputs, concatenated; digests that go in do so as lowercase hex.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillspark.llm.shared import bound_batches
from tillspark.runtime import materialize

BLOCK_LEVELS = 10


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it enters a leaf: its number of UTF-8 bytes, a colon, its text; ``-`` for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v).cast("binary") for v in values)), 256)


class Tree:
    """The levels above one block's nodes, up to ``height``."""

    def __init__(self, nodes: list[str], height: int):
        self.levels = [nodes]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([digest(*below[i:i + 2]) for i in range(0, len(below), 2)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, i: int) -> list[str]:
        """The siblings of node ``i`` and of its ancestors: ``l`` or ``r``, its side, and the digest; empty where there is none."""
        out = []
        for level in self.levels[:-1]:
            j = i ^ 1
            out.append("" if j >= len(level) else ("l" if j < i else "r") + level[j])
            i >>= 1
        return out

    def with_leaf(self, i: int, node: str) -> list[str]:
        """A version in which node ``i`` is ``node``: the copied ancestors from below to the top. All others are this tree's."""
        return copied(node, self.path(i))


def copied(node: str, path: list[str]) -> list[str]:
    """The ancestors of ``node`` that its siblings on the path give."""
    out = []
    for sibling in path:
        pair = (sibling[1:], node) if sibling[:1] == "l" else (node, sibling[1:])
        node = digest(*pair)
        out.append(node)
    return out


def _height(n: int, most: int) -> int:
    """Levels above a block in a tier of n nodes, of ``most`` levels at the most."""
    return min(most, (n - 1).bit_length())


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The rows, their number ``pos`` from 0 within their ``part``, by ``order``, and ``n``, the size of the part.

    Rows are dealt out by ranges, numbered as they lie there, and shifted by the ranges before; rows equal in all of ``order`` are
    told apart by where they are stored. ``nodes`` must be a stored table.
    """
    columns = ["part", *order, "_tie"]
    ranged = materialize(
        nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*columns).sortWithinPartitions(*columns)
        .drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    )
    whole = W.partitionBy("part")
    before = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranged.groupBy("part", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")).select(
        "part", "_range", F.sum("_rows").over(whole).alias("n"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ranged.join(materialize(ranges), ["part", "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _blocks(nodes: DataFrame, block_levels: int, *columns: str):
    return nodes.select("part", "pos", "n", "node", *columns).groupBy("part", F.shiftright("pos", block_levels).alias("block"))


def tiers(nodes: DataFrame, block_levels: int) -> list[DataFrame]:
    """Tables (part, pos, n, node) from the nodes given to one node per part, a block in a row of the next.

    A part that ends earlier stays as it is, so the last table has every part once.
    """
    def top(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n, pos = block["n"][0].as_py(), block["pos"][0].as_py()
        node = Tree(block["node"].to_pylist(), _height(n, block_levels)).top
        return pa.table({"part": block["part"][:1], "pos": pa.array([pos >> block_levels]), "n": pa.array([-(-n >> block_levels)]),
                         "node": pa.array([node], pa.string())})

    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(materialize(_blocks(out[-1], block_levels).applyInArrow(top, "part string, pos long, n long, node string")))
        most = -(-most >> block_levels)
    return out


_PATH = "part string, pos long, path array<string>, subroot string, root string"


def paths(tables: list[DataFrame], above: DataFrame, block_levels: int) -> DataFrame:
    """The paths to the root of the nodes in the first of ``tables``; ``above`` has those of the node of the last, per part."""
    def down(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        rest, tree = above["path"][0].as_py(), Tree(block["node"].to_pylist(), _height(block["n"][0].as_py(), block_levels))
        return pa.table({
            "part": block["part"], "pos": block["pos"],
            "path": pa.array([tree.path(i) + rest for i in range(len(block))], pa.list_(pa.string())),
            **{c: pa.array([above[c][0].as_py()] * len(block), pa.string()) for c in ("subroot", "root")},
        })

    for below in reversed(tables):
        above = _blocks(below, block_levels).cogroup(above.groupBy("part", "pos")).applyInArrow(down, _PATH)
    return above


def manifest(leaves: DataFrame, order: list[str], block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per leaf its place in the tree, its proof, and the version of the tree that its change makes.

    ``leaves`` has ``part`` (a string or NULL), ``leaf`` and ``changed`` (lowercase hex), and other columns. Within a part they
    ascend by ``order``, NULL first, then by ``leaf``; parts ascend bytewise, NULL first. Equal rows are leaves of their own. Added are:

    * ``subroot`` of the part, ``root`` of all;
    * ``proof``: the siblings from the leaf to the root, each ``l`` or ``r``, its side, and its digest; empty where there is none;
    * ``version``: the ancestors of ``changed`` from its parent to the root of its version; the last is ``version_root``, which is
      ``changed`` itself if the tree is a single leaf.

    No leaves give no rows. Memory of a task is a block of leaves and their proofs.
    """
    bound_batches(leaves.sparkSession)
    others = [c for c in leaves.columns if c not in ("part", "leaf", "changed")]
    # Other columns keep out of the way of those used here, whatever their names.
    inner = {c: f"_o{i}" for i, c in enumerate(others)}
    key = F.coalesce(F.concat(F.lit("="), "part"), F.lit(""))
    stored = materialize(leaves.select(key.alias("part"), F.col("leaf").alias("node"), "changed", *(F.col(c).alias(i) for c, i in inner.items())))
    bottom = numbered(stored, [inner[c] for c in order] + ["node"])
    lower = tiers(bottom, block_levels)
    tops = lower[-1].select("part", "node") if len(lower) > 1 else bottom.select("part", "node")
    tops = materialize(tops)
    # The parts are the leaves of the upper tree: one part, in their order.
    upper = tiers(numbered(tops.select(F.lit("").alias("part"), F.col("part").alias("name"), "node"), ["name"]), block_levels)
    subroots = upper[0].select("part", "pos", "name", F.col("node").alias("subroot"))
    root = upper[-1].select("part", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("path"),
                            F.lit("").alias("subroot"), F.col("node").alias("root"))
    above = paths(upper[:-1], root, block_levels).join(subroots.withColumnRenamed("subroot", "top"), ["part", "pos"])
    above = above.select(F.col("name").alias("part"), F.lit(0).cast("long").alias("pos"), "path", F.col("top").alias("subroot"), "root")
    kept = [*inner.values()]
    added = StructType.fromDDL("path array<string>, version array<string>, subroot string, root string")
    schema = StructType([*stored.schema, *added])

    def finish(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        tree, rest = Tree(nodes["node"].to_pylist(), _height(nodes["n"][0].as_py(), block_levels)), above["path"][0].as_py()
        routes, versions = [], []
        for i, node in enumerate(nodes["changed"].to_pylist()):
            routes.append(tree.path(i) + rest)
            inside = tree.with_leaf(i, node)
            versions.append(inside + copied(inside[-1] if inside else node, rest))
        own = {c: nodes[c] for c in ("part", "node", "changed", *kept)}
        ends = {c: pa.array([above[c][0].as_py()] * len(nodes), pa.string()) for c in ("subroot", "root")}
        return pa.table(own | {"path": pa.array(routes, pa.list_(pa.string())), "version": pa.array(versions, pa.list_(pa.string()))} | ends)

    above = materialize(paths(lower[1:-1], above, block_levels)) if len(lower) > 1 else above
    done = _blocks(bottom, block_levels, "changed", *kept).cogroup(above.groupBy("part", "pos")).applyInArrow(finish, schema)
    name = F.when(F.col("part") != "", F.substring("part", 2, 1 << 30))
    return done.select(
        *(F.col(i).alias(c) for c, i in inner.items()), name.alias("part"), F.col("node").alias("leaf"), "changed", "subroot", "root",
        F.col("path").alias("proof"), "version",
        F.coalesce(F.try_element_at("version", F.lit(-1)), "changed").alias("version_root"))
