import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tillspark.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + 2])) for i in range(0, len(below), 2)])
    return levels


def plain_proof(levels, i):
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append("" if j >= len(level) else "lr"[j > i] + level[j])
        i //= 2
    return out


def plain_manifest(rows):
    """rows: (part, id, leaf, changed). Per row its subroot, root, proof and the root of its version."""
    parts = sorted({p for p, *_ in rows}, key=lambda p: (p is not None, (p or "").encode()))
    trees = []
    for part in parts:
        own = sorted((r for r in rows if r[0] == part), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees.append((own, plain_levels([r[2] for r in own])))
    top = plain_levels([t[-1][0] for _, t in trees])
    out = []
    for at, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            proof = plain_proof(levels, i) + plain_proof(top, at)
            node = r[3]
            for s in proof:
                node = sha(s[1:] + node) if s[:1] == "l" else sha(node + s[1:])
            out.append((r[0], r[1], r[2], levels[-1][0], top[-1][0], tuple(proof), node))
    return sorted(out, key=repr)


def run(df, block=merkle.BLOCK_LEVELS):
    out = merkle.manifest(df, ["doc_id"], block).collect()
    return sorted(((r.part, r.doc_id, r.leaf, r.subroot, r.root, tuple(r.proof), r.version_root) for r in out), key=repr)


@pytest.mark.parametrize("block", [1, 3, merkle.BLOCK_LEVELS])
def test_equals_the_plain_tree(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice([None, "", "de", "en", "en", "en", "fr", "é"]), i, sha(str(i)), sha(str(i if rng.random() < 0.8 else -i))) for i in range(230)]
    rows += [("lone", 999, sha("x"), sha("y")), ("pair", 5, sha("a"), sha("a")), ("pair", 6, sha("b"), sha("c"))]
    df = spark.createDataFrame(rows, "part string, doc_id long, leaf string, changed string").withColumns(
        {c: F.lit("x") for c in ("node", "pos", "n", "block", "path", "_at", "name")}).repartition(5)
    assert run(df, block) == plain_manifest(rows)


def test_small_and_odd_tables(spark):
    schema = "part string, doc_id long, leaf string, changed string"
    assert run(spark.createDataFrame([], schema)) == []
    one = [(None, None, sha("l"), sha("m"))]
    assert run(spark.createDataFrame(one, schema)) == plain_manifest(one)
    assert plain_manifest(one)[0][-1] == sha("m")
    # Repeated rows and ids, NULL ids: each is a leaf.
    rows = [("a", 1, sha("l"), sha("l"))] * 5 + [("a", 1, sha("k"), sha("j")), ("a", None, sha("n"), sha("o")), ("a", None, sha("m"), sha("m"))]
    assert run(spark.createDataFrame(rows, schema)) == plain_manifest(rows)


def test_versions_share_all_but_the_ancestors():
    nodes = [sha(str(i)) for i in range(11)]
    tree = merkle.Tree(list(nodes), 4)
    before = [list(level) for level in tree.levels]
    version = tree.with_leaf(10, sha("new"))
    assert tree.levels == before and len(version) == 4
    changed = merkle.Tree(nodes[:10] + [sha("new")], 4)
    assert version == [changed.levels[k + 1][10 >> k + 1] for k in range(4)]
    # What is not an ancestor is the same in both.
    for k, (old, new) in enumerate(zip(tree.levels, changed.levels)):
        assert [i for i, (a, b) in enumerate(zip(old, new)) if a != b] == [10 >> k]


def test_leaves_spell_out_every_field(spark):
    df = spark.createDataFrame([(1, "é", None, -3), (None, "", "x", 12)], "doc_id long, source string, lang string, n_chars long")
    got = [r[0] for r in df.select(merkle.leaf(*map(F.col, df.columns))).collect()]
    assert got == [sha("1:12:é-2:-3"), sha("-0:1:x2:12")]


def test_no_table_is_left_but_the_result(spark, sf):
    from tillspark.llm.queries import QUERIES
    from tillspark.runtime import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    for name in ("op12_url_filter", "op13_merkle_manifest"):
        before = {f for f in os.listdir(folder) if f.startswith("scratch-")}
        QUERIES[name](spark, sf).collect()
        assert len({f for f in os.listdir(folder) if f.startswith("scratch-")} - before) == 1
