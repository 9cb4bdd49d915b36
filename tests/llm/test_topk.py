import numpy as np
from pyspark.sql import functions as F

from tillspark.llm import topk


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.selectExpr("*", "1 AS id", "2 AS x", "3 AS cell", "4 AS block")


def brute(rows, every, k):
    fine = {(d, tuple(np.floor(256 * np.array(v, float)))) for d, v in rows
            if d is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    out = []
    for q in sorted({d for d, _ in fine if d % every == 0}):
        scores = [(-int(np.dot(x, y)), e) for d, x in fine if d == q for e, y in fine if e != q and len(x) == len(y)]
        out += [(q, r, e, -s) for r, (s, e) in enumerate(sorted(scores)[:k], 1)]
    return out


def run(spark, rows, every=5, k=3, **sizes):
    found = topk.top_k(vectors(spark, rows), F.col("id") % every == 0, k=k, **sizes)
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


def test_exact_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=12) + 3 * (i % 4 == 0)).tolist()) for i in range(160)]
    rows += [(1000 + i, rows[0][1]) for i in range(8)]  # ties
    rows += [rows[0], rows[3], (500, None), (505, [None] * 12), (510, [float("nan")] * 12), (515, [float("inf")] * 12), (None, rows[0][1]),
             (520, [1.0, 2.0]), (521, [2.0, 1.0]), (525, [1e6] * 12), (526, [-1e6] * 12), (530, [0.0] * 12)]
    want = brute(rows, 5, 3)
    assert run(spark, rows) == want
    assert run(spark, rows, block=16, query_block=4) == want


def test_repeated_rows(spark):
    rows = [(5, [1.0, 0.0])] * 3 + [(5, [0.0, 1.0])] * 2 + [(6, [3.0, 1.0])] * 40 + [(7, [1.0, 2.0])] * 2 + [(8, [-1.0, -1.0]), (10, [2.0, 2.0])]
    assert run(spark, rows) == brute(rows, 5, 3)
    assert run(spark, rows, k=45) == brute(rows, 5, 45)
    assert run(spark, rows, k=7, block=4, query_block=1) == brute(rows, 5, 7)


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0])]) == []
    assert run(spark, [(5, [1.0]), (6, [2.0])]) == [(5, 1, 6, 256 * 512)]


def test_tree_covers_and_separates():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, size=(700, 6)).astype(float)
    tree = topk.CoverTree(x)
    assert sorted(tree.rows.tolist()) == list(range(700))
    for i, (lo, hi) in enumerate(tree.span):
        assert np.sqrt(((tree.x[lo:hi] - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
        if tree.children[i]:
            spans = [tree.span[c] for c in tree.children[i]]
            assert spans[0][0] == lo and spans[-1][1] == hi and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_pruning_keeps_the_answer_and_saves_work():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 2000
    data = np.rint(centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8)) * 5)
    queries = np.rint(np.repeat(centres[:4], 10, axis=0) + rng.normal(size=(40, 8)))
    seen = []
    search = topk.Search(np.arange(40) - 100, queries, [None] * 40, 5)
    leaves = search._leaves
    search._leaves = lambda lo, hi, a, b: (seen.append((hi - lo) * (b - a)), leaves(lo, hi, a, b))
    search.add(np.arange(3000), data)
    for row, (scores, found) in zip(search.tree.rows, search.best):
        exact = data @ queries[row]
        assert found.tolist() == np.lexsort((np.arange(3000), -exact))[:5].tolist() and scores.tolist() == np.sort(exact)[::-1][:5].tolist()
    assert sum(seen) < 0.7 * 40 * 3000


def test_query_of_the_contract(spark, sf):
    from tillspark.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op10_top_k"](spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 50, 5)
