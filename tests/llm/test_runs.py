import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tillspark.llm import queries, runs


def plain_runs(words, least=runs.LEAST_LENGTH):
    """Every run by comparing all words at every distance: (start, length, period)."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            first = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > first and i - first + q >= max(least, 2 * q):
                found.setdefault((first, i - first + q), q)
            i += i == first
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng):
    kind, n = rng.randint(0, 5), rng.randint(0, 90)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return [rng.choice("abc") for _ in range(rng.randint(1, 25))] * rng.randint(1, 6)
    if kind == 2:
        return ["a"] * n
    if kind == 3:
        a, b = "a", "ab"
        for _ in range(rng.randint(1, 8)):
            a, b = b, b + a
        return list(b)
    if kind == 4:
        # Two stretches of one period, side by side: every odd distance is a period of its own.
        return list("ab" * rng.randint(2, 14)) + list("ba" * rng.randint(2, 14))
    words = [str(rng.randint(0, 40)) for _ in range(n)]
    return words + words[len(words) // 2:] * 2


def test_runs_equal_brute_force(spark, docs_of):
    rng = random.Random(3)
    texts = [" ".join(made(rng)) for _ in range(400)]
    rows = docs_of(list(enumerate(texts))).repartition(3)
    for r in runs.periodic_runs(rows).collect():
        words = texts[r.doc_id].split()
        want = plain_runs(words)
        found = r["found_"]
        assert [tuple(x) for x in found.runs] == want
        assert found.n_words == len(words)
        assert found.collapsed == plain_collapsed(words, want)


def test_odd_texts(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [None, "", " \t\n", "x " * 12, "x " * 11, "a\x0bb\x0c" * 6, "a\x1fb a b " * 8, long + " " + long, "x " * 12]
    out = {r.doc_id: r["found_"] for r in runs.periodic_runs(docs_of(list(enumerate(texts)))).collect()}
    assert [out[i].n_words for i in range(3)] == [0, 0, 0]
    assert out[0].runs == [] and out[0].collapsed == ""
    assert [tuple(r) for r in out[3].runs] == [(0, 12, 1)] == [tuple(r) for r in out[8].runs]
    assert out[3].collapsed == "x" and out[4].runs == []
    assert [tuple(r) for r in out[5].runs] == [(0, 12, 2)]
    # Other separators and spaces belong to words.
    assert [tuple(r) for r in out[6].runs] == [(0, 16, 2)]
    assert [tuple(r) for r in out[7].runs] == [(0, 120_000, 60_000)] and out[7].collapsed == long
    assert runs.periodic_runs(docs_of([])).collect() == []


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 200):
        values = rng.permutation(n)
        tree = runs.WaveletMatrix(values)
        low = rng.integers(0, n, 50)
        high = np.array([rng.integers(x, n) + 1 for x in low])
        value = rng.integers(0, 2 * n + 2, 50)
        assert (tree.count_below(low, high, value) == [np.sum(values[a:b] < v) for a, b, v in zip(low, high, value)]).all()
        rank = np.array([rng.integers(0, b - a) for a, b in zip(low, high)])
        assert (tree.smallest(low, high, rank) == [np.sort(values[a:b])[r] for a, b, r in zip(low, high, rank)]).all()


def test_the_query_equals_its_contract(spark, sf):
    out = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    changed = 0
    for d in docs:
        words = (d.text or "").encode().split()
        h = zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            changed += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        words = [w.decode() for w in words]
        # The plain search is quadratic: long texts are compared by their digests' parts only where it can end.
        if len(words) > 1500:
            continue
        found = plain_runs(words)
        r = out[d.doc_id]
        assert r.n_runs == len(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()
    assert changed
    assert sum(r.n_runs > 0 for r in out.values()) >= changed // 2


def test_copies_and_ties_are_judged_alike(spark):
    rows = spark.createDataFrame([(1, "p q " * 9), (1, "p q " * 9), (None, "p q " * 9)], "doc_id long, text string")
    out = [r["found"] for r in runs.periodic_runs(rows).collect()]
    assert out[0] == out[1] == out[2]
    assert spark.createDataFrame([], "doc_id long, text string").transform(runs.periodic_runs).select(F.count("*")).first()[0] == 0
