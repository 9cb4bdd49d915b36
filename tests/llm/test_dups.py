import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tillspark import runtime
from tillspark.llm import near_dups, repeats, vector_dups
from tillspark.llm.shared import components


def groups_of(n, links):
    low = list(range(n))
    for a, b in sorted(links):
        x, y = low[a], low[b]
        low = [min(x, y) if v in (x, y) else v for v in low]
    return low


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 420)] + [(7, 7)]
    want = groups_of(421, edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def weighted(a, b):
    a, b = Counter(a.tolist()), Counter(b.tolist())
    return sum((a & b).values()) / sum((a | b).values())


def test_signatures_are_unbiased_for_weights():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for times in ((1, 1), (1, 3), (2, 7), (5, 5)):
        a = np.repeat(base[:300], times[0])
        b = np.concatenate((np.repeat(base[100:300], times[1]), base[300:350]))
        got = near_dups.signatures([a, b, a.copy(), base[:1]], 4096)
        assert abs((got[0] == got[1]).mean() - weighted(a, b)) < 0.03
        assert (got[0] == got[2]).all()
        assert near_dups.overlap(a, b) == weighted(a, b)


def test_signature_does_not_depend_on_company():
    rng = np.random.default_rng(6)
    bags = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 50, 2000)]
    together = near_dups.signatures(bags)
    for bag, row in zip(bags, together):
        assert (near_dups.signatures([bag])[0] == row).all()


def brute_groups(rows, similarity=0.8):
    bags = {i: near_dups.shingles(near_dups.words_of(t)) for i, (d, t) in enumerate(rows) if d is not None and near_dups.words_of(t)}
    links = [(a, b) for a, b in itertools.combinations(bags, 2) if weighted(bags[a], bags[b]) >= similarity]
    links += [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if rows[a][0] is not None and rows[a][0] == rows[b][0]]
    low = groups_of(len(rows), links)
    return [None if d is None else min(rows[i][0] for i in range(len(rows)) if low[i] == low[k]) for k, (d, _) in enumerate(rows)]


def edited(text, every, seed):
    rng, words = random.Random(seed), text.split()
    for i in range(rng.randrange(every), len(words), every):
        words[i] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_are_those_of_brute_force(docs_of, prose):
    texts = [prose(120, s) for s in range(12)]
    rows = [(10 + i, t) for i, t in enumerate(texts)]
    rows += [(100 + 10 * i + k, edited(t, every, 31 * i + k)) for i, t in enumerate(texts[:6]) for k, every in enumerate((120, 70, 40, 25, 12))]
    rows += [(1, texts[3]), (400, texts[3]), (401, " ".join(texts[4].split()).upper()), (402, texts[5] + " tail end here"),
             (500, None), (501, ""), (502, "..."), (503, "three short words"), (504, "three short words"), (505, "three short word"),
             (None, texts[0]), (600, "same same " * 80), (601, "same same " * 100), (602, "same same " * 150), (603, prose(20_000, 77))]
    rows += [(603, prose(20_000, 77))]
    got = near_dups.near_duplicates(docs_of(rows)).collect()
    assert sorted(map(str, ((r.doc_id, r.class_id) for r in got))) == sorted(map(str, zip((d for d, _ in rows), brute_groups(rows))))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in got)


def test_near_duplicate_chain_and_crowd(docs_of, prose):
    # A chain: neighbours are similar, the ends are not; and a crowd in one bucket with two groups.
    words, chain = prose(200, 9).split(), []
    for i in range(8):
        chain.append(" ".join(words))
        words = words[12:] + prose(12, 50 + i).split()
    rows = list(enumerate(chain)) + [(100 + i, edited(prose(300, 4), 150, i)) for i in range(40)]
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs_of(rows)).collect()}
    assert got == dict(zip((d for d, _ in rows), brute_groups(rows)))


def test_a_loose_crowd_in_chunks(docs_of, prose, monkeypatch):
    """Texts that differ from a common one in some places each, so that many pairs of a bucket are no links."""
    rng = random.Random(12)
    base = prose(150, 5).split()
    rows = []
    for i in range(160):
        words = list(base)
        for k in rng.sample(range(150), rng.randint(0, 7)):
            words[k] = f"w{rng.randint(0, 999)}"
        rows.append((i, " ".join(words)))
    want = brute_groups(rows)
    for chunk in (near_dups.CHUNK, 3000):
        monkeypatch.setattr(near_dups, "CHUNK", chunk)
        got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs_of(rows)).collect()}
        assert got == dict(enumerate(want))


def test_near_duplicates_of_nothing(docs_of):
    assert near_dups.near_duplicates(docs_of([])).count() == 0
    assert [tuple(r)[:3] for r in near_dups.near_duplicates(docs_of([(1, None)])).collect()] == [(1, 1, True)]


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 1.5
    found = vector_dups.decode(x)
    again = found[:, None, :] + vector_dups.roots()[None]
    assert (((x - found) ** 2).sum(axis=1)[:, None] <= ((x[:, None, :] - again) ** 2).sum(axis=2) + 1e-9).all()
    doubled = np.rint(2 * found).astype(int)
    assert (np.abs(2 * found - doubled) < 1e-9).all() and ((doubled % 2 == doubled[:, :1] % 2).all()) and (found.sum(axis=1) % 2 == 0).all()
    assert len(vector_dups.roots()) == 240


def vectors(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.selectExpr("*", "1 AS id", "2 AS x", "3 AS label", "4 AS links", "'a' AS cell")


def brute_vectors(rows, cosine=0.9):
    n, links = len(rows), []
    fine = [v is not None and d is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for d, v in rows]
    for a, b in itertools.combinations(range(n), 2):
        if fine[a] and fine[b] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links.append((a, b))
    degree = Counter(i for link in links for i in link)
    low = groups_of(n, links)
    return [(d, degree[k], None if d is None else min(rows[i][0] for i in range(n) if low[i] == low[k])) for k, (d, _) in enumerate(rows)]


def test_vector_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows, at = [], 0
    for size in (40, 25, 3, 1, 1, 1, 1):
        centre = rng.normal(size=48)
        for _ in range(size):
            rows.append((at, (centre + 0.15 * rng.normal(size=48)).tolist()))
            at += 7
    rows += [(1, rows[0][1]), (2, rows[0][1]), (3, [5 * v for v in rows[0][1]]), (4, None), (5, [0.0] * 48), (6, [float("nan")] + [1.0] * 47),
             (8, [None] + [1.0] * 47), (9, [float("inf")] * 48), (None, rows[0][1]), (10, [1.0, 2.0]), (11, [1.0, 2.1]), (12, [1e300, 2e300]), (13, [])]
    want = sorted(brute_vectors(rows), key=str)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vector_dups.near_duplicate_vectors(vectors(spark, rows)).collect()), key=str)
    assert got == want
    # Crowded cells are cut into chunks: the same counts.
    monkeypatch.setattr(vector_dups, "CHUNK", 8)
    cut = vector_dups.near_duplicate_vectors(vectors(spark, rows))
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in cut.collect()), key=str) == want
    assert vector_dups.near_duplicate_vectors(vectors(spark, [], "float")).count() == 0


def test_vector_recall_at_the_limit(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.902 * a + np.sqrt(1 - 0.902**2) * z
    rows = [(2 * i + k, v[i].tolist()) for i in range(400) for k, v in enumerate((a, b))]
    got = vector_dups.near_duplicate_vectors(vectors(spark, rows))
    assert got.groupBy().sum("n_links").first()[0] >= 0.9 * sum(n for _, n, _ in brute_vectors(rows))


def brute_repeats(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = np.diff(np.concatenate(([0], gone[:-1].astype(int), [0])))
        out.append((list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())), np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()))
    return out


def test_repeats_are_those_of_brute_force(docs_of):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé ") for _ in range(3000))
    texts = [None, "", "a" * 399, "a" * 400, "a" * 401, "xy" * 700, base[:900], base[300:1500], "Q" + base[:700] + "Z",
             base[200:610] + "!" + base[200:610], base[1000:1400], base[1001:1401], base + base[:500]]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) + base[i:i + 420 + i % 30] + str(i) for i in range(0, 400, 7)]
    texts += [texts[-1], texts[-1]]
    want = brute_repeats(texts)
    for hot in (repeats.HOT, 3):
        got = {r.doc_id: r for r in repeats.remove_repeats(docs_of(enumerate(texts)), hot=hot).select("doc_id", "cut_").collect()}
        for i, (spans, kept) in enumerate(want):
            assert ([tuple(s) for s in got[i].cut_.spans], bytes(got[i].cut_.kept)) == (spans, kept), i


def python_functions_of_a_task(df):
    """The most functions in Python, each with a worker of its own, that one task of the plan runs."""
    def most(node, above):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return most(node.executedPlan(), above)
        above = 0 if "Exchange" in name else above + bool(re.search("Python|Arrow|Pandas", name))
        children = [node.children().apply(i) for i in range(node.children().size())]
        return max([above, *(most(c, above) for c in children)])

    return most(df._jdf.queryExecution().executedPlan(), 0)


def test_repeats_have_one_python_worker_a_task(docs_of, monkeypatch, prose):
    stored, seen = runtime.materialize_counted, []

    def watched(df):
        seen.append(python_functions_of_a_task(df))
        return stored(df)

    monkeypatch.setattr(runtime, "materialize_counted", watched)
    monkeypatch.setattr(repeats, "materialize_counted", watched)
    base = prose(300, 7)
    texts = [base, base[:900], base[100:1200] + "!", prose(200, 8), *(base[:500 + i] + prose(9, i) for i in range(9)), None]
    out = repeats.remove_repeats(docs_of(enumerate(texts)), hot=3)
    assert max(seen) == 1 and python_functions_of_a_task(out) == 1
    got = {r.doc_id: r.cut_ for r in out.select("doc_id", "cut_").collect()}
    for i, (spans, kept) in enumerate(brute_repeats(texts)):
        assert ([tuple(s) for s in got[i].spans], bytes(got[i].kept), got[i].kept_text) == (spans, kept, kept.decode("utf-8", "ignore")), i


def test_repeats_of_bytes_that_are_no_text(spark):
    docs = spark.createDataFrame([(1, b"ab\xff\xfecd"), (2, "é".encode())], "doc_id long, b binary").selectExpr("doc_id", "CAST(b AS STRING) AS text")
    got = {r.doc_id: r.cut for r in repeats.remove_repeats(docs).select("doc_id", "cut").collect()}
    assert {k: (bytes(c.kept).decode("utf-8", "ignore"), c.spans) for k, c in got.items()} == {k: (c.kept_text, []) for k, c in got.items()}
    assert got[2].kept_text == "é"


def test_signatures_are_made_of_few_shingles_at_once(monkeypatch, prose):
    bags = [near_dups.shingles(near_dups.words_of(prose(n, n))) for n in (3, 700, 40, 900, 5, 2500, 300, 300)]
    whole, sizes, sign = near_dups.signatures(bags), [], near_dups.signatures
    monkeypatch.setattr(near_dups, "SIGNED_AT_ONCE", 1000)
    monkeypatch.setattr(near_dups, "signatures", lambda some: sizes.append([len(b) for b in some]) or sign(some))
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "t1": [0] * 8, "t2": [0] * 8, "text": [prose(n, n) for n in (3, 700, 40, 900, 5, 2500, 300, 300)]})
    (signed,) = near_dups._sign([texts])
    assert signed.column("slots").to_pylist() == [x.astype(np.uint16).tobytes() for x in whole]
    assert sum(map(len, sizes)) == 8 and all(sum(s) <= 1000 or len(s) == 1 for s in sizes)


def test_repeats_of_long_texts_in_slices(docs_of, monkeypatch, prose):
    monkeypatch.setattr(repeats, "SLICE", 1000)
    data = (prose(2000, 1) + prose(300, 2) + prose(2000, 3) + prose(300, 2)).encode()
    whole = repeats.triggers(data, np.array([0, len(data)]))
    parts = [(x + keys[0][1], lo + keys[0][1], hi + keys[0][1]) for keys, part, bounds in repeats._slices([(0,)], [data])
             for _, x, lo, hi in zip(*repeats.triggers(part, bounds))]
    covered = {(x, s) for x, lo, hi in parts for s in range(lo, hi + 1)}
    assert covered == {(x, s) for _, x, lo, hi in zip(*whole) for s in range(lo, hi + 1)}
    assert {s for _, s in covered} == set(range(len(data) - repeats.LENGTH + 1))


def test_repeats_of_nothing(docs_of):
    assert repeats.remove_repeats(docs_of([])).count() == 0
    out = repeats.remove_repeats(docs_of([(None, "short"), (1, None)]))
    assert out.columns[:3] == ["doc_id", "text", "id"] and out.filter("size(cut_.spans) > 0").count() == 0


def test_repeats_query(spark, sf):
    from tillspark.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d.doc_id: (len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for d, (spans, kept) in zip(docs, brute_repeats([d.text for d in docs]))}
    for r in QUERIES["op7_repeats"](spark, sf).collect():
        assert (r.n_bytes - r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
