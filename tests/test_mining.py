import random
from itertools import combinations

import brute
import pytest
from pyspark.sql import functions as F

from tillspark import MiningSettings, mine
from tillspark.mining.apriori import apriori_itemsets
from tillspark.mining.counting import Block, count_itemsets, frequent_pairs, partial_counts
from tillspark.mining.fpgrowth import by_kinds, fpgrowth_itemsets
from tillspark.mining.job import prepared
from tillspark.mining.rules import _splits, association_rules
from tillspark.mining.son import son_candidates, son_itemsets
from tillspark.mining.threshold import min_count
from tillspark.schemas import BASKET

SET = "items array<string>, freq long"
ALGORITHMS = ("fpgrowth", "apriori", "son")


def frame(spark, baskets, parts=3):
    return spark.createDataFrame([(str(i), b) for i, b in enumerate(baskets)], BASKET).repartition(parts)


def as_dict(itemsets):
    rows = itemsets.collect()
    found = {tuple(r["items"]): r["freq"] for r in rows}
    assert len(found) == len(rows)
    return found


def as_rules(rules):
    return {
        (tuple(r["antecedents"]), tuple(r["consequents"])): (r["confidence"], r["support"], r["lift"])
        for r in rules.collect()
    }


def random_baskets(seed, n=80, items=9):
    rng = random.Random(seed)
    names = [f"i{k}, \"{k}\" || é" for k in range(items)]
    return [rng.sample(names, rng.randint(1, items - 2)) for _ in range(n)]


@pytest.mark.parametrize("algorithm", ALGORITHMS)
@pytest.mark.parametrize("seed,support", [(1, "0.2"), (2, "0.15")])
def test_itemsets_and_rules_equal_brute_force(spark, algorithm, seed, support):
    baskets = random_baskets(seed)
    want = brute.itemsets(baskets, support)
    found = mine(frame(spark, baskets), MiningSettings(float(support), 0.3, algorithm))
    assert as_dict(found.itemsets) == want
    assert max(len(s) for s in want) >= 3
    rules = as_rules(found.rules)
    assert rules == brute.rules(want, len(baskets), 0.3)
    assert any(len(c) > 1 for _, c in rules)


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_threshold_is_exact(spark, algorithm):
    seven = [["a", "b"]] * 7 + [["c", "d"]] * 93
    assert len(as_dict(mine(frame(spark, seven), MiningSettings(0.07, 0.5, algorithm)).itemsets)) == 6
    for k, expected in ((28, 3), (29, 6)):
        df = frame(spark, [["a", "b"]] * k + [["c", "d"]] * (100 - k))
        assert len(as_dict(mine(df, MiningSettings(0.29, 0.5, algorithm)).itemsets)) == expected


def test_min_count():
    assert min_count(0.07, 100) == 7 and min_count(0.29, 100) == 29 and min_count(0.001, 10) == 1
    assert min_count(0.0715, 100) == 8


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_degenerate_baskets(spark, algorithm):
    settings = MiningSettings(0.5, 0.5, algorithm)
    empty = mine(frame(spark, [["a"]]).limit(0), settings)
    assert empty.itemsets.count() == 0 and empty.rules.count() == 0
    odd = frame(spark, [["a", "a", "b"], ["a", None, "b"], None, ["b"], ["a"]])
    found = mine(odd, settings)
    assert as_dict(found.itemsets) == {("a",): 3, ("b",): 3, ("a", "b"): 2} and found.n_baskets == 4
    one = mine(frame(spark, [["a", "b", "c"]]), settings)
    assert len(as_dict(one.itemsets)) == 7
    same = mine(frame(spark, [["a"], ["a"], ["a"]]), settings)
    assert as_dict(same.itemsets) == {("a",): 3} and same.rules.count() == 0


def test_few_counters_per_pass_change_nothing(spark):
    baskets = random_baskets(3)
    df = prepared(frame(spark, baskets)).cache()
    want = brute.itemsets(baskets, "0.2")
    assert as_dict(apriori_itemsets(df, 16, slots=3)) == want
    assert as_dict(apriori_itemsets(df, 16, counters=16)) == want
    assert as_dict(son_itemsets(df, 0.2, 16, len(baskets), slots=3)) == want


@pytest.mark.parametrize("parts", [1, 2, 12])
def test_son_does_not_depend_on_partitions(spark, parts):
    baskets = random_baskets(4, n=300)
    df = prepared(frame(spark, baskets, parts)).cache()
    assert as_dict(son_itemsets(df, 0.2, 60, 300)) == brute.itemsets(baskets, "0.2")


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_a_basket_with_very_many_items(spark, algorithm):
    """One basket holds every item; most items are rare, so few itemsets are frequent."""
    baskets = [[f"x{k}" for k in range(3000)]] + [["x1", "x2"], ["x2", "x3"], ["x1", "x2", "x3"]] * 10
    found = as_dict(mine(frame(spark, baskets), MiningSettings(0.3, 0.5, algorithm)).itemsets)
    assert found == {
        ("x1",): 21, ("x2",): 31, ("x3",): 21, ("x1", "x2"): 21, ("x2", "x3"): 21,
        ("x1", "x3"): 11, ("x1", "x2", "x3"): 11,
    }


def test_single_consequents_and_lift_filter(spark):
    baskets = random_baskets(5)
    found = mine(frame(spark, baskets), MiningSettings(0.2, 0.3, max_consequent=None))
    every = as_rules(found.rules)
    single = as_rules(association_rules(found.itemsets, 80, 0.3, max_consequent=1))
    assert single == {k: v for k, v in every.items() if len(k[1]) == 1}
    two = as_rules(association_rules(found.itemsets, 80, 0.3, max_consequent=2))
    assert two == {k: v for k, v in every.items() if len(k[1]) <= 2}
    lifted = as_rules(association_rules(found.itemsets, 80, 0.3, min_lift=1.0))
    assert lifted == {k: v for k, v in every.items() if v[2] >= 1.0}


def every_subset(items, freq):
    """Itemsets of equal freq: every split is a rule of confidence 1."""
    return [(sorted(c), freq) for k in range(1, len(items) + 1) for c in combinations(items, k)]


def test_a_long_itemset_is_split_every_way(spark):
    items = [f"i{k:02d}" for k in range(9)]
    rules = association_rules(spark.createDataFrame(every_subset(items, 5), SET), 10, 0.9)
    rows = as_rules(rules.filter(F.size("antecedents") + F.size("consequents") == 9))
    assert len(rows) == 2 ** 9 - 2 and all(sorted(a + c) == items for a, c in rows)


def test_consequents_stop_growing_below_the_confidence(spark):
    """25 items, of which any one follows from the others, but no two do: a level of 300 is tried, not 2^25 splits."""
    items = [f"i{k:02d}" for k in range(25)]
    sets = [(items, 90)] + [([x for x in items if x != out], 95) for out in items]
    sets += [([x for x in items if x not in out], 1000) for out in combinations(items, 2)]
    rows = as_rules(association_rules(spark.createDataFrame(sets + [([x], 2000) for x in items], SET), 5000, 0.9))
    whole = {k: v for k, v in rows.items() if len(k[0]) + len(k[1]) == 25}
    assert len(whole) == 25 and all(len(c) == 1 for _, c in whole)


@pytest.mark.parametrize("limit", [None, 1, 3])
def test_long_itemsets_have_the_rules_of_brute_force(spark, limit):
    rng = random.Random(9)
    baskets = [[x for x in "abcdefghi" if rng.random() < (0.95 if k % 2 else 0.4)] or ["a"] for k in range(60)]
    found = mine(frame(spark, baskets), MiningSettings(0.2, 0.85, max_consequent=limit))
    want = brute.itemsets(baskets, "0.2")
    assert max(map(len, want)) > 7
    rules = brute.rules(want, len(baskets), 0.85)
    assert as_rules(found.rules) == {k: v for k, v in rules.items() if limit is None or len(k[1]) <= limit}


def test_counting_given_itemsets(spark):
    baskets = [["a", "b", "c"], ["b", "c"], ["c"]]
    df = prepared(frame(spark, baskets))
    sets = spark.createDataFrame([(["a", "c"],), (["b", "c"],), (["c"],), (["a", "z"],)], "items array<string>")
    assert as_dict(count_itemsets(df, sets)) == {("a", "c"): 1, ("b", "c"): 2, ("c",): 3}


def test_settings_are_checked():
    for bad in ({"min_support": 0}, {"min_support": 1.5}, {"min_confidence": -1}, {"algorithm": "x"}, {"max_consequent": 0}):
        with pytest.raises(ValueError):
            MiningSettings(**bad)


def test_splits_with_a_limit_are_built_directly(spark):
    items = [f"i{k:02d}" for k in range(20)]
    sets = spark.createDataFrame([(items, 3)], "items array<string>, freq long")
    splits = _splits(sets, 2)
    rows = splits.collect()
    assert len(rows) == 20 + 190
    assert all(sorted(r["antecedents"] + r["consequents"]) == items and 1 <= len(r["consequents"]) <= 2 for r in rows)


@pytest.mark.parametrize("counters", [8, 64, 1 << 22])
def test_frequent_pairs_whatever_the_counters(spark, counters):
    baskets = random_baskets(6, n=200, items=12)
    df = prepared(frame(spark, baskets, 5))
    names = sorted({x for b in baskets for x in b})
    want = {s: n for s, n in brute.itemsets(baskets, "0.2", 2).items() if len(s) == 2}
    assert as_dict(frequent_pairs(df, names, 40, counters)) == want


def test_pairs_of_20000_items_take_two_scans(spark):
    scans = spark.sparkContext.accumulator(0)
    rng = random.Random(7)
    names = [f"i{k:05d}" for k in range(20_000)]
    rows = [(sorted(rng.sample(names, 8) + ["i00001x", "i00002x"]),) for _ in range(3000)]

    def counted(batches):
        scans.add(1)
        yield from batches

    df = spark.createDataFrame(rows, "items array<string>").coalesce(1).mapInArrow(counted, "items array<string>")
    found = as_dict(frequent_pairs(df, sorted(names + ["i00001x", "i00002x"]), 30))
    assert found == {("i00001x", "i00002x"): 3000} and scans.value <= 3


def test_a_short_task_sends_no_more_counters_than_a_long_one():
    import numpy as np
    import pyarrow as pa
    from tillspark.mining.counting import pair_counters

    names = pa.array([f"i{k:04d}" for k in range(3000)])
    sent = []
    for n in (1, 400):
        baskets = pa.RecordBatch.from_arrays([pa.array([names.to_pylist()[k::n][:200] for k in range(n)])], ["items"])
        sent.append(sum(len(x.as_py()) for b in pair_counters(names, 1 << 16)([baskets]) for x in b.column("counts")))
    assert sent[0] <= sent[1] <= 4 * (1 << 16)
    assert np.all(np.array(sent) > 0)


def test_bitmaps_count_as_histograms_do():
    import numpy as np

    rng = random.Random(8)
    baskets = [sorted(rng.sample(range(20), rng.randint(0, 19))) for _ in range(150)]
    rows = np.repeat(np.arange(150), [len(b) for b in baskets])
    block = Block(150, rows, np.array([i for b in baskets for i in b]), 20)
    wanted = [(p, np.array([e for e in range(20) if not p or e > p[-1]])) for p in [(), (0,), (0, 3), (0, 3, 4), (1, 2), (5,), (5, 9, 11, 17)]]
    for (prefix, extensions), counts in zip(wanted, partial_counts(block, wanted)):
        assert counts.tolist() == [sum(set(prefix) | {e} <= set(b) for b in baskets) for e in extensions]


def test_son_leaves_a_short_partition_to_the_second_phase(spark):
    rng = random.Random(5)
    rows = [(sorted(rng.sample("abcdefghij", rng.randint(2, 5))),) for _ in range(4000)]
    many = spark.createDataFrame(rows, "items array<string>").repartition(2)
    short = spark.createDataFrame([(list("abcdefghijklmnopqrst"),)], "items array<string>").coalesce(1)
    baskets = many.unionByName(short)
    n, least = 4001, 120
    candidates = son_candidates(baskets, 0.03, least, n)
    found = son_itemsets(baskets, 0.03, least, n).count()
    # One basket of 20 items alone would make a million candidates.
    assert found <= candidates.count() <= 1.5 * found


def test_runs_alike_in_algorithm_and_support_are_mined_once(spark, monkeypatch):
    from tillspark.mining import job

    calls, real = [], job.fpgrowth_itemsets
    monkeypatch.setattr(job, "fpgrowth_itemsets", lambda *a: calls.append(1) or real(*a))
    carts = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "b"]), ("3", ["a", "c"])], "InvoiceNo string, items array<string>")
    runs = [job.MiningSettings(0.3, 0.1), job.MiningSettings(0.3, 0.9), job.MiningSettings(0.6, 0.1)]
    first, second, third = job.mine_all(carts, runs)
    assert len(calls) == 2
    rules = lambda found: {(*r.antecedents, *r.consequents) for r in found.rules.collect()}
    assert rules(first) == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")} and rules(second) == {("b", "a"), ("c", "a")}
    assert rules(third) == {("a", "b"), ("b", "a")} and third.itemsets.count() == 3


def test_a_chunk_takes_half_the_memory_and_finds_the_same():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tillspark.mining import son

    def batches():
        rng = np.random.default_rng(1)
        for _ in range(30):
            ids = rng.permuted(np.tile(np.arange(25), (10_000, 1)), axis=1)[:, :4]
            items = pa.DictionaryArray.from_arrays(pa.array(np.sort(ids, axis=1).ravel()), vocabulary).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, 40_001, 4, dtype=np.int32)), items)], ["items"])

    vocabulary = pa.array([f"b{k:02}" for k in range(25)])
    n, rows, ids = next(son.chunks(batches(), vocabulary, 1000))
    assert n == 300_000 and len(rows) == 1_200_000 and rows[-1] == n - 1 and (np.diff(rows) >= 0).all()
    tracemalloc.start()
    found = set()
    for n, rows, ids in son.chunks(batches(), vocabulary, 1000):
        found |= set(son.local_itemsets(n, rows, ids, 25, 1500))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 25 + 300
    assert peak < 60 * 1_200_000


@pytest.mark.parametrize("most_kinds", [0, 1 << 21])
def test_fp_growth_of_kinds_and_of_baskets_agree(spark, most_kinds):
    baskets = random_baskets(5, n=300)
    df = prepared(frame(spark, baskets)).cache()
    assert as_dict(fpgrowth_itemsets(df, 60, 300, most_kinds=most_kinds)) == brute.itemsets(baskets, "0.2")


@pytest.mark.parametrize("groups", [1, 2, 64])
def test_copies_of_a_basket_are_counted_not_walked(spark, groups):
    kinds = spark.createDataFrame(
        [(["a", "b"], 10**9), (["a", "b", "c"], 10**9), (["b", "c"], 5), (["a"], 3), (["rare"], 1)], "items array<string>, times long")
    assert as_dict(by_kinds(kinds, 10**9, groups)) == {
        ("a",): 2 * 10**9 + 3, ("b",): 2 * 10**9 + 5, ("c",): 10**9 + 5, ("a", "b"): 2 * 10**9,
        ("a", "c"): 10**9, ("b", "c"): 10**9 + 5, ("a", "b", "c"): 10**9,
    }
    assert as_dict(by_kinds(kinds, 10**10, groups)) == {}


@pytest.mark.parametrize("groups", [1, 3, 64])
def test_kinds_in_groups_of_items_equal_brute_force(spark, groups):
    baskets = random_baskets(6, n=200)
    kinds = spark.createDataFrame([(sorted(b), 1) for b in baskets], "items array<string>, times long")
    assert as_dict(by_kinds(kinds, 30, groups)) == brute.itemsets(baskets, "0.15")
