import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tillspark.operators import similarity
from tillspark.operators.similarity import item_classes, similar_pairs
from tillspark.operators.text_index import basket_counts_by_search, baskets_by_search, search_all, store_index, text_index
from tillspark.schemas import BASKET


def brute(baskets, limit):
    """Item sets of baskets, classes of equal sets, and similar pairs of classes."""
    sets = {}
    for i, (_, items) in enumerate(baskets):
        for x in items or []:
            if x is not None:
                sets.setdefault(x, set()).add(i)
    named = {}
    for x in sorted(sets):
        named.setdefault(frozenset(sets[x]), x)
    pairs = {}
    for (s, x), (t, y) in itertools.permutations(named.items(), 2):
        if 100 * len(s & t) >= round(100 * limit) * len(s | t) and s & t:
            pairs[x, y] = (len(s & t), len(s & t) / len(s | t))
    return {(x, named[frozenset(s)], len(s)) for x, s in sets.items()}, pairs


def check(spark, baskets, limit):
    pairs, classes = similar_pairs(spark.createDataFrame(baskets, BASKET), limit)
    want_classes, want = brute(baskets, limit)
    assert {tuple(r) for r in classes.select("item", "class", "n").collect()} == want_classes
    got = {(r["product"], r["rec_product"]): (r["together"], r["jaccard"]) for r in pairs.collect()}
    assert pairs.count() == len(got) and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    return want


@pytest.mark.parametrize("limit", [0.1, 0.5, 0.8, 1.0])
def test_all_pairs_equal_a_brute_force(spark, limit):
    rng = random.Random(int(limit * 100))
    base = [[f"i{rng.randrange(6) * 3 + k}" for k in range(rng.randrange(1, 4))] for _ in range(60)]
    baskets = [(str(i), sorted(set(b))) for i, b in enumerate(base)]
    # One basket holds every item, one has no number, some are odd, and two items are always bought together.
    baskets += [("all", [f"i{k}" for k in range(18)] + [f"once{k}" for k in range(40)]), (None, ["i0", "i3", "x", None, "x"]),
                ("empty", []), ("null", None), ("x1", ["twin", "twin2", "i0"]), ("x2", ["twin2", "twin"])]
    # Two pairs on either side of 0.8: 9 of 10 baskets, and 4 of 6.
    baskets += [(f"n{k}", ["near"] + ["near2"] * (k < 9)) for k in range(10)] + [(f"m{k}", ["far"] + ["far2"] * (k < 4)) for k in range(6)]
    want = check(spark, baskets, limit)
    assert (("near", "near2") in want) == (limit <= 0.8) and (("far", "far2") in want) == (limit <= 0.5)


@pytest.mark.parametrize("per_entry", [0, 1, 3])
@pytest.mark.parametrize("limit", [0.1, 0.4])
def test_large_baskets_are_counted_as_well_as_small_ones(spark, monkeypatch, limit, per_entry):
    """With next to no basket counted whole, pairs are found by prefixes and counted by baskets, or pair by pair."""
    monkeypatch.setattr(similarity, "PAIRS_PER_ENTRY", per_entry)
    rng = random.Random(per_entry)
    few = [(str(i), sorted({f"i{int(rng.random() ** 2 * 30)}" for _ in range(rng.randrange(1, 9))})) for i in range(150)]
    check(spark, few, limit)
    check(spark, few[:40] + [(f"all{k}", [f"i{j}" for j in range(40)]) for k in range(6)], limit)


def written(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_a_low_limit_does_not_bring_every_item_to_every_basket(spark):
    """200 items that all meet now and then: their baskets were joined to all pairs before, here 800,000 rows."""
    rng = random.Random(5)
    baskets = [(str(i), rng.sample([f"i{k}" for k in range(200)], 3)) for i in range(2600)]
    before = written(spark)
    check(spark, baskets, 0.02)
    assert written(spark) - before < 300_000


def test_classes_alone_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_prefixes", lambda *_: pytest.fail("pairs are looked for"))
    found = item_classes(spark.createDataFrame([("1", ["a", "b", "c"]), ("2", ["c", None]), (None, ["a", "b"])], BASKET))
    assert {tuple(r) for r in found.collect()} == {("a", "a", 2), ("b", "a", 2), ("c", "c", 2)}


def test_items_below_any_support_are_found(spark):
    baskets = [(str(i), ["often"]) for i in range(200)] + [("a", ["rare", "rarer", "often"]), ("b", ["rare", "often"])]
    assert ("rare", "rarer") in check(spark, baskets, 0.5)


def test_no_baskets_and_wrong_limits(spark):
    check(spark, [], 0.5)
    for limit in (0, -1, 1.5):
        with pytest.raises(ValueError):
            similar_pairs(spark.createDataFrame([], BASKET), limit)


def test_a_very_crowded_basket_brings_no_pairs_of_its_own(spark):
    """3,000 items sold once, in one basket, are one class: no pairs come of them."""
    baskets = [("hot", [f"i{k}" for k in range(3000)]), ("other", ["i1", "i2"])]
    pairs, classes = similar_pairs(spark.createDataFrame(baskets, BASKET), 0.4)
    assert classes.count() == 3000 and classes.select("class").distinct().count() == 2
    assert {(r["product"], r["rec_product"], r["together"]) for r in pairs.collect()} == {("i0", "i1", 1), ("i1", "i0", 1)}


NAMES = ["Red Widget", "red wagon", "Tea", "a%b", "a_b", "a\\b", "ÄPFEL groß", "日本語の本", "", None, "x" * 3000 + "needle", "ab", "edr ed", "𝒳𝒴𝒵!"]
TEXTS = ["red", "RED W", "e", "ed", "w%t", "a_b", "%", "_", "", "\\", "a\\b", "äpfel", "本語", "語の", "needle", "zzz", "zz", "q", None, "%%__%", "t__",
         "x" * 2500, "red", "d w%g%t", "𝒴", "𝒳𝒴𝒵", "a%", "_b"]


def like(name, text):
    parts = {"%": ".*", "_": "."}
    return re.fullmatch(".*" + "".join(parts.get(c, re.escape(c)) for c in text.lower()) + ".*", name.lower(), re.S) is not None


def test_searches_equal_like(spark, tmp_path):
    names = spark.createDataFrame([(i, n, None if n is None else n[::-1]) for i, n in enumerate(NAMES)], "id long, name string, description string")
    store_index(names, "id", ["name", "description"], str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    searches = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "n int, text string")
    found = search_all(searches, names, index, "id", ["name", "description"])
    want = {(t, i) for t in TEXTS if t is not None for i, n in enumerate(NAMES) if n is not None and (like(n, t) or like(n[::-1], t))}
    got = [tuple(r) for r in found.select("text", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ("", 0) in want and ("zzz", 0) not in want


def test_searches_in_nothing(spark):
    names = spark.createDataFrame([], "id long, name string")
    some = spark.createDataFrame([("red",), ("",)], "text string")
    assert search_all(some, names, text_index(names, "id", ["name"]), "id", ["name"]).count() == 0
    names = spark.createDataFrame([(1, "red")], "id long, name string")
    none = some.filter(F.lit(False))
    assert search_all(none, names, text_index(names, "id", ["name"]), "id", ["name"]).count() == 0


def test_baskets_of_searches(spark):
    baskets = spark.createDataFrame([("1", ["red tea", "green tea"]), ("2", ["milk"]), ("3", ["green tea"])], BASKET)
    names = spark.createDataFrame([("red tea",), ("green tea",), ("milk",), ("unsold tea",)], "name string")
    searches = spark.createDataFrame([("tea",), ("RED",), ("i",), ("cake",)], "text string")
    found = search_all(searches, names, text_index(names, "name", ["name"]), "name", ["name"])
    got = {tuple(r) for r in baskets_by_search(found, baskets, "name").collect()}
    assert got == {("tea", "1"), ("tea", "3"), ("RED", "1"), ("i", "2")}


@pytest.mark.parametrize("slots", [7, 2_000_000])
def test_baskets_of_searches_are_counted_without_being_paired_with_texts(spark, slots):
    rng = random.Random(3)
    names = [f"n{k}" for k in range(40)]
    held = [(str(i), rng.sample(names, rng.randrange(0, 6)) + ["other", None]) for i in range(700)] + [("null", None), (None, ["n0"])]
    matches = [(f"t{t}", x) for t in range(12) for x in rng.sample(names, 1 + 3 * t)] + [("all", x) for x in names] + [("unsold", "n99")]
    before = written(spark)
    found = basket_counts_by_search(
        spark.createDataFrame(matches, "text string, name string"), spark.createDataFrame(held, BASKET).repartition(3), "name", slots=slots)
    got = {r["text"]: r["basket_count"] for r in found.collect()}
    if slots > len(matches):
        # The 700 baskets dealt out, what the texts match, and a count of each text from each task.
        assert written(spark) - before < 1500
    sets = {}
    for t, x in matches:
        sets.setdefault(t, set()).add(x)
    assert got == {t: n for t, s in sets.items() if (n := sum(bool(s & set(items or [])) for _, items in held))}
