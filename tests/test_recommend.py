import itertools
import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from tillspark import MiningSettings, mine
from tillspark.operators import commerce as M
from tillspark.operators import recommend as R
from tillspark.operators import serve as V
from tillspark.operators import validate as Q
from tillspark.schemas import BASKET
import brute

PANTRY = [
    ["bread", "butter", "jam"], ["bread", "butter"], ["bread", "jam"], ["pasta", "sauce"],
    ["pasta", "sauce", "bread"], ["milk"], ["milk", "bread", "butter"], ["pasta", "sauce", "milk"],
    ["butter", "jam"], ["bread", "milk"], ["jam", "butter", "bread"], ["sauce", "pasta"],
]


@pytest.fixture(scope="module")
def pantry(spark):
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(PANTRY)], BASKET)
    return df, mine(df, MiningSettings(0.15, 0.6))


def plain_recs(sets, rules):
    """Per product, rows of rules then of itemsets not covered, as lists."""
    recs = defaultdict(list)
    for (a, c), (conf, sup, lift) in rules.items():
        for x, y in itertools.product(a, c):
            recs[x].append((y, conf, sup, lift, "rule"))
    for s, sup in sorted(sets.items(), key=lambda kv: -kv[1]):
        for x, y in itertools.permutations(s, 2):
            if y not in {r[0] for r in recs[x]}:
                recs[x].append((y, 0.0, sup, 0.0, "itemset"))
    return recs


def test_recommendations_per_rule(spark, pantry):
    _, found = pantry
    sets = brute.itemsets(PANTRY, "0.15")
    want = plain_recs({s: f / 12 for s, f in sets.items()}, brute.rules(sets, 12, 0.6))
    for complete in (True, False):
        got = defaultdict(list)
        for r in R.all_recommendations(found.itemsets, found.rules, dedupe=False, complete=complete).collect():
            got[r["product"]].append((r["rec_product"], r["confidence"], r["support"], r["lift"], r["source"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {r[4] for v in want.values() for r in v} == {"rule", "itemset"}


def test_cross_sell_equals_a_loop(spark, pantry):
    _, found = pantry
    recs = R.all_recommendations(found.itemsets, found.rules, dedupe=False)
    table = defaultdict(list)
    for r in recs.collect():
        table[r["product"]].append(r)
    carts = {"1": ["bread"], "2": ["pasta", "bread"], "3": ["jam", "milk", "unknown"], "4": ["nothing"]}
    rows = [(c, p) for c, ps in carts.items() for p in ps]
    got = defaultdict(list)
    for r in R.cross_sell(spark.createDataFrame(rows, "cart_id string, product string"), recs, 3).collect():
        got[r["cart_id"]].append((r["rank"], r["product"], r["score"]))
    for cart, ps in carts.items():
        score = defaultdict(float)
        for p in ps:
            for r in table.get(p, []):
                if r["rec_product"] not in ps:
                    score[r["rec_product"]] += r["lift"] or r["support"]
        want = sorted(score.items(), key=lambda kv: (-round(kv[1], 9), kv[0]))[:3]
        assert [(p, s) for _, p, s in sorted(got[cart])] == [(p, pytest.approx(s, abs=1e-4)) for p, s in want]


def test_ties_are_broken_by_name(spark):
    rows = [("p", x, 0.5, 0.1, 2.0, "rule") for x in ("d", "b", "a", "c")]
    recs = spark.createDataFrame(rows, "product string, rec_product string, confidence double, support double, lift double, source string")
    assert [r["rec_product"] for r in R.top_recommendations(recs, 2).orderBy("rank").collect()] == ["a", "b"]


def test_rules_for_product_and_texts(spark, pantry):
    _, found = pantry
    top = R.rules_for_product(found.rules, "jam", 2).collect()
    assert len(top) == 2 and all("jam" in r["antecedents"] + r["consequents"] for r in top)
    assert R.rules_with_text(found.rules, "PAST").count() == R.rules_with_text(found.rules, "pasta").count() > 0
    assert R.itemsets_with_text(found.itemsets, "pasta", 1).count() > R.itemsets_with_text(found.itemsets, "pasta").count()
    assert [len(r["items"]) for r in R.bundles(found.itemsets, 3, 5).collect()] == [3]


def test_similarity(spark, pantry):
    _, found = pantry
    got = {(r["product"], r["rec_product"]): r for r in R.similar_items(found.itemsets).collect()}
    pasta = got[("pasta", "sauce")]
    assert pasta["jaccard"] == 1.0 and pasta["cosine"] == 1.0
    assert got[("jam", "butter")]["jaccard"] == pytest.approx(3 / 6)


STORED = "product string, rec_product string, confidence double, support double, lift double, algorithm string"


def test_second_degree(spark):
    rows = [("a", "b", .5, .30, 3.0, "x"), ("a", "c", .5, .20, 2.0, "x"), ("b", "a", .5, .3, 1.0, "x"),
            ("b", "c", .5, .25, 1.0, "x"), ("b", "d", .5, .10, 1.0, "x"), ("c", "d", .5, .15, 1.0, "x"),
            ("c", "e", .5, .12, 1.0, "x"), ("c", "f", .5, .12, 1.0, "y")]
    got = V.also_like(spark.createDataFrame(rows, STORED)).filter("product = 'a'").orderBy("rank").collect()
    assert [(r["rec_product"], r["support"]) for r in got] == [("d", .15), ("e", .12)]


def test_cart_suggestions_are_topped_up_from_the_catalog(spark):
    stored = spark.createDataFrame([("a", "d", .5, .3, 3.0, "x"), ("a", "b", .5, .2, 2.0, "x")], STORED)
    products = spark.createDataFrame([(x, 1.0) for x in "abcdefg"], "name string, price double")
    carts = spark.createDataFrame(
        [("1", "a"), ("1", "b"), ("2", "q"), ("3", "a"), *[("4", x) for x in "abcdef"]],
        "cart_id string, product string")
    got = defaultdict(list)
    for r in V.cart_suggestions(carts, stored, products).orderBy("cart_id", "rank").collect():
        got[r["cart_id"]].append((r["product"], r["source"]))
    assert got["1"] == [("d", "rule"), ("c", "catalog"), ("e", "catalog"), ("f", "catalog")]
    assert [p for p, _ in got["2"]] == ["a", "b", "c", "d"]
    assert got["3"] == [("d", "rule"), ("b", "rule"), ("c", "catalog"), ("e", "catalog")]
    assert got["4"] == [("g", "catalog")]


def test_stored_recommendations_cut_before_catalog_join(spark):
    rows = [("p", f"t{i:02d}", 0.5, 0.1, float(50 - i), "rule") for i in range(15)]
    recs = spark.createDataFrame(rows, "product string, rec_product string, confidence double, support double, lift double, source string")
    names = spark.createDataFrame([("p",), ("t01",), ("t12",)], "description string")
    assert [r["rec_product"] for r in V.stored_recommendations(recs, names, "fpgrowth").collect()] == ["t01"]


def test_carts_and_orders(spark):
    carts = spark.createDataFrame([("1", "a", 2), ("1", "zz", 1), ("2", "b", 3), ("3", "a", 1)], "cart_id string, product string, qty int")
    products = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "name string, price double")
    totals = {r["cart_id"]: (r["cart_count"], r["cart_total"]) for r in M.cart_totals(carts, products).collect()}
    assert totals == {"1": (3, 3.0), "2": (3, 6.0), "3": (1, 1.5)}
    people = spark.createDataFrame(
        [("1", "Ann", "a@x"), ("2", "", "b@x"), ("3", None, None), ("9", "Eve", "e@x")],
        "cart_id string, customer_name string, customer_email string").selectExpr("*", "timestamp'2024-01-01' AS created_at")
    heads = M.order_headers(carts, products, people)
    row = heads.collect()
    assert [(r["customer_name"], r["total_amount"], r["status"]) for r in row] == [("Ann", 3.0, "completed")]
    assert row[0]["order_number"].startswith("ORD-") and len(row[0]["order_number"]) == 36
    assert [(r["product"], r["quantity"], r["price"]) for r in M.order_lines(carts, products, heads).collect()] == [("a", 2, 1.5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_cart_events_fold_like_a_loop(spark, seed):
    rng = random.Random(seed)
    events = [
        (f"c{rng.randint(0, 6)}", i, rng.choice(["add", "add", "set", "remove"]), f"p{rng.randint(0, 2)}", rng.randint(-1, 4))
        for i in range(600)
    ] + [("hot", 1000 + i, rng.choice(["add"] * 8 + ["set", "remove"]), "p", rng.randint(0, 4)) for i in range(400)]
    rng.shuffle(events)
    df = spark.createDataFrame(events, "cart_id string, seq long, action string, product string, qty int")
    got = {(r["cart_id"], r["product"]): r["qty"] for r in M.fold_cart_events(df).collect()}
    assert got == brute.fold(events)


def rows(df):
    return {r["check_name"]: (r["total"], r["violations"]) for r in df.collect()}


def test_checks_pass_on_good_results_and_find_bad_ones(spark, pantry):
    df, found = pantry
    n_rules, n_sets = found.rules.count(), found.itemsets.count()
    assert rows(Q.check_itemsets(df, found.itemsets, 12)) == {"itemset_recount": (n_sets, 0)}
    assert rows(Q.check_rules(df, found.rules, 12)) == {"rule_recompute": (n_rules, 0)}
    wrong = found.itemsets.selectExpr("items", "freq + 1 AS freq", "support")
    assert rows(Q.check_itemsets(df, wrong, 12)) == {"itemset_recount": (n_sets, n_sets)}
    off = found.rules.selectExpr("antecedents", "consequents", "confidence", "support", "lift + 0.5 AS lift")
    assert rows(Q.check_rules(df, off, 12)) == {"rule_recompute": (n_rules, n_rules)}
    assert rows(Q.check_thresholds(found.rules, 0.15, 0.6))["rule_min_confidence"][1] == 0
    assert rows(Q.check_thresholds(found.rules, 0.9, 0.6))["rule_min_support"][1] == n_rules
    twice = found.itemsets.union(found.itemsets.limit(1))
    assert rows(Q.check_unique(twice)) == {"itemset_unique": (n_sets + 1, 1)}
    assert rows(Q.check_baskets(df))["basket_min_items"] == (12, 1)
    assert Q.positive_share(found.rules.limit(0)).first()["positive_share"] is None


def test_comparing_two_runs(spark, pantry):
    df, found = pantry
    other = mine(df, MiningSettings(0.15, 0.9, "apriori"))
    row = Q.rule_overlap(found.rules, other.rules).first()
    assert row["common"] == row["right_rules"] == other.rules.count() and row["right_only"] == 0
    assert row["overlap_pct"] == pytest.approx(100 * row["common"] / row["left_rules"])
    assert Q.rule_differences(found.rules, other.rules).count() == row["left_only"]
    assert rows(Q.check_agreement(found.rules, other.rules))["rule_agreement"] == (row["common"], 0)
    assert Q.rule_overlap(found.rules.limit(0), other.rules.limit(0)).first()["overlap_pct"] is None


def test_evidence(spark, pantry):
    _, found = pantry
    pairs = spark.createDataFrame([("pasta", "sauce"), ("jam", "pasta"), ("bread", "milk")], "product string, rec_product string")
    got = {(r[0], r[1]): r[2] for r in Q.recommendation_evidence(pairs, found.rules, found.itemsets).collect()}
    assert got == {("pasta", "sauce"): "rule", ("jam", "pasta"): "NONE", ("bread", "milk"): "itemset"}


def test_orders_with_alike_numbers_stay_apart(spark, monkeypatch):
    """Lines join their order by cart, whatever the number shown."""
    monkeypatch.setattr(M, "order_number", lambda cart_id: F.lit("ORD-1"))
    carts = spark.createDataFrame([("1", "a", 2), ("2", "a", 1), ("2", "b", 3)], "cart_id string, product string, qty int")
    products = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "name string, price double")
    customers = spark.createDataFrame([("1", "x", "x@example.org", None), ("2", "y", "y@example.org", None)],
                                      "cart_id string, customer_name string, customer_email string, created_at timestamp")
    heads = M.order_headers(carts, products, customers)
    lines = M.order_lines(carts, products, heads)
    details = M.order_details(heads, lines).collect()
    assert lines.count() == len(details) == 3
    assert sorted((r["cart_id"], r["customer_name"], r["product"]) for r in details) == [("1", "x", "a"), ("2", "y", "a"), ("2", "y", "b")]


def test_carts_of_the_same_products_are_one_class(spark):
    carts = spark.createDataFrame(
        [("1", "a"), ("1", "b"), ("2", "b"), ("2", "a"), ("2", "a"), ("3", "a"), (None, "a"), (None, "b"), ("4", None)],
        "cart_id string, product string")
    members, kinds = R.cart_classes(carts)
    assert members.count() == 5 and kinds.select("cart_id").distinct().count() == 3 and kinds.count() == 4
    recs = spark.createDataFrame([("a", "b", 0.5, 0.1, 2.0), ("a", "c", 0.5, 0.1, 1.5), ("b", "c", 0.5, 0.1, 1.0)],
                                 "product string, rec_product string, confidence double, support double, lift double")
    got = {tuple(r) for r in R.cross_sell(carts, recs).collect()}
    assert got == {("1", "c", 2.5, 1), ("2", "c", 2.5, 1), (None, "c", 2.5, 1), ("3", "b", 2.0, 1), ("3", "c", 1.5, 2)}
