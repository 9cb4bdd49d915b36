"""Cart edits as composed functions, and catalog products to fill up suggestions."""

import random

import brute
from pyspark.sql import functions as F

from tillspark.operators import serve as V
from tillspark.operators.commerce import apply_edits, cart_edits, fold_cart_events
from tillspark.sources.order_tables import cart_events

EVENT = "cart_id string, seq long, action string, product string, qty int"


def made(rng, n, spread):
    seqs = rng.sample(range(n * spread), n)
    return [(rng.choice("12"), s, rng.choice(["add", "add", "set", "set", "remove"]), rng.choice("ab"), rng.randint(-1, 4)) for s in seqs]


def as_dict(rows):
    return {(r["cart_id"], r["product"]): r["qty"] for r in rows.collect()}


def test_folds_equal_the_plain_one_whatever_the_ranges(spark):
    rng = random.Random(1)
    for n, spread in ((1, 1), (40, 1), (500, 3), (300, 1 << 12), (300, 1 << 30), (200, 1 << 40)):
        events = made(rng, n, spread)
        assert as_dict(fold_cart_events(spark.createDataFrame(events, EVENT).repartition(3))) == brute.fold(events)
    assert as_dict(fold_cart_events(spark.createDataFrame([], EVENT))) == {}


def test_edits_apply_to_stored_carts(spark):
    rng = random.Random(2)
    events = made(rng, 400, 1 << 10)
    middle = sorted(e[1] for e in events)[200]
    first, second = ([e for e in events if (e[1] < middle) == early] for early in (True, False))
    carts = fold_cart_events(spark.createDataFrame(first, EVENT))
    assert as_dict(apply_edits(carts, cart_edits(spark.createDataFrame(second, EVENT)))) == brute.fold(events)


def test_unknown_edits_change_nothing(spark):
    events = [("1", 1, "add", "a", None), ("1", 2, "look", "a", 5), ("1", 3, "set", "a", None), ("1", 4, "set", "b", 4)]
    assert as_dict(fold_cart_events(spark.createDataFrame(events, EVENT))) == {("1", "a"): 1}


def test_the_events_are_scanned_once(spark, sf):
    plan = fold_cart_events(cart_events(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_a_cart_of_a_million_products_is_topped_up(spark):
    n = 1_000_000
    products = spark.range(n + 30).select(F.format_string("p%08d", "id").alias("name"), F.lit(1.0).alias("price"))
    # The big cart lacks every product whose number is a multiple of 300,000.
    big = spark.range(n).filter("id % 300000 <> 0").select(F.lit("big").alias("cart_id"), F.format_string("p%08d", "id").alias("product"))
    small = spark.createDataFrame([("small", "p00000001"), ("odd", "none such")], "cart_id string, product string")
    stored = spark.createDataFrame([], "product string, rec_product string, confidence double, support double, lift double, algorithm string")
    rows = V.cart_suggestions(big.unionByName(small), stored, products).collect()
    got = {c: [r["product"] for r in sorted(rows, key=lambda r: r["rank"]) if r["cart_id"] == c] for c in ("big", "small", "odd")}
    assert got["big"] == ["p00000000", "p00300000", "p00600000", "p00900000"]
    assert got["small"] == ["p00000000", "p00000002", "p00000003", "p00000004"]
    assert got["odd"] == [f"p0000000{k}" for k in range(4)]
