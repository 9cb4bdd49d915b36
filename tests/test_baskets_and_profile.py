import json
from decimal import Decimal

from pyspark.sql import functions as F

from tillspark.operators import baskets as B
from tillspark.operators import catalog as C
from tillspark.operators import profile as P
from tillspark.runtime import with_rank
from tillspark.schemas import BASKET, RETAIL_LINE
from tillspark.sinks import exports as X
from tillspark.workloads.preparation import cleaned, mining_baskets

DOC = [
    ("536365", "HEART"), ("536365", "LANTERN"), ("536365", "HANGER"), ("536365", "HEART"),
    ("536366", "WARMER"), ("536366", "JACK"), ("536367", " solo "), ("536368", "  "), (None, "a, b"), (None, "c||d"),
]


def lines(spark, pairs, price="1.5"):
    return spark.createDataFrame(
        [(no, "S", d, "1", "12/1/2010 8:26", Decimal(price), "1", "UK") for no, d in pairs], RETAIL_LINE
    )


def test_baskets_are_sets_with_their_own_null_group(spark):
    df = lines(spark, DOC)
    got = {r["InvoiceNo"]: r["items"] for r in B.baskets(df).collect()}
    assert got == {
        "536365": ["HANGER", "HEART", "LANTERN"], "536366": ["JACK", "WARMER"], None: ["a, b", "c||d"],
    }
    assert {r["InvoiceNo"]: r["items"] for r in B.baskets(df, 1).collect()}["536367"] == ["solo"]
    text = {r[0]: r[1] for r in B.as_text(B.baskets(df)).collect()}
    assert text["536366"] == "JACK, WARMER"
    as_json = {r[0]: json.loads(r[1]) for r in B.as_json(df).collect()}
    assert as_json["536365"] == ["HANGER", "HEART", "HEART", "LANTERN"]
    assert B.basket_view(df, "v").count() == spark.sql("SELECT * FROM v").count() == 4


def test_a_hot_invoice_is_deduplicated_before_it_is_gathered(spark):
    pairs = [("hot", f"item {i % 40}") for i in range(3000)] + [("cold", "item 1"), ("cold", "item 2")]
    df = lines(spark, pairs)
    assert {r["InvoiceNo"]: len(r["items"]) for r in B.baskets(df).collect()} == {"hot": 40, "cold": 2}


def test_rare_items_leave_and_frequent_ones_come_first(spark):
    df = lines(spark, [("1", "a"), ("1", "b"), ("2", "b"), ("2", "c"), ("3", "b"), (None, "a"), (None, "b"), (None, "b")])
    got = {r[0]: r[1] for r in B.frequent_transactions(df, 2).collect()}
    assert got == {"1": ["b", "a"], "2": ["b"], None: ["b", "a"]}


def test_membership_filters(spark):
    df = spark.createDataFrame([("1", ["jam", "jam jar"]), ("2", ["jam jar", "tea"])], BASKET)
    assert [r[0] for r in B.containing(df, "jam").collect()] == ["1"]
    assert B.containing(df, "jam", exact=False).count() == 2
    assert B.more_than(df, 2).count() == 0 and B.at_least(df, 2).count() == 2


def test_frequencies_follow_items(spark):
    df = lines(spark, [("1", "a"), ("1", "b"), ("2", "a"), ("2", "a"), ("3", "b")])
    got = {r["InvoiceNo"]: (r["items"], r["frequencies"]) for r in B.with_item_frequencies(df).collect()}
    assert got["1"] == (["a", "b"], [2, 2]) and got["2"] == (["a"], [2])
    freq = {r[0]: (r[1], r[2]) for r in P.item_frequency(df).collect()}
    assert freq == {"a": (2, 3), "b": (2, 2)}


def test_statistics_of_sizes(spark):
    df = spark.createDataFrame([("1", ["a"]), ("2", ["a", "b"])], BASKET)
    row = P.basket_statistics(df).first()
    assert (row["total_transactions"], row["unique_items"], row["median_items"], row["avg_items"]) == (2, 2, 1.5, 1.5)
    assert P.basket_statistics(df.limit(0)).count() == 0
    stats = {r["InvoiceNo"]: r for r in B.with_size_stats(df).collect()}
    assert stats["1"]["AvgItemsPerTransaction"] == 1.5 and stats["2"]["MaxItemsPerTransaction"] == 2.0


def test_counters_on_an_empty_table(spark):
    row = P.quality_counters(lines(spark, DOC).limit(0)).first()
    assert row["TotalRows"] == 0 and row["NullDescriptions"] is None
    assert P.average_basket_size(lines(spark, DOC).limit(0)).first()[0] == 0.0


def test_transaction_stats_count_null_and_blank_as_sql_does(spark):
    df = lines(spark, DOC + [("9", None)])
    row = P.transaction_stats(df, df).first().asDict()
    assert row == {"raw_row_count": 11, "cleaned_row_count": 11, "transaction_count": 5,
                   "unique_products": 9, "avg_basket_size": 1.8}
    assert P.average_basket_size(df).first()[0] == 1.8 and tuple(P.distinct_counts(df).first()) == (5, 9)
    empty = P.transaction_stats(df, df.limit(0)).first()
    assert (empty["cleaned_row_count"], empty["unique_products"], empty["avg_basket_size"]) == (0, 0, 0.0)


def test_checksum_ignores_order_but_not_content(spark):
    a = P.basket_checksum(lines(spark, [("1", "x"), ("1", "y")])).first()
    b = P.basket_checksum(lines(spark, [("1", "y"), ("1", "x")])).first()
    c = P.basket_checksum(lines(spark, [("1", "y"), ("1", "z")])).first()
    assert a == b and a["DescriptionChecksum"] != c["DescriptionChecksum"]


def test_search_and_prices(spark):
    df = lines(spark, [("1", "Red 50% mug"), ("2", "blue_mug"), ("3", "cup")])
    products = C.product_table(C.product_catalog(df))
    names = lambda q: sorted(r["name"] for r in C.search(products, q).collect())
    assert names("MUG") == ["Red 50% mug", "blue_mug"] and len(names("")) == 3 and len(names("_")) == 3
    assert C.price_of(df, "cup").first()[0] == 1.5 and C.price_of(df, "none").first()[0] is None
    listed = spark.createDataFrame([("cup", 9.0), ("new", 4.0)], "name string, price double")
    assert {r["name"]: r["price"] for r in C.price_list(listed, C.average_prices(df)).collect()} == {
        "cup": 1.5, "new": 4.0}


def test_rank_is_dense_over_range_partitions(spark):
    df = spark.range(1000).select(F.format_string("%05d", (F.col("id") * 7919) % 1000).alias("k"))
    got = [(r["k"], r["id"]) for r in with_rank(df.repartition(7), "k").orderBy("id").collect()]
    assert got == [(f"{i:05d}", i + 1) for i in range(1000)]


def test_text_exports_escape(spark, tmp_path):
    df = spark.createDataFrame([("1", ['say "hi"', "a, b"])], BASKET)
    X.export_baskets_csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first()
    assert back["Items"] == 'say "hi", a, b'
    X.export_baskets_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["Items"] == ['say "hi"', "a, b"]


def test_baskets_by_a_key_of_the_invoice_are_the_same(spark):
    pairs = [(str(i % 50), f" item {i % 7}") for i in range(400)] + [("hot", f"item {i % 40}") for i in range(3000)]
    df = lines(spark, [*pairs, ("1", None), ("1", "  "), ("one", "single")]).withColumn("key", F.xxhash64("InvoiceNo") % 20)
    for options in ({}, {"min_items": 1, "trim": False}, {"fold_case": True}):
        want = {r["InvoiceNo"]: r["items"] for r in B.baskets(df, **options).collect()}
        rows = B.baskets(df, key="key", **options).collect()
        assert {r["InvoiceNo"]: r["items"] for r in rows} == want and len(rows) == len(want) and rows[0].asDict().keys() == {"InvoiceNo", "items"}


def test_lines_joined_by_shuffles_become_baskets_where_they_are(spark, sf):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        carts = mining_baskets(spark, sf)
        plan = carts._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(InvoiceNo" not in plan
        assert "InvoiceNo" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)
        got = {r["InvoiceNo"]: r["items"] for r in carts.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {r["InvoiceNo"]: r["items"] for r in B.baskets(cleaned(spark, sf)).collect()}
