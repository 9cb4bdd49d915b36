"""Queries over itemsets, rules, recommendations and their checks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tillspark.functions.metrics import confidence_band, lift_band, percent, round_metrics
from tillspark.mining import mine, mine_all
from tillspark.mining.rules import itemsets_of_size, top_itemsets, top_rules, with_min_lift
from tillspark.operators import catalog as C
from tillspark.operators import recommend as R
from tillspark.operators import serve as V
from tillspark.operators import validate as Q
from tillspark.operators.baskets import baskets
from tillspark.operators.similarity import item_classes, similar_pairs
from tillspark.plans.evaluate import hit_rate, split_baskets
from tillspark.plans.mining_run import run_mining
from tillspark.runtime import materialize, scratch, scratch_folder
from tillspark.schemas import MiningSettings
from tillspark.sinks.exports import export_run_json, import_run_json, itemsets_csv, load_state, save_state
from tillspark.sinks.tables import (
    latest_runs, load_run, read_recommendations, recent_runs, replace_products, replace_recommendations, save_run,
)
from tillspark.sources.order_tables import ORDER_KEY, open_carts
from tillspark.workloads import checking_sql as S
from tillspark.workloads.preparation import NAME, cleaned, mining_baskets
from tillspark.workloads.registry import query

# Few items with large itemsets, and many items with small ones.
LARGE = ("p_type", 0.05, 0.1)
WIDE = ("p_brand", 0.005, 0.1)


def mined(spark, sf_dir, case=LARGE, algorithm="fpgrowth", confidence=None, **options):
    item, support, default = case
    return mine(
        mining_baskets(spark, sf_dir, item),
        MiningSettings(support, confidence or default, algorithm, **options),
    )


def mined_twice(spark, sf_dir, algorithm, confidence, case=LARGE):
    """FP-Growth and another run over the same stored baskets."""
    item, support, default = case
    return mine_all(
        mining_baskets(spark, sf_dir, item), [MiningSettings(support, default), MiningSettings(support, confidence, algorithm)])


def _join(df, *names):
    return df.withColumns({c: F.array_join(c, " | ") for c in names})


def shown_itemsets(df):
    return _join(df, "items").select("items", "freq", "support")


def shown_rules(df):
    return _join(df, "antecedents", "consequents").select(
        "antecedents", "consequents", "confidence", "support", "lift", "freq"
    )


def itemset_sql(case=LARGE):
    return f"{S.basket_ctes(case[0])}, {S.itemsets(str(case[1]))}"


def rule_sql(case=LARGE, confidence=None):
    return f"{itemset_sql(case)}, {S.rules(str(confidence or case[2]))}"


SHOW_SETS = "SELECT array_to_string(items, ' | ') AS items, freq, support"
SHOW_RULES = """SELECT array_to_string(antecedents, ' | ') AS antecedents,
  array_to_string(consequents, ' | ') AS consequents, confidence, support, lift, freq"""

# ---- itemsets and rules -------------------------------------------------------------------

for _algorithm, _short in (("fpgrowth", "fp"), ("apriori", "apriori"), ("son", "son")):
    for _case, _suffix in ((LARGE, ""), (WIDE, "_wide")):
        query(f"{_short}_itemsets{_suffix}", f"{itemset_sql(_case)} {SHOW_SETS} FROM itemsets")(
            lambda spark, d, a=_algorithm, c=_case: shown_itemsets(mined(spark, d, c, a).itemsets)
        )


@query("rules_multi", f"{rule_sql()} {SHOW_RULES} FROM rules")
def _(spark, d):
    return shown_rules(mined(spark, d).rules)


@query("rules_apriori", f"{rule_sql()} {SHOW_RULES} FROM rules")
def _(spark, d):
    return shown_rules(mined(spark, d, algorithm="apriori").rules)


@query("rules_wide", f"{rule_sql(WIDE)} {SHOW_RULES} FROM rules")
def _(spark, d):
    return shown_rules(mined(spark, d, WIDE).rules)


@query("rules_single", f"{rule_sql()} {SHOW_RULES} FROM rules WHERE len(consequents) = 1")
def _(spark, d):
    return shown_rules(mined(spark, d, max_consequent=1).rules)


@query("rules_up_to_two_consequents", f"{rule_sql(confidence=0.05)} {SHOW_RULES} FROM rules WHERE len(consequents) <= 2")
def _(spark, d):
    return shown_rules(mined(spark, d, confidence=0.05, max_consequent=2).rules)


# Low enough for itemsets of four items, so that the limit leaves rules out.
DEEP = ("p_type", 0.02, 0.01)


@query("rules_up_to_two_of_four", f"{rule_sql(DEEP)} {SHOW_RULES} FROM rules WHERE len(consequents) <= 2")
def _(spark, d):
    return shown_rules(mined(spark, d, DEEP, max_consequent=2).rules)


@query("rules_min_lift", f"{rule_sql(WIDE)} {SHOW_RULES} FROM rules WHERE lift >= 1")
def _(spark, d):
    return shown_rules(with_min_lift(mined(spark, d, WIDE).rules, 1.0))


@query("top_rules", f"{rule_sql(WIDE)} {SHOW_RULES} FROM rules ORDER BY {S.RULE_BEST} LIMIT 10")
def _(spark, d):
    return shown_rules(top_rules(mined(spark, d, WIDE).rules, 10))


@query("top_itemsets", f"{itemset_sql(WIDE)} {SHOW_SETS} FROM itemsets ORDER BY support DESC, items LIMIT 10")
def _(spark, d):
    return shown_itemsets(top_itemsets(mined(spark, d, WIDE).itemsets, 10))


@query("itemsets_by_size", f"{itemset_sql()} {SHOW_SETS} FROM itemsets WHERE len(items) = 3")
def _(spark, d):
    return shown_itemsets(itemsets_of_size(mined(spark, d).itemsets, 3))


@query("itemsets_with_text", f"""{itemset_sql()} {SHOW_SETS} FROM itemsets
  WHERE len(items) >= 2 AND contains(lower(array_to_string(items, ' ')), 'small')""")
def _(spark, d):
    return shown_itemsets(R.itemsets_with_text(mined(spark, d).itemsets, "small"))


@query("rules_with_text", f"""{rule_sql()} {SHOW_RULES} FROM rules
  WHERE contains(lower(array_to_string(rules.antecedents, ' ')), 'small')
  OR contains(lower(array_to_string(rules.consequents, ' ')), 'small')""")
def _(spark, d):
    return shown_rules(R.rules_with_text(mined(spark, d).rules, "SMALL"))


@query("rules_display", f"""{rule_sql()} SELECT array_to_string(antecedents, ' | ') AS antecedents,
  array_to_string(consequents, ' | ') AS consequents,
  CASE WHEN lift > 3 THEN 'strong' WHEN lift > 1.5 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN confidence * 100 >= 80 THEN 'high' WHEN confidence * 100 >= 50 THEN 'medium' ELSE 'low' END AS band,
  round(confidence * 100, 1) AS confidence_pct, round(support * 100, 2) AS support_pct,
  round(confidence, 6) AS confidence, round(support, 6) AS support, round(lift, 4) AS lift FROM rules""")
def _(spark, d):
    rules = mined(spark, d).rules
    shown = rules.select(
        "*", lift_band(F.col("lift")).alias("strength"), confidence_band(F.col("confidence")).alias("band"),
        percent(F.col("confidence"), 1).alias("confidence_pct"), percent(F.col("support"), 2).alias("support_pct"),
    )
    return _join(round_metrics(shown), "antecedents", "consequents").select(
        "antecedents", "consequents", "strength", "band", "confidence_pct", "support_pct",
        "confidence", "support", "lift",
    )


@query("itemsets_csv", f"{itemset_sql()} {SHOW_SETS} FROM itemsets")
def _(spark, d):
    return itemsets_csv(mined(spark, d).itemsets)


# ---- recommendations ----------------------------------------------------------------------

REC_SQL = f"{rule_sql(WIDE)}, {S.recommendations()}"
LARGE_REC_SQL = f"{rule_sql(LARGE, 0.3)}, {S.recommendations()}"
RANKED = f"row_number() OVER (PARTITION BY product ORDER BY {S.BEST})"


def recs(spark, sf_dir, case=WIDE, algorithm="fpgrowth", confidence=None, dedupe=True):
    found = mined(spark, sf_dir, case, algorithm, confidence)
    return R.all_recommendations(found.itemsets, found.rules, dedupe)


@query("recs_ranked", f"{REC_SQL} SELECT *, {RANKED} AS rank FROM recs")
def _(spark, d):
    return R.ranked(recs(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("recs_per_rule", f"{LARGE_REC_SQL} SELECT product, rec_product, confidence, support, lift, source FROM allrecs")
def _(spark, d):
    """One row per rule or itemset pair; at this confidence many pairs have no rule."""
    return recs(spark, d, LARGE, confidence=0.3, dedupe=False)


@query("top_recommendations", f"SELECT * FROM ({REC_SQL} SELECT *, {RANKED} AS rank FROM recs) WHERE rank <= 5")
def _(spark, d):
    return R.top_recommendations(recs(spark, d), 5).withColumn("rank", F.col("rank").cast("long"))


@query("bought_together", f"SELECT * FROM ({REC_SQL} SELECT *, {RANKED} AS rank FROM recs) WHERE rank <= 4 AND product = 'Brand#1'")
def _(spark, d):
    return R.bought_together(recs(spark, d), "Brand#1").withColumn("rank", F.col("rank").cast("long"))


@query("bundles", f"{itemset_sql()} {SHOW_SETS} FROM itemsets WHERE len(items) BETWEEN 2 AND 5 ORDER BY support DESC, itemsets.items LIMIT 10")
def _(spark, d):
    return shown_itemsets(R.bundles(mined(spark, d).itemsets))


@query("rules_for_product", f"""{rule_sql()} {SHOW_RULES} FROM rules
  WHERE list_contains(rules.antecedents, 'SMALL') OR list_contains(rules.consequents, 'SMALL')
  ORDER BY rules.lift DESC, rules.confidence DESC, rules.support DESC, rules.antecedents, rules.consequents LIMIT 5""")
def _(spark, d):
    return shown_rules(R.rules_for_product(mined(spark, d).rules, "SMALL", 5))


@query("cross_sell", f"""{REC_SQL}, {S.carts('p_brand')},
w AS (SELECT product, rec_product,
  sum(CAST(round(CASE WHEN lift <> 0 THEN lift ELSE support END * 1e9::DOUBLE) AS BIGINT)) AS w
  FROM recs GROUP BY 1, 2),
scored AS (SELECT cart_id, rec_product AS product, sum(w) AS w FROM carts JOIN w USING (product)
  WHERE NOT EXISTS (SELECT 1 FROM carts c WHERE c.cart_id = carts.cart_id AND c.product = rec_product)
  GROUP BY 1, 2)
SELECT cart_id, product, round(CAST(w AS DOUBLE) / 1e9::DOUBLE, 4) AS score, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY cart_id ORDER BY w DESC, product) AS rank FROM scored) WHERE rank <= 5""")
def _(spark, d):
    return R.cross_sell(open_carts(spark, d, "p_brand"), recs(spark, d)).withColumn(
        "rank", F.col("rank").cast("long")
    )


SIMILAR_SQL = f"""{itemset_sql(WIDE)}, singles AS (SELECT items[1] AS item, freq FROM itemsets WHERE len(items) = 1),
both_ways AS (SELECT items[1] AS product, items[2] AS rec_product, freq FROM itemsets WHERE len(items) = 2
  UNION ALL SELECT items[2], items[1], freq FROM itemsets WHERE len(items) = 2),
alike AS (SELECT product, rec_product, b.freq AS together,
  b.freq / (x.freq + y.freq - b.freq) AS jaccard, b.freq / sqrt(CAST(x.freq AS DOUBLE) * y.freq) AS cosine
  FROM both_ways b JOIN singles x ON product = x.item JOIN singles y ON rec_product = y.item)"""


@query("similar_items", f"{SIMILAR_SQL} SELECT * FROM alike")
def _(spark, d):
    return R.similar_items(mined(spark, d, WIDE).itemsets)


# Over a thousand items, most of them below any useful support.
ALIKE_AT_LEAST = 0.02
_CLASSES = f"""{S.basket_ctes(NAME)}, sets AS (SELECT item, list(InvoiceNo ORDER BY InvoiceNo) AS s FROM
  (SELECT InvoiceNo, unnest(items) AS item FROM baskets) GROUP BY 1),
classes AS (SELECT s, min(item) AS class FROM sets GROUP BY s),
entries AS (SELECT class, len(s) AS n, unnest(s) AS basket FROM classes)"""


@query("all_similar_items", f"""{_CLASSES} SELECT x.class AS product, y.class AS rec_product, count(*) AS together,
  count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS jaccard, count(*) / sqrt(CAST(any_value(x.n) AS DOUBLE) * any_value(y.n)) AS cosine
FROM entries x JOIN entries y USING (basket) WHERE x.class <> y.class GROUP BY 1, 2
HAVING 100 * count(*) >= 2 * (any_value(x.n) + any_value(y.n) - count(*))""")
def _(spark, d):
    """All pairs of items that are similar, whatever their support."""
    return similar_pairs(mining_baskets(spark, d, NAME), ALIKE_AT_LEAST)[0]


@query("item_classes", f"{_CLASSES} SELECT item, class, CAST(len(s) AS BIGINT) AS n FROM sets JOIN classes USING (s)")
def _(spark, d):
    """Items with the very same baskets."""
    return item_classes(mining_baskets(spark, d, NAME))


@query("hybrid_recommendations", f"""{SIMILAR_SQL}, {S.rules('0.1')}, {S.recommendations()},
r AS (SELECT product, rec_product, confidence, lift, {RANKED} AS r FROM recs WHERE source = 'rule'),
s AS (SELECT product, rec_product, row_number() OVER (PARTITION BY product ORDER BY jaccard DESC, rec_product) AS s FROM alike),
blend AS (SELECT product, rec_product, confidence, lift,
  coalesce(CAST(0.5 AS DOUBLE) / r, 0) + coalesce(CAST(0.5 AS DOUBLE) / s, 0) AS score
  FROM r FULL JOIN s USING (product, rec_product))
SELECT *, 'Customers who bought ' || product || ' also bought ' || rec_product AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY product ORDER BY score DESC, rec_product) AS rank FROM blend) WHERE rank <= 5""")
def _(spark, d):
    found = mined(spark, d, WIDE)
    return R.hybrid_recommendations(found.itemsets, found.rules).withColumn("rank", F.col("rank").cast("long"))


# ---- stored recommendations and pages -----------------------------------------------------

# FP-Growth at one confidence and Apriori at a higher one, so that the two differ.
APRIORI_CONFIDENCE = 0.14
STORED_SQL = f"""{rule_sql(WIDE)}, {S.rules(str(APRIORI_CONFIDENCE), name='rules2')},
{S.recommendations()}, {S.recommendations('rules2', name='recs2')}, {S.CATALOG},
stored AS ({S.stored('recs', 'fpgrowth')} UNION ALL {S.stored('recs2', 'apriori')})"""


def stored_lines(spark, sf_dir, *more):
    """Cleaned lines, computed once, with what baskets and the names of the catalog need, and ``more`` columns."""
    return materialize(cleaned(spark, sf_dir, WIDE[0], key=True).select(ORDER_KEY, "InvoiceNo", "Description", "UnitPrice", *more))


def catalog_and_stored(spark, sf_dir):
    lines = stored_lines(spark, sf_dir, "StockCode")
    return materialize(C.product_catalog(lines, digits=None)), mined_and_stored(lines)[2]


def mined_and_stored(lines, *more):
    """What was found by FP-Growth, by Apriori and by ``more`` runs, the names of the catalog, and the recommendations of the first two."""
    names = materialize(C.catalog_names(lines))
    runs = [MiningSettings(WIDE[1], WIDE[2], "fpgrowth"), MiningSettings(WIDE[1], APRIORI_CONFIDENCE, "apriori")]
    stored = None
    every = mine_all(baskets(lines, key=ORDER_KEY), [*runs, *more])
    for found in every[:2]:
        algorithm = found.settings.algorithm
        part = V.stored_recommendations(
            R.all_recommendations(found.itemsets, found.rules), names, algorithm
        )
        stored = part if stored is None else stored.unionByName(part)
    return every, names, materialize(stored)


def as_products(catalog):
    return catalog.select(F.col("description").alias("name"), F.col("avg_price").alias("price"))


@query("stored_recommendations", f"{STORED_SQL} SELECT * FROM stored")
def _(spark, d):
    return mined_and_stored(stored_lines(spark, d))[2]


@query("recommendations_with_text", f"""{STORED_SQL} SELECT * FROM stored
  WHERE contains(lower(product || ' ' || rec_product || ' ' || algorithm), '#12 fp')""")
def _(spark, d):
    return R.recommendations_with_text(mined_and_stored(stored_lines(spark, d))[2], "#12 FP")


@query("recommendation_api", f"""{STORED_SQL},
ids AS (SELECT row_number() OVER (ORDER BY description) AS id, description AS name FROM catalog)
SELECT a.id AS for_product_id, b.id AS product_id, b.name AS product_name, support, confidence
FROM stored JOIN ids a ON product = a.name JOIN ids b ON rec_product = b.name""")
def _(spark, d):
    catalog, stored = catalog_and_stored(spark, d)
    return C.recommendation_api(stored, C.product_table(catalog))


@query("product_page", f"""{STORED_SQL}, {S.FIRST_DEGREE}
SELECT product, algorithm, rank, rec_product, avg_price AS price, confidence, lift
FROM first_degree JOIN catalog ON rec_product = description""")
def _(spark, d):
    catalog, stored = catalog_and_stored(spark, d)
    return V.product_page(stored, as_products(catalog)).withColumn("rank", F.col("rank").cast("long"))


@query("also_like", f"""{STORED_SQL}, {S.FIRST_DEGREE},
related AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, algorithm
  ORDER BY support DESC, rec_product) AS pos FROM stored) WHERE pos <= 6),
reached AS (SELECT f.product, f.algorithm, r.rec_product, max(r.support) AS support
  FROM first_degree f JOIN related r ON r.product = f.rec_product AND r.algorithm = f.algorithm
  WHERE r.rec_product <> f.product AND NOT EXISTS (SELECT 1 FROM first_degree x
    WHERE x.product = f.product AND x.algorithm = f.algorithm AND x.rec_product = r.rec_product)
  GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, algorithm
  ORDER BY support DESC, rec_product) AS rank FROM reached) WHERE rank <= 4""")
def _(spark, d):
    return V.also_like(mined_and_stored(stored_lines(spark, d))[2]).withColumn("rank", F.col("rank").cast("long"))


@query("cart_suggestions", f"""{STORED_SQL}, {S.carts('p_brand')},
best AS (SELECT DISTINCT product, rec_product, lift FROM (SELECT *, row_number() OVER (PARTITION BY product
  ORDER BY lift DESC, confidence DESC, support DESC, rec_product, algorithm) AS pos FROM stored) WHERE pos <= 4),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cart_id ORDER BY lift DESC, product) AS rank FROM
  (SELECT cart_id, rec_product AS product, max(lift) AS lift FROM carts JOIN best USING (product)
   WHERE NOT EXISTS (SELECT 1 FROM carts c WHERE c.cart_id = carts.cart_id AND c.product = rec_product)
   GROUP BY 1, 2)) WHERE rank <= 4),
has AS (SELECT cart_id, count(chosen.product) AS has FROM (SELECT DISTINCT cart_id FROM carts)
  LEFT JOIN chosen USING (cart_id) GROUP BY 1),
more AS (SELECT cart_id, description AS product, has, row_number() OVER (PARTITION BY cart_id ORDER BY description) AS k
  FROM has CROSS JOIN catalog WHERE has < 4
  AND NOT EXISTS (SELECT 1 FROM carts c WHERE c.cart_id = has.cart_id AND c.product = description)
  AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.cart_id = has.cart_id AND c.product = description))
SELECT cart_id, product, rank, 'rule' AS source FROM chosen
UNION ALL SELECT cart_id, product, has + k, 'catalog' FROM more WHERE has + k <= 4""")
def _(spark, d):
    catalog, stored = catalog_and_stored(spark, d)
    return V.cart_suggestions(open_carts(spark, d, "p_brand"), stored, as_products(catalog)).withColumn(
        "rank", F.col("rank").cast("long")
    )


@query("mining_run_stored", f"""{rule_sql(WIDE)}, {S.recommendations()}, {S.CATALOG}
{S.stored('recs', 'fpgrowth')}""")
def _(spark, d):
    """The whole mining run, read back from what it stored."""
    lines = stored_lines(spark, d)
    names = materialize(C.catalog_names(lines)).select(F.col("description").alias("name"))
    return run_mining(
        spark, lines, names, scratch_folder(spark), MiningSettings(WIDE[1], WIDE[2]), key=ORDER_KEY
    ).recommendations


@query("run_log", f"""{S.basket_ctes('p_type')} SELECT algorithm, CAST(0.05 AS DOUBLE) AS min_support,
  CAST(0.1 AS DOUBLE) AS min_confidence, (SELECT count(*) FROM baskets) AS transaction_count, 'system' AS created_by
FROM (VALUES ('fpgrowth'), ('apriori')) t(algorithm)""")
def _(spark, d):
    """Runs of two algorithms saved, then the latest of each read from the log."""
    folder = scratch_folder(spark)
    runs = [MiningSettings(LARGE[1], LARGE[2], a) for a in ("fpgrowth", "apriori", "fpgrowth")]
    for k, found in enumerate(mine_all(mining_baskets(spark, d, LARGE[0]), runs)):
        save_run(found, folder, f"run-{k}")
    runs = spark.read.parquet(f"{folder}/runs")
    kept = latest_runs(runs).join(recent_runs(runs, None).select(F.col("id").alias("run_id")), "run_id", "left_semi")
    return kept.select("algorithm", "min_support", "min_confidence", "transaction_count", "created_by")


@query("run_list", f"""{S.basket_ctes('p_type')} SELECT 'run-' || k AS id, algorithm, '2024-01-0' || (k + 1) || 'T12:00:00' AS created_at,
  'system' AS created_by FROM (VALUES (0, 'fpgrowth'), (1, 'apriori'), (2, 'son')) t(k, algorithm) WHERE EXISTS (SELECT 1 FROM baskets)
ORDER BY k DESC LIMIT 2""")
def _(spark, d):
    """The two latest of three runs, with the columns of the run list."""
    with scratch(spark) as job:
        folder = scratch_folder(spark)
        runs = [MiningSettings(LARGE[1], LARGE[2], a) for a in ("fpgrowth", "apriori", "son")]
        for k, found in enumerate(mine_all(mining_baskets(spark, d, LARGE[0]), runs)):
            save_run(found, folder, f"run-{k}", created_at=datetime(2024, 1, k + 1, 12, tzinfo=timezone.utc))
        return job.keep(recent_runs(spark.read.parquet(f"{folder}/runs"), 2))


@query("run_exported", f"""{rule_sql()} SELECT 'itemset' AS kind, array_to_string(items, ' | ') AS left_items, '' AS right_items, freq,
  support, CAST(0 AS DOUBLE) AS confidence FROM itemsets
UNION ALL SELECT 'rule', array_to_string(antecedents, ' | '), array_to_string(consequents, ' | '), freq, support, confidence FROM rules""")
def _(spark, d):
    """A saved run exported as JSON and imported again."""
    with scratch(spark) as job:
        folder = scratch_folder(spark)
        save_run(mined(spark, d), f"{folder}/runs", "run-0")
        export_run_json(*load_run(spark, f"{folder}/runs", "run-0"), f"{folder}/json")
        itemsets, rules = import_run_json(spark, f"{folder}/json")
        text = lambda c: F.array_join(c, " | ")
        return job.keep(itemsets.select(
            F.lit("itemset").alias("kind"), text("items").alias("left_items"), F.lit("").alias("right_items"), "freq", "support",
            F.lit(0.0).alias("confidence"),
        ).unionByName(rules.select(
            F.lit("rule").alias("kind"), text("antecedents").alias("left_items"), text("consequents").alias("right_items"), "freq",
            "support", "confidence",
        )))


@query("state_restored", f"{REC_SQL} SELECT *, {RANKED} AS rank FROM recs")
def _(spark, d):
    """Recommendations from a state that was saved and restored."""
    with scratch(spark) as job:
        folder = scratch_folder(spark)
        found = mined(spark, d, WIDE)
        save_state(found.itemsets, found.rules, R.ranked(R.all_recommendations(found.itemsets, found.rules)), folder)
        itemsets, rules, saved = load_state(spark, folder)
        again = R.ranked(R.all_recommendations(itemsets, rules)).select("product", "rec_product")
        return job.keep(saved.join(again, ["product", "rec_product"], "left_semi").withColumn("rank", F.col("rank").cast("long")))


REPLACED_CONFIDENCE = 0.3


@query("one_algorithm_replaced", f"""{rule_sql(WIDE)}, {S.rules(str(REPLACED_CONFIDENCE), name='rules3')},
{S.rules(str(APRIORI_CONFIDENCE), name='rules2')}, {S.recommendations('rules2', name='recs2')},
{S.recommendations('rules3', name='recs3')}, {S.CATALOG}
{S.stored('recs2', 'apriori')} UNION ALL {S.stored('recs3', 'fpgrowth')}""")
def _(spark, d):
    """Recommendations of two algorithms stored, then those of one replaced by a run at another confidence."""
    with scratch(spark) as job:
        folder = scratch_folder(spark)
        again = MiningSettings(WIDE[1], REPLACED_CONFIDENCE, "fpgrowth")
        (*_, found), names, stored = mined_and_stored(stored_lines(spark, d), again)
        replace_recommendations(stored, folder)
        replace_recommendations(V.stored_recommendations(R.all_recommendations(found.itemsets, found.rules), names, "fpgrowth"), folder)
        return job.keep(read_recommendations(spark, folder))


@query("catalog_replaced", f"""{S.cleaned(WIDE[0])}, {S.CATALOG} SELECT row_number() OVER (ORDER BY description) AS id, description AS name,
  'General' AS category, avg_price AS price, description, stock_code, CAST(0 AS BIGINT) AS recommendations FROM catalog""")
def _(spark, d):
    """The catalog stored anew, which empties the recommendations of the old one."""
    with scratch(spark) as job:
        folder = scratch_folder(spark)
        catalog, stored = catalog_and_stored(spark, d)
        replace_recommendations(stored, f"{folder}/recommendations")
        replace_products(C.product_table(catalog), f"{folder}/products", f"{folder}/recommendations")
        left = read_recommendations(spark, f"{folder}/recommendations").count()
        products = spark.read.parquet(f"{folder}/products").drop("image_url")
        return job.keep(products.withColumn("recommendations", F.lit(left).cast("long")))


@query("mining_of_nothing", f"""{S.basket_ctes('p_type')}, nothing AS (SELECT * FROM baskets WHERE len(items) > 1000000)
SELECT algorithm, (SELECT count(*) FROM nothing) AS itemsets, (SELECT count(*) FROM nothing) AS rules
FROM (VALUES ('fpgrowth'), ('apriori'), ('son')) t(algorithm)""")
def _(spark, d):
    """All miners over baskets of which a filter leaves none."""
    nothing = mining_baskets(spark, d, "p_type").filter(F.size("items") > 1_000_000)
    counts = None
    for found in mine_all(nothing, [MiningSettings(LARGE[1], LARGE[2], a) for a in ("fpgrowth", "apriori", "son")]):
        for name, df in (("itemsets", found.itemsets), ("rules", found.rules)):
            one = df.agg(F.count(F.lit(1)).alias("n")).withColumns({"algorithm": F.lit(found.settings.algorithm), "kind": F.lit(name)})
            counts = one if counts is None else counts.unionByName(one)
    held = lambda name: F.sum(F.when(F.col("kind") == name, F.col("n"))).alias(name)
    return counts.groupBy("algorithm").agg(held("itemsets"), held("rules"))


# ---- checks -------------------------------------------------------------------------------

# Every seventh count is spoiled before the check, and the SQL counts those.
SPOILED = "freq % 7 = 0"


def spoiled(df, **columns):
    """``df`` with the columns moved by so much in every seventh row, told by its count."""
    return df.withColumns({c: F.when(F.expr(SPOILED), F.col(c) + by).otherwise(F.col(c)) for c, by in columns.items()})


def _violations(check: str, source: str) -> str:
    return f"SELECT '{check}' AS check_name, count(*) AS total, count(*) FILTER ({SPOILED}) AS violations FROM {source}"


@query("validate_itemsets", f"{itemset_sql()} {_violations('itemset_recount', 'itemsets')}")
def _(spark, d):
    carts = materialize(mining_baskets(spark, d, LARGE[0]))
    found = mine(carts, MiningSettings(*LARGE[1:]))
    return Q.check_itemsets(carts, spoiled(found.itemsets, freq=1), found.n_baskets)


@query("validate_rules", f"{rule_sql(WIDE)} {_violations('rule_recompute', 'rules')}")
def _(spark, d):
    carts = materialize(mining_baskets(spark, d, WIDE[0]))
    found = mine(carts, MiningSettings(*WIDE[1:]))
    return Q.check_rules(carts, spoiled(found.rules, lift=1), found.n_baskets)


@query("threshold_violations", f"""{rule_sql()} {_violations('rule_min_support', 'rules')}
UNION ALL {_violations('rule_min_confidence', 'rules')}""")
def _(spark, d):
    return Q.check_thresholds(spoiled(mined(spark, d).rules, support=-1, confidence=-1), LARGE[1], LARGE[2])


@query("unique_itemsets", f"""{itemset_sql()} SELECT 'itemset_unique' AS check_name,
  count(*) + count(*) FILTER ({SPOILED}) AS total, count(*) FILTER ({SPOILED}) AS violations FROM itemsets""")
def _(spark, d):
    """Some itemsets are listed again, their items in another order."""
    found = mined(spark, d, algorithm="son").itemsets
    again = found.filter(SPOILED).withColumn("items", F.reverse("items"))
    return Q.check_unique(found.unionByName(again))


@query("positive_rule_share", f"""{rule_sql(WIDE)} SELECT count(*) AS rules, count(*) FILTER (lift > 1) AS positive,
  avg(CAST(lift > 1 AS INT)) AS positive_share FROM rules""")
def _(spark, d):
    return Q.positive_share(mined(spark, d, WIDE).rules)


@query("rule_overlap", f"""{rule_sql()}, {S.rules('0.2', name='fewer')}
SELECT (SELECT count(*) FROM rules) AS left_rules, count(*) AS right_rules, count(*) AS common,
  (SELECT count(*) FROM rules) - count(*) AS left_only, CAST(0 AS BIGINT) AS right_only,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM rules) AS overlap_pct FROM fewer""")
def _(spark, d):
    """FP-Growth rules against Apriori rules at a higher confidence."""
    left, right = mined_twice(spark, d, "apriori", 0.2)
    return Q.rule_overlap(left.rules, right.rules)


@query("rule_differences", f"""{rule_sql()} SELECT array_to_string(antecedents, ' | ') AS antecedents,
  array_to_string(consequents, ' | ') AS consequents, 'left' AS only_in FROM rules WHERE confidence < 0.2::DOUBLE""")
def _(spark, d):
    left, right = mined_twice(spark, d, "son", 0.2)
    return _join(Q.rule_differences(left.rules, right.rules), "antecedents", "consequents")


@query("rule_agreement", f"{rule_sql()} {_violations('rule_agreement', 'rules')}")
def _(spark, d):
    left, right = mined_twice(spark, d, "apriori", LARGE[2])
    return Q.check_agreement(left.rules, spoiled(right.rules, lift=1))


@query("recs_backed", f"""{STORED_SQL} SELECT DISTINCT product, rec_product,
  CASE WHEN EXISTS (SELECT 1 FROM rules r WHERE list_contains(list_concat(r.antecedents, r.consequents), s.product)
    AND list_contains(list_concat(r.antecedents, r.consequents), s.rec_product)) THEN 'rule' ELSE 'itemset' END AS backed_by
  FROM stored s""")
def _(spark, d):
    (found, _), _, stored = mined_and_stored(stored_lines(spark, d))
    return Q.recommendation_evidence(stored, found.rules, found.itemsets)


@query("recs_backed_check", f"{STORED_SQL} SELECT 'recommendation_backed' AS check_name, 2 * count(*) AS total, count(*) AS violations FROM (SELECT DISTINCT product, rec_product FROM stored)")
def _(spark, d):
    """Each recommendation is checked besides one of a product that there is not."""
    (found, _), _, stored = mined_and_stored(stored_lines(spark, d))
    stored = stored.select("product", "rec_product")
    none = stored.withColumn("rec_product", F.concat(F.lit("no "), "rec_product"))
    return Q.check_recommendations(stored.unionByName(none), found.rules, found.itemsets)


# ---- held-out evaluation ------------------------------------------------------------------

_TEST = f"CAST('0x' || substr(md5(InvoiceNo || '/7'), 1, 8) AS BIGINT) < {int(0.2 * 2**32)}"


@query("hold_out_hit_rate", f"""{S.basket_ctes('p_brand')},
train AS (SELECT * FROM baskets WHERE NOT {_TEST}), test AS (SELECT * FROM baskets WHERE {_TEST}),
{S.itemsets('0.005', 'train')}, {S.rules('0.1')}, {S.recommendations()},
held AS (SELECT InvoiceNo AS cart_id, items, list_sort(list_transform(items,
  lambda i: {{'h': md5(i || InvoiceNo || '/7'), 'i': i}}))[1].i AS held FROM test),
carts AS (SELECT cart_id, held, unnest(list_filter(items, lambda i: i <> held)) AS product FROM held),
scored AS (SELECT cart_id, rec_product AS product,
  sum(CAST(round(CASE WHEN lift <> 0 THEN lift ELSE support END * 1e9::DOUBLE) AS BIGINT)) AS w
  FROM carts JOIN recs USING (product)
  WHERE NOT EXISTS (SELECT 1 FROM carts c WHERE c.cart_id = carts.cart_id AND c.product = rec_product) GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cart_id ORDER BY w DESC, product) AS rank FROM scored) WHERE rank <= 5)
SELECT count(*) AS baskets, count(top.product) AS hits, count(top.product) / count(*) AS hit_rate
FROM held LEFT JOIN top ON held.cart_id = top.cart_id AND held.held = top.product""")
def _(spark, d):
    train, test = split_baskets(mining_baskets(spark, d, WIDE[0]))
    found = mine(train, MiningSettings(WIDE[1], WIDE[2]))
    return hit_rate(test, R.all_recommendations(found.itemsets, found.rules))


