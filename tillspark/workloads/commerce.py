"""Queries over carts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillspark.operators import commerce as M
from tillspark.operators.catalog import product_catalog
from tillspark.runtime import materialize, scratch, scratch_folder
from tillspark.sinks.tables import append_orders, dashboard
from tillspark.sources.order_tables import cart_customers, cart_events, open_carts
from tillspark.streaming.live_carts import latest, store_live_carts
from tillspark.workloads import checking_sql as S
from tillspark.workloads.mining import STORED_SQL, as_products, catalog_and_stored
from tillspark.workloads.preparation import cleaned
from tillspark.workloads.registry import query

ITEM = "p_name"
CART_SQL = f"""{S.cleaned(ITEM)}, {S.CATALOG}, {S.carts(ITEM)},
priced AS (SELECT cart_id, product, qty, avg_price AS price, avg_price * qty AS subtotal
  FROM carts JOIN catalog ON product = description),
totals AS (SELECT cart_id, CAST(sum(qty) AS BIGINT) AS cart_count,
  coalesce(CAST(sum(CAST(price AS DECIMAL(28, 8)) * CAST(qty AS DECIMAL(10, 0))) AS DOUBLE), 0) AS cart_total
  FROM carts LEFT JOIN (SELECT cart_id, product, price FROM priced) USING (cart_id, product) GROUP BY 1),
customers AS (SELECT CAST(o_orderkey AS VARCHAR) AS cart_id,
  CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE c_name END AS customer_name,
  lower(c_name) || '@example.org' AS customer_email
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'),
headers AS (SELECT cart_id, 'ORD-' || upper(md5(cart_id)) AS order_number,
  customer_name, customer_email, round(cart_total, 2) AS total_amount, 'completed' AS status
  FROM totals JOIN customers USING (cart_id) WHERE customer_name IS NOT NULL),
order_lines AS (SELECT cart_id, order_number, product, qty AS quantity, price FROM priced JOIN headers USING (cart_id))"""


def shop(spark, sf_dir):
    """Priced products, kept because several queries read them twice."""
    catalog = product_catalog(cleaned(spark, sf_dir, ITEM), digits=None)
    return materialize(as_products(catalog))


def headers(spark, sf_dir, products):
    return M.order_headers(open_carts(spark, sf_dir, ITEM), products, cart_customers(spark, sf_dir)).drop(
        "created_at"
    ).withColumn("total_amount", F.round("total_amount", 2))


@query("open_carts", f"WITH {S.carts(ITEM)} SELECT * FROM carts")
def _(spark, d):
    return open_carts(spark, d, ITEM)


@query("priced_carts", f"{CART_SQL} SELECT * FROM priced")
def _(spark, d):
    return M.priced_carts(open_carts(spark, d, ITEM), shop(spark, d))


@query("cart_totals", f"{CART_SQL} SELECT cart_id, cart_count, round(cart_total, 2) AS cart_total FROM totals")
def _(spark, d):
    return M.cart_totals(open_carts(spark, d, ITEM), shop(spark, d)).withColumn(
        "cart_total", F.round("cart_total", 2)
    )


@query("order_headers", f"{CART_SQL} SELECT * FROM headers")
def _(spark, d):
    return headers(spark, d, shop(spark, d))


@query("order_lines", f"{CART_SQL} SELECT * FROM order_lines")
def _(spark, d):
    products = shop(spark, d)
    return M.order_lines(open_carts(spark, d, ITEM), products, headers(spark, d, products))


@query("order_details", f"""{CART_SQL} SELECT cart_id, order_number, product, quantity, price, customer_name, status, total_amount
  FROM order_lines JOIN (SELECT cart_id, customer_name, status, total_amount FROM headers) USING (cart_id)""")
def _(spark, d):
    """Orders written, read back and put together."""
    products, folder = shop(spark, d), scratch_folder(spark)
    heads = headers(spark, d, products)
    append_orders(heads, M.order_lines(open_carts(spark, d, ITEM), products, heads), folder)
    return M.order_details(spark.read.parquet(f"{folder}/orders"), spark.read.parquet(f"{folder}/order_lines"))


FOLD_SQL = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS cart_id, event_id AS seq,
  'product ' || CAST(event_id % 7 AS VARCHAR) AS product, CAST(floor(value / 10) AS INT) AS qty,
  CASE event_type WHEN 'purchase' THEN 'add' WHEN 'click' THEN 'set' ELSE 'remove' END AS action
  FROM events WHERE event_type IN ('purchase', 'click', 'error')),
alive AS (SELECT *, max(CASE WHEN action = 'remove' OR (action = 'set' AND qty <= 0) THEN seq END)
  OVER (PARTITION BY cart_id, product) AS cut FROM e),
started AS (SELECT *, min(CASE WHEN action = 'add' THEN seq END) OVER (PARTITION BY cart_id, product) AS start
  FROM alive WHERE cut IS NULL OR seq > cut),
based AS (SELECT *, max(CASE WHEN action = 'set' THEN seq END) OVER (PARTITION BY cart_id, product) AS set_seq
  FROM started WHERE seq >= start)
SELECT cart_id, product, CAST(coalesce(max(CASE WHEN seq = set_seq THEN qty END), 0)
  + count(*) FILTER (action = 'add' AND (set_seq IS NULL OR seq > set_seq)) AS BIGINT) AS qty
FROM based GROUP BY 1, 2"""


@query("cart_fold", FOLD_SQL)
def _(spark, d):
    return M.fold_cart_events(cart_events(spark, d))


@query("live_carts", FOLD_SQL)
def _(spark, d):
    """The same carts from a stream: what each holds after the last batch that touched it."""
    with scratch(spark) as job:
        folder = scratch_folder(spark)
        stream = cart_events(spark, d, stream=True)
        store_live_carts(stream, f"{folder}/carts", f"{folder}/checkpoint").awaitTermination()
        return job.keep(latest(spark.read.parquet(f"{folder}/carts")).select("cart_id", "product", "qty"))


@query("dashboard", f"""{STORED_SQL} SELECT (SELECT count(*) FROM catalog) AS products,
  (SELECT count(*) FROM stored) AS recommendations""")
def _(spark, d):
    catalog, stored = catalog_and_stored(spark, d)
    return dashboard(catalog, stored)
