"""SQL that recomputes every operator from the order tables, for checking results with DuckDB.

Itemsets are found here by listing all subsets of every basket, which shares nothing with the miners.
"""

from __future__ import annotations


def lines(item: str) -> str:
    return f"""lines AS (
  SELECT
    CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'C' ELSE '' END
      || CAST(l_orderkey AS VARCHAR) AS InvoiceNo,
    CASE WHEN l_partkey % 61 = 7 THEN 'POST' WHEN l_partkey % 67 = 9 THEN NULL
      ELSE 'SKU' || CAST(l_partkey AS VARCHAR) END AS StockCode,
    CASE WHEN l_partkey % 97 = 5 THEN NULL WHEN l_partkey % 89 = 3 THEN {item} || '?'
      WHEN l_partkey % 83 = 2 THEN '  ' ELSE {item} END AS Description,
    CASE WHEN l_orderkey % 53 = 4 THEN NULL ELSE
      CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN '-' ELSE '' END
      || CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS Quantity,
    strftime(o_orderdate, '%-m/%-d/%Y %-H:%M') AS InvoiceDate,
    CAST(CASE WHEN l_partkey % 71 = 6 THEN 0 WHEN l_partkey % 73 = 8 THEN -p_retailprice
      WHEN l_partkey % 79 = 1 THEN NULL ELSE p_retailprice END AS DECIMAL(28, 4)) AS UnitPrice,
    CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS CustomerID,
    n_name AS Country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


# What each cleaning rule drops.
DROPS = {
    "invoice": "upper(InvoiceNo) LIKE '%C%'",
    "customer": "CustomerID IS NULL",
    "quantity": "Quantity LIKE '%-%'",
    "price": "UnitPrice = 0 OR CAST(UnitPrice AS VARCHAR) LIKE '%-%'",
    "description": "Description IS NULL OR Description LIKE '%?%'",
    "postage": "StockCode = 'POST'",
}


def dropped(rule: str) -> str:
    return f"coalesce({DROPS[rule]}, false)"


ANY_DROP = "(" + " OR ".join(dropped(r) for r in DROPS) + ")"
CLEANED = f"cleaned AS (SELECT * FROM lines WHERE NOT {ANY_DROP})"
PAIRS = """pairs AS (SELECT DISTINCT InvoiceNo, trim(Description) AS item FROM cleaned
  WHERE trim(Description) <> '')"""
ALL_BASKETS = """all_baskets AS (SELECT InvoiceNo, list(item ORDER BY item) AS items FROM pairs
  GROUP BY InvoiceNo)"""
BASKETS = "baskets AS (SELECT * FROM all_baskets WHERE len(items) >= 2)"
PRICES = """prices AS (SELECT Description, CAST(sum(UnitPrice) AS DOUBLE) / count(*) AS avg_price
  FROM cleaned WHERE UnitPrice > 0 GROUP BY Description)"""
CATALOG = """catalog AS (SELECT Description AS description, min(StockCode) AS stock_code,
  CAST(sum(UnitPrice) AS DOUBLE) / count(*) AS avg_price FROM cleaned
  WHERE UnitPrice > 0 AND trim(Description) <> '' GROUP BY Description)"""


def cleaned(item: str) -> str:
    return f"WITH {lines(item)}, {CLEANED}"


def basket_ctes(item: str) -> str:
    return f"{cleaned(item)}, {PAIRS}, {ALL_BASKETS}, {BASKETS}"


def split_by_mask(bit: int) -> str:
    return f"list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = {bit})"


def itemsets(support: str, source: str = "baskets", name: str = "itemsets") -> str:
    return f"""n{name} AS (SELECT count(*) AS n FROM {source}),
subsets{name} AS (SELECT {split_by_mask(1)} AS items FROM
  (SELECT items, unnest(range(1, 1 << len(items))) AS mask FROM {source})),
{name} AS (SELECT items, count(*) AS freq, count(*) / any_value(n) AS support
  FROM subsets{name}, n{name} GROUP BY items HAVING count(*) >= {support} * any_value(n))"""


def rules(confidence: str, sets: str = "itemsets", name: str = "rules") -> str:
    return f"""splits{name} AS (SELECT {split_by_mask(1)} AS a, {split_by_mask(0)} AS c, freq FROM
  (SELECT items, freq, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM {sets} WHERE len(items) >= 2)),
{name} AS (SELECT s.a AS antecedents, s.c AS consequents, s.freq / fa.freq AS confidence,
  s.freq / n AS support, (s.freq / fa.freq) / (fc.freq / n) AS lift,
  s.freq AS freq, fa.freq AS freq_a, fc.freq AS freq_c, n
  FROM splits{name} s JOIN {sets} fa ON fa.items = s.a JOIN {sets} fc ON fc.items = s.c, n{sets}
  WHERE s.freq / fa.freq >= CAST({confidence} AS DOUBLE))"""


def recommendations(rules_name: str = "rules", sets: str = "itemsets", name: str = "recs") -> str:
    return f"""rule{name} AS (SELECT product, rec_product, confidence, support, lift, 'rule' AS source
  FROM (SELECT product, unnest(consequents) AS rec_product, confidence, support, lift FROM
    (SELECT unnest(antecedents) AS product, consequents, confidence, support, lift FROM {rules_name}))),
set{name} AS (SELECT product, rec_product, CAST(0 AS DOUBLE) AS confidence, max(support) AS support,
  CAST(0 AS DOUBLE) AS lift, 'itemset' AS source
  FROM (SELECT product, unnest(items) AS rec_product, support FROM
    (SELECT unnest(items) AS product, items, support FROM {sets} WHERE len(items) >= 2))
  WHERE product <> rec_product GROUP BY product, rec_product),
all{name} AS (SELECT * FROM rule{name} UNION ALL SELECT * FROM set{name} s WHERE NOT EXISTS
  (SELECT 1 FROM rule{name} r WHERE r.product = s.product AND r.rec_product = s.rec_product)),
{name} AS (SELECT * EXCLUDE (pos) FROM (SELECT *, row_number() OVER (PARTITION BY product, rec_product
  ORDER BY lift DESC, confidence DESC, support DESC) AS pos FROM all{name}) WHERE pos = 1)"""


BEST = "lift DESC, confidence DESC, support DESC, rec_product"
RULE_BEST = "lift DESC, confidence DESC, support DESC, antecedents, consequents"


def stored(recs: str, algorithm: str) -> str:
    return f"""SELECT product, rec_product, confidence, support, lift, '{algorithm}' AS algorithm FROM
  (SELECT *, row_number() OVER (PARTITION BY product ORDER BY {BEST}) AS pos FROM {recs}) r
  WHERE pos <= 10 AND product IN (SELECT description FROM catalog)
  AND rec_product IN (SELECT description FROM catalog)"""


def carts(item: str) -> str:
    return f"""carts AS (SELECT CAST(l_orderkey AS VARCHAR) AS cart_id, {item} AS product,
  CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE o_orderstatus = 'O' GROUP BY ALL)"""


FIRST_DEGREE = """first_degree AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY product, algorithm ORDER BY lift DESC, confidence DESC, support DESC, rec_product) AS rank
  FROM stored) WHERE rank <= 4)"""
