"""Queries over retail lines, baskets, profiles and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillspark.functions.text import short_description
from tillspark.operators import baskets as B
from tillspark.operators import catalog as C
from tillspark.operators import clean as K
from tillspark.operators import profile as P
from tillspark.operators.incremental import load_part, profile
from tillspark.operators.text_index import basket_counts_by_search, search_all, store_index
from tillspark.operators.validate import check_baskets
from tillspark.runtime import materialize, scratch, scratch_folder
from tillspark.sinks.exports import export_baskets_csv
from tillspark.sinks.tables import replace_lines_by_month
from tillspark.sources.order_tables import ORDER_KEY, retail_lines, table
from tillspark.sources.retail import read_csv
from tillspark.workloads import checking_sql as S
from tillspark.workloads.registry import query

ITEM = "p_type"
SHOWN_LINE = "InvoiceNo, StockCode, Description, Quantity, InvoiceDate, CAST(UnitPrice AS VARCHAR) AS UnitPrice, CustomerID, Country"


def cleaned(spark, sf_dir, item=ITEM, key=False):
    return K.clean(retail_lines(spark, sf_dir, item, key=key))


def mining_baskets(spark, sf_dir, item=ITEM, min_items=2):
    return B.baskets(cleaned(spark, sf_dir, item, key=True), min_items, key=ORDER_KEY)


def _as_text(df):
    return df.withColumn("UnitPrice", F.col("UnitPrice").cast("string"))


# ---- lines and cleaning -------------------------------------------------------------------

@query("retail_lines", f"WITH {S.lines(ITEM)} SELECT {SHOWN_LINE} FROM lines")
def _(spark, d):
    return _as_text(retail_lines(spark, d, ITEM, country=True))


for _rule in K.RULE_NAMES:
    query(f"clean_rule_{_rule}", f"WITH {S.lines(ITEM)} SELECT {SHOWN_LINE} FROM lines WHERE NOT {S.dropped(_rule)}")(
        lambda spark, d, rule=_rule: _as_text(K.drop_by(retail_lines(spark, d, ITEM, country=True), rule))
    )


@query("clean_all", f"{S.cleaned(ITEM)} SELECT {SHOWN_LINE} FROM cleaned")
def _(spark, d):
    return _as_text(K.clean(retail_lines(spark, d, ITEM, country=True)))


_REPORT = ", ".join(
    ["count(*) AS raw_rows"]
    + [f"count(*) FILTER ({S.dropped(r)}) AS hit_{r}" for r in K.RULE_NAMES]
    + [f"count(*) FILTER (NOT {S.ANY_DROP}) AS kept_rows"]
)


@query("clean_report", f"WITH {S.lines(ITEM)} SELECT {_REPORT} FROM lines")
def _(spark, d):
    return K.clean_report(retail_lines(spark, d, ITEM))


@query("csv_round_trip", f"WITH {S.lines(ITEM)} SELECT {_REPORT} FROM lines")
def _(spark, d):
    """Lines written as CSV with a differently spelled header, read back and cleaned."""
    return K.clean_report(read_csv(spark, _written_csv(spark, retail_lines(spark, d, ITEM))))


def _written_csv(spark, lines):
    folder = scratch_folder(spark)
    lines.toDF(*[f" {c.upper()} " for c in lines.columns]).write.csv(
        folder, header=True, quoteAll=True, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return folder


@query("csv_rows", f"""{S.cleaned(ITEM)} SELECT InvoiceNo, StockCode, trim(Description) AS Description, Quantity, InvoiceDate,
  CAST(UnitPrice AS VARCHAR) AS UnitPrice, CustomerID, Country FROM cleaned""")
def _(spark, d):
    """The rows themselves: written as CSV, headers aligned, values coerced, cleaned."""
    with scratch(spark) as job:
        folder = _written_csv(spark, retail_lines(spark, d, ITEM, country=True))
        return job.keep(_as_text(K.clean(read_csv(spark, folder))))


@query("lines_by_month", f"""{S.cleaned(ITEM)}
SELECT strftime(strptime(InvoiceDate, '%m/%d/%Y %H:%M'), '%Y-%m') AS invoice_month,
  count(*) AS row_count FROM cleaned GROUP BY 1""")
def _(spark, d):
    """Cleaned lines stored by month and counted per stored month."""
    folder = scratch_folder(spark)
    replace_lines_by_month(cleaned(spark, d), folder)
    stored = spark.read.option("basePath", folder).parquet(folder)
    return stored.groupBy(F.col("invoice_month").cast("string").alias("invoice_month")).agg(
        F.count("*").alias("row_count")
    )


@query("month_lines", f"""{S.cleaned(ITEM)} SELECT strftime(strptime(InvoiceDate, '%m/%d/%Y %H:%M'), '%Y-%m') AS invoice_month,
  InvoiceNo, StockCode, Description, Quantity, CAST(UnitPrice AS VARCHAR) AS UnitPrice FROM cleaned""")
def _(spark, d):
    """The lines themselves, read back from the monthly table."""
    with scratch(spark) as job:
        folder = scratch_folder(spark)
        replace_lines_by_month(cleaned(spark, d), folder)
        stored = spark.read.option("basePath", folder).parquet(folder)
        return job.keep(_as_text(stored).select(F.col("invoice_month").cast("string").alias("invoice_month"), "InvoiceNo", "StockCode",
                                                "Description", "Quantity", "UnitPrice"))


# ---- baskets ------------------------------------------------------------------------------

@query("baskets_array", f"{S.basket_ctes(ITEM)} SELECT InvoiceNo, array_to_string(items, ' | ') AS items, len(items) AS item_count FROM baskets")
def _(spark, d):
    return mining_baskets(spark, d).select(
        "InvoiceNo", F.array_join("items", " | ").alias("items"),
        F.size("items").cast("long").alias("item_count"),
    )


@query("baskets_string", f"{S.basket_ctes(ITEM)} SELECT InvoiceNo, array_to_string(items, ', ') AS Items FROM all_baskets")
def _(spark, d):
    return B.as_text(B.baskets(cleaned(spark, d), min_items=1, trim=False))


@query("baskets_view", f"{S.basket_ctes(ITEM)} SELECT InvoiceNo, array_to_string(items, ', ') AS Items FROM all_baskets")
def _(spark, d):
    B.basket_view(cleaned(spark, d), "market_basket_transactions")
    return spark.sql("SELECT * FROM market_basket_transactions ORDER BY InvoiceNo")


@query("baskets_json", f"""{S.cleaned(ITEM)}
SELECT InvoiceNo, CAST(to_json(list(Description ORDER BY Description)) AS VARCHAR) AS ItemsJSON
FROM cleaned WHERE trim(Description) <> '' GROUP BY InvoiceNo""")
def _(spark, d):
    return B.as_json(cleaned(spark, d))


@query("baskets_with_stats", f"""{S.basket_ctes(ITEM)} SELECT InvoiceNo, array_to_string(items, ', ') AS Items,
  len(items) AS ItemCount, avg(len(items)) OVER () AS AvgItemsPerTransaction,
  CAST(min(len(items)) OVER () AS DOUBLE) AS MinItemsPerTransaction,
  CAST(max(len(items)) OVER () AS DOUBLE) AS MaxItemsPerTransaction FROM all_baskets""")
def _(spark, d):
    stats = B.with_size_stats(B.baskets(cleaned(spark, d), min_items=1, trim=False))
    return stats.withColumn("Items", F.array_join("items", ", ")).withColumn(
        "ItemCount", F.col("ItemCount").cast("long")
    ).select("InvoiceNo", "Items", "ItemCount", "AvgItemsPerTransaction", "MinItemsPerTransaction",
             "MaxItemsPerTransaction")


@query("baskets_with_freqs", f"""{S.basket_ctes(ITEM)},
freq AS (SELECT Description, count(DISTINCT InvoiceNo) AS k FROM cleaned WHERE trim(Description) <> '' GROUP BY 1)
SELECT InvoiceNo, string_agg(item, ', ' ORDER BY item) AS Items,
  string_agg(CAST(k AS VARCHAR), ', ' ORDER BY item) AS ItemFrequencies
FROM pairs JOIN freq ON item = Description GROUP BY InvoiceNo""")
def _(spark, d):
    return B.with_item_frequencies(cleaned(spark, d)).select(
        "InvoiceNo", F.array_join("items", ", ").alias("Items"),
        F.array_join(F.col("frequencies").cast("array<string>"), ", ").alias("ItemFrequencies"),
    )


@query("baskets_gt_5", f"{S.basket_ctes('p_brand')} SELECT InvoiceNo, array_to_string(items, ', ') AS Items FROM baskets WHERE len(items) > 5")
def _(spark, d):
    return B.as_text(B.more_than(mining_baskets(spark, d, "p_brand"), 5))


@query("baskets_containing_item", f"{S.basket_ctes('p_brand')} SELECT InvoiceNo, array_to_string(items, ', ') AS Items FROM baskets WHERE list_contains(items, 'Brand#1')")
def _(spark, d):
    return B.as_text(B.containing(mining_baskets(spark, d, "p_brand"), "Brand#1"))


@query("baskets_containing_text", f"{S.basket_ctes('p_brand')} SELECT InvoiceNo, array_to_string(items, ', ') AS Items FROM baskets WHERE len(list_filter(items, lambda x: contains(x, '#1'))) > 0")
def _(spark, d):
    return B.as_text(B.containing(mining_baskets(spark, d, "p_brand"), "#1", exact=False))


@query("baskets_json_rows", f"{S.basket_ctes(ITEM)} SELECT '{{\"InvoiceNo\":\"' || InvoiceNo || '\",\"Items\":' || CAST(to_json(items) AS VARCHAR) || '}}' AS value FROM all_baskets")
def _(spark, d):
    return B.json_rows(B.baskets(cleaned(spark, d), min_items=1))


@query("baskets_fold_case", f"""{S.cleaned(ITEM)}
SELECT InvoiceNo, string_agg(DISTINCT lower(trim(Description)), ', ' ORDER BY lower(trim(Description))) AS Items
FROM cleaned WHERE trim(Description) <> '' GROUP BY InvoiceNo""")
def _(spark, d):
    return B.as_text(B.baskets(cleaned(spark, d), min_items=1, fold_case=True))


@query("first_transactions", f"{S.basket_ctes(ITEM)} SELECT InvoiceNo, array_to_string(items, ', ') AS Items FROM baskets")
def _(spark, d):
    return B.as_text(P.first_baskets(mining_baskets(spark, d), None))


@query("first_2000_baskets", f"""{S.basket_ctes(ITEM)} SELECT InvoiceNo, array_to_string(items, ', ') AS Items FROM baskets
  ORDER BY InvoiceNo LIMIT 2000""")
def _(spark, d):
    return B.as_text(P.first_baskets(mining_baskets(spark, d), 2000))


@query("baskets_csv", f"{S.basket_ctes(ITEM)} SELECT InvoiceNo, array_to_string(items, ', ') AS Items FROM baskets")
def _(spark, d):
    """Baskets exported as a delimited file and read back."""
    with scratch(spark) as job:
        folder = scratch_folder(spark)
        export_baskets_csv(mining_baskets(spark, d), folder)
        return job.keep(spark.read.csv(folder, header=True, schema="InvoiceNo string, Items string", escape='"'))


@query("sample_baskets", f"""{S.basket_ctes(ITEM)} SELECT InvoiceNo, array_to_string(items, ', ') AS Items,
  len(items) AS NumberOfItems FROM all_baskets ORDER BY md5(InvoiceNo || '/11'), InvoiceNo LIMIT 10""")
def _(spark, d):
    return P.sample_baskets(B.baskets(cleaned(spark, d), min_items=1), 10, seed=11).select(
        "InvoiceNo", F.array_join("items", ", ").alias("Items"), F.col("NumberOfItems").cast("long")
    )


@query("frequent_transactions", f"""{S.basket_ctes('p_brand')},
counts AS (SELECT item, count(*) AS freq FROM (SELECT unnest(items) AS item FROM baskets) GROUP BY 1 HAVING count(*) >= 1400)
SELECT InvoiceNo, string_agg(item, ', ' ORDER BY freq DESC, item) AS Items
FROM (SELECT InvoiceNo, unnest(items) AS item FROM baskets) JOIN counts USING (item) GROUP BY InvoiceNo""")
def _(spark, d):
    return B.as_text(B.frequent_transactions(cleaned(spark, d, "p_brand"), 1400))


@query("check_baskets", f"""{S.basket_ctes(ITEM)}
SELECT 'basket_distinct_items' AS check_name, count(*) AS total,
  count(*) FILTER (len(items) <> len(list_distinct(items))) AS violations FROM baskets
UNION ALL SELECT 'basket_min_items', count(*), count(*) FILTER (len(items) < 2) FROM baskets""")
def _(spark, d):
    return check_baskets(mining_baskets(spark, d))


# ---- profile ------------------------------------------------------------------------------

_AVERAGE = """(SELECT coalesce(round(avg(k), 2), 0) FROM (SELECT count(DISTINCT Description) AS k
  FROM cleaned WHERE Description IS NOT NULL GROUP BY InvoiceNo))"""


@query("row_counts", f"{S.cleaned(ITEM)} SELECT count(*) AS row_count FROM cleaned")
def _(spark, d):
    return P.row_count(cleaned(spark, d))


@query("distinct_counts", f"""{S.cleaned(ITEM)} SELECT count(DISTINCT InvoiceNo) AS transaction_count,
  count(DISTINCT Description) AS unique_products FROM cleaned""")
def _(spark, d):
    return P.distinct_counts(cleaned(spark, d))


@query("average_basket_size", f"{S.cleaned(ITEM)} SELECT {_AVERAGE} AS avg_basket_size")
def _(spark, d):
    return P.average_basket_size(cleaned(spark, d))


@query("transaction_stats", f"""{S.cleaned(ITEM)} SELECT (SELECT count(*) FROM lines) AS raw_row_count,
  count(*) AS cleaned_row_count, count(DISTINCT InvoiceNo) AS transaction_count,
  count(DISTINCT Description) AS unique_products, {_AVERAGE} AS avg_basket_size FROM cleaned""")
def _(spark, d):
    raw = retail_lines(spark, d, ITEM)
    return P.transaction_stats(raw, K.clean(raw))


def _loaded_by_years(spark, sf_dir, parts=None):
    """The profile after three loads, each of lines of other years; the first is loaded twice."""
    with scratch(spark) as job:
        folder = scratch_folder(spark)
        raw = retail_lines(spark, sf_dir, ITEM)
        year = F.regexp_extract("InvoiceDate", r"/(\d{4}) ", 1).cast("int")
        for k in (0, 1, 2, 0):
            load_part(raw.filter(year % 3 == k), folder, f"part {k}")
        return job.keep(profile(spark, folder, parts))


_STATS = f"""SELECT (SELECT count(*) FROM lines) AS raw_row_count,
  count(*) AS cleaned_row_count, count(DISTINCT InvoiceNo) AS transaction_count,
  count(DISTINCT Description) AS unique_products, {_AVERAGE} AS avg_basket_size FROM cleaned"""


@query("profile_by_loads", f"{S.cleaned(ITEM)} {_STATS}")
def _(spark, d):
    return _loaded_by_years(spark, d)


@query("profile_of_two_loads", f"""WITH {S.lines(ITEM).replace("lines AS (", "every AS (", 1)},
lines AS (SELECT * FROM every WHERE CAST(regexp_extract(InvoiceDate, '/(\\d{{4}}) ', 1) AS INT) % 3 < 2), {S.CLEANED} {_STATS}""")
def _(spark, d):
    return _loaded_by_years(spark, d, ["part 0", "part 1"])


@query("load_report", f"""{S.cleaned(ITEM)}
SELECT 'raw_rows' AS metric, count(*) AS value FROM lines
UNION ALL SELECT 'cleaned_rows', count(*) FROM cleaned
UNION ALL SELECT 'unique_transactions', count(DISTINCT InvoiceNo) FROM cleaned
UNION ALL SELECT 'unique_products', count(DISTINCT Description) FROM cleaned""")
def _(spark, d):
    raw = retail_lines(spark, d, ITEM)
    return P.load_report(raw, K.clean(raw))


@query("basket_statistics", f"""{S.basket_ctes(ITEM)} SELECT count(*) AS total_transactions,
  (SELECT count(DISTINCT item) FROM pairs) AS unique_items, round(avg(len(items)), 2) AS avg_items,
  min(len(items)) AS min_items, max(len(items)) AS max_items, round(median(len(items)), 2) AS median_items
  FROM all_baskets""")
def _(spark, d):
    stats = P.basket_statistics(B.baskets(cleaned(spark, d), min_items=1))
    return stats.withColumns({c: F.col(c).cast("long") for c in ("min_items", "max_items")})


@query("basket_totals", f"{S.basket_ctes(ITEM)} SELECT count(*) AS TotalTransactions, avg(len(items)) AS AvgItemsPerTransaction FROM all_baskets")
def _(spark, d):
    return P.basket_totals(B.baskets(cleaned(spark, d), min_items=1))


@query("item_frequency", f"""{S.cleaned(ITEM)} SELECT Description, count(DISTINCT InvoiceNo) AS transaction_count,
  count(*) AS row_count FROM cleaned WHERE trim(Description) <> '' GROUP BY Description""")
def _(spark, d):
    return P.item_frequency(cleaned(spark, d))


@query("item_counts", f"{S.basket_ctes('p_name')} SELECT unnest(items) AS item, count(*) AS freq FROM baskets GROUP BY 1")
def _(spark, d):
    return P.item_counts(mining_baskets(spark, d, "p_name"))


@query("most_common_items", f"""{S.basket_ctes('p_brand')}
SELECT item, count(*) AS freq FROM (SELECT unnest(items) AS item FROM all_baskets)
GROUP BY item ORDER BY freq DESC, item LIMIT 10""")
def _(spark, d):
    return P.most_common_items(mining_baskets(spark, d, "p_brand", 1))


@query("distinct_invoice_items", f"{S.basket_ctes(ITEM)} SELECT InvoiceNo, item FROM pairs")
def _(spark, d):
    return B.basket_items(cleaned(spark, d))


@query("duplicate_items", f"""{S.cleaned(ITEM)} SELECT InvoiceNo, Description, count(*) AS DuplicateCount
  FROM cleaned WHERE trim(Description) <> '' GROUP BY ALL HAVING count(*) > 1""")
def _(spark, d):
    return P.duplicate_items(cleaned(spark, d)).orderBy(F.desc("DuplicateCount"), "InvoiceNo", "Description")


_QUALITY = """count(*) AS TotalRows, count(*) FILTER (Description IS NULL) AS NullDescriptions,
  count(*) FILTER (trim(Description) = '') AS EmptyDescriptions,
  count(*) FILTER (Description IS NULL OR trim(Description) = '') AS InvalidDescriptions"""


@query("quality_counters", f"{S.cleaned(ITEM)} SELECT {_QUALITY} FROM cleaned")
def _(spark, d):
    return P.quality_counters(cleaned(spark, d))


@query("quality_counters_raw", f"{S.cleaned(ITEM)} SELECT {_QUALITY} FROM lines")
def _(spark, d):
    return P.quality_counters(retail_lines(spark, d, ITEM))


@query("size_distribution", f"""{S.basket_ctes(ITEM)} SELECT len(items) AS ItemCount, count(*) AS TransactionCount,
  CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM all_baskets) AS Percentage
  FROM all_baskets GROUP BY 1""")
def _(spark, d):
    return P.size_distribution(cleaned(spark, d)).orderBy("ItemCount")


@query("basket_checksum", f"""{S.cleaned(ITEM)} SELECT InvoiceNo, count(*) AS ItemCount,
  sum(CAST('0x' || substr(md5(Description), 1, 15) AS BIGINT))::DECIMAL(38, 0) AS DescriptionChecksum
  FROM cleaned WHERE Description IS NOT NULL AND trim(Description) <> '' GROUP BY 1""")
def _(spark, d):
    return P.basket_checksum(cleaned(spark, d))


# ---- catalog ------------------------------------------------------------------------------

_CATALOG = f"{S.cleaned('p_name')}, {S.CATALOG}"
_PRODUCTS = f"""{_CATALOG}, products AS (SELECT row_number() OVER (ORDER BY description) AS id,
  description AS name, 'General' AS category, avg_price AS price, description, stock_code FROM catalog)"""


def products(spark, sf_dir, item="p_name"):
    return C.product_table(C.product_catalog(cleaned(spark, sf_dir, item), digits=None))


@query("product_catalog", f"{_CATALOG} SELECT * FROM catalog")
def _(spark, d):
    return C.product_catalog(cleaned(spark, d, "p_name"), digits=None).orderBy("description")


@query("catalog_to_two_places", f"""{_CATALOG} SELECT description, stock_code,
  CAST(round(CAST(sum_price AS DECIMAL(38, 10)) / n, 2) AS DOUBLE) AS avg_price FROM (SELECT Description AS description,
  min(StockCode) AS stock_code, sum(UnitPrice) AS sum_price, count(*) AS n FROM cleaned
  WHERE UnitPrice > 0 AND trim(Description) <> '' GROUP BY 1)""")
def _(spark, d):
    return C.product_catalog(cleaned(spark, d, "p_name"))


@query("average_prices", f"{S.cleaned('p_name')}, {S.PRICES} SELECT * FROM prices")
def _(spark, d):
    return C.average_prices(cleaned(spark, d, "p_name"))


@query("price_of_product", f"""{S.cleaned('p_name')} SELECT CAST(sum(UnitPrice) AS DOUBLE) / count(*) AS avg_price
  FROM cleaned WHERE UnitPrice > 0 AND Description = 'red widget'""")
def _(spark, d):
    return C.price_of(cleaned(spark, d, "p_name"), "red widget")


@query("positive_price_lines", f"{S.cleaned(ITEM)} SELECT count(*) AS row_count FROM cleaned WHERE UnitPrice > 0")
def _(spark, d):
    return P.row_count(K.positive_price(cleaned(spark, d)))


@query("product_table", f"{_PRODUCTS} SELECT id, name, category, price, description FROM products")
def _(spark, d):
    return C.product_api(products(spark, d))


@query("product_lookup", f"{_PRODUCTS} SELECT id, name, category, price, description FROM products WHERE name = 'red widget'")
def _(spark, d):
    return C.product_api(C.product_lookup(products(spark, d), name="red widget"))


@query("product_search", f"""{_PRODUCTS} SELECT name, description[1:100] || '...' AS card, price FROM products
  WHERE name ILIKE '%RED%' OR description ILIKE '%RED%'""")
def _(spark, d):
    found = C.search(products(spark, d), "RED")
    return found.select("name", short_description(F.col("description")).alias("card"), "price")


@query("price_list", f"""{_CATALOG}, listed AS (SELECT name, max(p_retailprice) AS list_price FROM
  (SELECT p_name AS name, p_retailprice FROM part UNION ALL SELECT p_brand, p_retailprice FROM part) GROUP BY 1)
SELECT name, coalesce(avg_price, list_price) AS price FROM listed LEFT JOIN catalog ON name = description""")
def _(spark, d):
    """List prices of names and brands; sales give mean prices for the names only."""
    part = table(spark, d, "part")
    listed = (
        part.select(F.col("p_name").alias("name"), "p_retailprice")
        .unionByName(part.select(F.col("p_brand").alias("name"), "p_retailprice"))
        .groupBy("name").agg(F.max("p_retailprice").alias("price"))
    )
    return C.price_list(listed, C.average_prices(cleaned(spark, d, "p_name")))


# ---- many searches ------------------------------------------------------------------------

# Over a thousand names, and texts of one character up to most of a name, with capitals and wildcards.
NAME = "(p_name || ' ' || p_brand)"
_TEXT = """CASE p_partkey % 6 WHEN 0 THEN substr(p_name, 3, 1 + p_partkey % 7) WHEN 1 THEN upper(substr(p_name, 2, 5))
  WHEN 2 THEN substr(p_name, 1, 2) || '%' || p_brand WHEN 3 THEN replace(p_name, 'e', '_')
  WHEN 4 THEN 'zz' || p_brand ELSE p_brand END"""
_SEARCHES = f"""{S.basket_ctes(NAME)}, {S.CATALOG}, searches AS (SELECT DISTINCT {_TEXT} AS text FROM part),
matches AS (SELECT text, description AS name FROM searches JOIN catalog ON description ILIKE '%' || text || '%')"""


def _searched(spark, sf_dir):
    """(text, name) by the stored index of the catalog's names."""
    names = C.product_catalog(cleaned(spark, sf_dir, NAME)).select(F.col("description").alias("name"))
    names, folder = materialize(names), scratch_folder(spark)
    store_index(names, "name", ["name"], folder)
    searches = table(spark, sf_dir, "part").select(F.expr(_TEXT).alias("text"))
    return search_all(searches, names, spark.read.schema("piece string, name string").parquet(folder), "name", ["name"])


@query("search_many", f"{_SEARCHES} SELECT text, name FROM matches")
def _(spark, d):
    with scratch(spark) as job:
        return job.keep(_searched(spark, d))


@query("baskets_by_search", f"""{_SEARCHES}, sold AS (SELECT InvoiceNo, unnest(items) AS name FROM baskets)
SELECT text, count(DISTINCT InvoiceNo) AS basket_count FROM matches JOIN sold USING (name) GROUP BY text""")
def _(spark, d):
    """How many baskets hold an item with each text."""
    with scratch(spark) as job:
        return job.keep(basket_counts_by_search(_searched(spark, d), mining_baskets(spark, d, NAME), "name"))
