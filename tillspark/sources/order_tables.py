"""Retail lines, carts and cart events derived from order tables in Parquet.

The order tables are clean, so the mapping marks some lines the way real invoices are dirty
(cancelled, anonymous, returned, free, unnamed, postage and unknown values). Each mark follows
from key arithmetic, written the same way in Spark SQL and in the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.schemas import RETAIL_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The column by which lines of one invoice lie together after their joins. An invoice has one value of it.
ORDER_KEY = "l_orderkey"


def retail_lines(
    spark: SparkSession, sf_dir: str, item: str = "p_type", country: bool = False, key: bool = False
) -> DataFrame:
    """One retail line per order line; ``item`` is the part column used as description.

    ``country=False`` leaves Country NULL and saves the two joins that find it. ``key`` adds the order key.
    """
    columns = [*([ORDER_KEY] if key else []), *RETAIL_COLUMNS]
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.expr("l_returnflag = 'R' AND l_linenumber % 2 = 0").alias("cancelled"),
        F.expr("""CASE WHEN l_orderkey % 53 = 4 THEN NULL
            ELSE concat(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' AND l_linenumber % 3 = 0
            THEN '-' ELSE '' END, CAST(CAST(l_quantity AS INT) AS STRING)) END""").alias("Quantity"),
    )
    # What follows from the part or the order alone is worked out once per part or order; cleaning
    # rules on these columns then filter below the joins.
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.expr("""CASE WHEN p_partkey % 61 = 7 THEN 'POST' WHEN p_partkey % 67 = 9 THEN NULL
            ELSE concat('SKU', CAST(p_partkey AS STRING)) END""").alias("StockCode"),
        F.expr(f"""CASE WHEN p_partkey % 97 = 5 THEN NULL
            WHEN p_partkey % 89 = 3 THEN concat({item}, '?')
            WHEN p_partkey % 83 = 2 THEN '  ' ELSE {item} END""").alias("Description"),
        F.expr("""CAST(CASE WHEN p_partkey % 71 = 6 THEN 0 WHEN p_partkey % 73 = 8
            THEN -p_retailprice WHEN p_partkey % 79 = 1 THEN NULL
            ELSE p_retailprice END AS DECIMAL(28, 4))""").alias("UnitPrice"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        "o_custkey",
        F.date_format("o_orderdate", "M/d/yyyy H:mm").alias("InvoiceDate"),
        F.expr("CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END")
        .alias("CustomerID"),
    )
    # Orders come last, so that joins by shuffles leave the lines of an order together.
    joined = lines.join(parts, "l_partkey").join(orders, "l_orderkey").withColumn(
        "InvoiceNo", F.expr("concat(CASE WHEN cancelled THEN 'C' ELSE '' END, CAST(l_orderkey AS STRING))"))
    if not country:
        return joined.withColumn("Country", F.lit(None).cast("string")).select(*columns)
    homes = (
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        .join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                                    F.col("n_name").alias("Country")), "c_nationkey")
    )
    return joined.join(homes, "o_custkey").select(*columns)


def open_carts(spark: SparkSession, sf_dir: str, item: str = "p_type") -> DataFrame:
    """Open orders as carts: one row per cart and product with its quantity."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey")
    return (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part").select("p_partkey", item),
              F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").cast("string").alias("cart_id"), F.col(item).alias("product"))
        .agg(F.sum(F.col("l_quantity").cast("int")).alias("qty"))
    )


def cart_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who checks out each open cart; customers without a key count as nameless."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return (
        orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("cart_id"),
            F.expr("CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE c_name END").alias("customer_name"),
            F.expr("concat(lower(c_name), '@example.org')").alias("customer_email"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )
    )


def cart_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Clicks as cart edits: purchase adds, click sets a quantity, error removes. With ``stream``, of the files as they come."""
    events = table(spark, sf_dir, "events")
    if stream:
        # One path pattern for a table that is a file and for one that is a folder of files.
        events = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    return events.filter(
        F.col("event_type").isin("purchase", "click", "error")
    ).select(
        F.col("user_id").cast("string").alias("cart_id"),
        F.col("event_id").alias("seq"),
        F.expr("""CASE event_type WHEN 'purchase' THEN 'add' WHEN 'click' THEN 'set'
            ELSE 'remove' END""").alias("action"),
        F.expr("concat('product ', CAST(event_id % 7 AS STRING))").alias("product"),
        F.expr("CAST(floor(value / 10) AS INT)").alias("qty"),
    )
