"""Product catalog and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions.text import non_blank
from tillspark.operators.clean import positive_price
from tillspark.runtime import salted_join, with_rank


def _mean_price() -> Column:
    """Sum of exact decimals, divided once: the same result for any partitioning."""
    return F.sum("UnitPrice").cast("double") / F.count("UnitPrice")


def average_prices(lines: DataFrame) -> DataFrame:
    """Mean of the positive prices of each description, blank and missing ones included."""
    return positive_price(lines).groupBy("Description").agg(_mean_price().alias("avg_price"))


def price_of(lines: DataFrame, name: str) -> DataFrame:
    """Mean positive price of one product, NULL when there is none."""
    return (
        positive_price(lines).filter(F.col("Description") == name)
        .agg(_mean_price().alias("avg_price"))
    )


def product_catalog(lines: DataFrame, digits: int | None = 2) -> DataFrame:
    """Per description, its least stock code and mean positive price."""
    price = _mean_price() if digits is None else F.round(_mean_price(), digits)
    return (
        positive_price(lines).filter(non_blank(F.col("Description")))
        .groupBy(F.col("Description").alias("description"))
        .agg(F.min("StockCode").alias("stock_code"), price.alias("avg_price"))
    )


def catalog_names(lines: DataFrame) -> DataFrame:
    """The descriptions of the catalog, without its codes and prices."""
    return positive_price(lines).filter(non_blank(F.col("Description"))).select(F.col("Description").alias("description")).distinct()


def product_table(catalog: DataFrame) -> DataFrame:
    """The catalog as products with ids in the order of their names."""
    return with_rank(catalog, "description").select(
        "id",
        F.col("description").alias("name"),
        F.lit("General").alias("category"),
        F.col("avg_price").alias("price"),
        F.lit(None).cast("string").alias("image_url"),
        "description",
        "stock_code",
    )


def with_effective_price(df: DataFrame, prices: DataFrame, name: str = "name") -> DataFrame:
    """``price`` replaced by the mean price of the product, where one is known."""
    known = prices.select(F.col("Description").alias(name), "avg_price")
    return df.join(known, name, "left").withColumn("price", F.coalesce("avg_price", "price")).drop("avg_price")


def price_list(products: DataFrame, prices: DataFrame) -> DataFrame:
    return with_effective_price(products, prices).select("name", "price")


def search(products: DataFrame, query: str = "") -> DataFrame:
    """Products whose name or description holds the query, ignoring case; all for an empty query.

    ``%`` and ``_`` in the query act as wildcards.
    """
    if not query:
        return products
    pattern = f"%{query}%"
    return products.filter(F.col("name").ilike(pattern) | F.col("description").ilike(pattern))


def product_lookup(df: DataFrame, **equal) -> DataFrame:
    """Rows equal to every given value."""
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    return df


def product_api(products: DataFrame) -> DataFrame:
    """The public columns of a product."""
    return products.select("id", "name", "category", "price", "description")


def recommendation_api(recommendations: DataFrame, products: DataFrame) -> DataFrame:
    """The public columns of stored recommendations, with the id and name of the target."""
    ids = products.select("id", "name")
    targets = ids.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    sources = ids.select(F.col("id").alias("for_product_id"), F.col("name").alias("product"))
    recs = recommendations.withColumnRenamed("rec_product", "product_name")
    named = salted_join(recs, targets, ["product_name"], ["product"])
    return (
        salted_join(named, sources, ["product"], ["product_name"])
        .select("for_product_id", "product_id", "product_name", "support", "confidence")
    )
