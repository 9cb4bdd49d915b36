"""From retail text to stored raw lines, cleaned lines and catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillspark.operators.catalog import product_catalog, product_table
from tillspark.operators.clean import clean
from tillspark.operators.profile import load_report
from tillspark.sinks.tables import replace_products, replace_table


def load_retail(spark: SparkSession, lines: DataFrame, folder: str) -> DataFrame:
    """Store raw and cleaned lines and the catalog under ``folder``; returns (metric, value) counts.

    Text is parsed once; cleaning and the catalog read the columnar copy.
    """
    replace_table(lines, f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    replace_table(clean(raw), f"{folder}/cleaned")
    cleaned = spark.read.parquet(f"{folder}/cleaned")
    replace_products(
        product_table(product_catalog(cleaned)), f"{folder}/products", f"{folder}/recommendations"
    )
    return load_report(raw, cleaned)
