"""Stored tables, all Parquet, written by the executors."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.mining.job import Mined
from tillspark.schemas import RUN


STORED_RECOMMENDATION = (
    "product string, rec_product string, confidence double, support double, lift double, "
    "algorithm string"
)


def replace_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Full refresh of a table. The row count comes from the write itself, not from a second scan."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return seen.get["rows"]


def replace_lines_by_month(lines: DataFrame, path: str, pattern: str = "M/d/yyyy H:mm") -> int:
    """Lines stored by invoice month, so that date-bound reads skip the other months.

    Dates that do not follow the pattern go to the NULL month. Adaptive execution rebalances the rows by month before
    the write: a large month is split and small ones share a task, by ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, so
    the files have about one size whatever the number of tasks and the skew of months. Months that meet in one place of the
    shuffle are split together: with few shuffle partitions a small month beside a large one has a few small files.
    """
    month = F.date_format(F.try_to_timestamp("InvoiceDate", F.lit(pattern)), "yyyy-MM")
    dated = lines.withColumn("invoice_month", month)
    return replace_table(dated.hint("rebalance", F.col("invoice_month")), path, ("invoice_month",))


def save_run(
    mined: Mined, folder: str, run_id: str, created_by: str = "system",
    created_at: datetime | None = None,
) -> None:
    """Append a run to the log and write its itemsets and rules under its own partition.

    The log row is written last, so a run in the log is always complete.
    """
    s = mined.settings
    keys = {"algorithm": F.lit(s.algorithm), "run_id": F.lit(run_id)}
    for name, df in (("itemsets", mined.itemsets), ("rules", mined.rules)):
        (
            df.withColumns(keys).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("algorithm", "run_id").parquet(f"{folder}/{name}")
        )
    at = created_at or datetime.now(timezone.utc)
    row = (run_id, s.algorithm, float(s.min_support), float(s.min_confidence), mined.n_baskets, at, created_by)
    mined.itemsets.sparkSession.createDataFrame([row], RUN).write.mode("append").parquet(f"{folder}/runs")


def load_run(spark: SparkSession, folder: str, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log row, itemsets, rules) of one run; only its partitions are read."""
    parts = [spark.read.parquet(f"{folder}/{n}").filter(F.col("run_id") == run_id)
             for n in ("runs", "itemsets", "rules")]
    return parts[0], parts[1].drop("algorithm", "run_id"), parts[2].drop("algorithm", "run_id")


def recent_runs(runs: DataFrame, n: int | None = None) -> DataFrame:
    """Latest runs first, with the columns of the run list; all, or the first ``n``."""
    listed = runs.select(
        F.col("run_id").alias("id"), "algorithm",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "created_by",
    ).orderBy(F.desc("created_at"), "id")
    return listed if n is None else listed.limit(n)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each algorithm."""
    newest = W.partitionBy("algorithm").orderBy(F.desc("created_at"), "run_id")
    return runs.withColumn("at", F.row_number().over(newest)).filter("at = 1").drop("at")


def read_recommendations(spark: SparkSession, path: str) -> DataFrame:
    """Stored recommendations; works on an emptied table too."""
    return spark.read.schema(STORED_RECOMMENDATION).parquet(path)


def replace_recommendations(stored: DataFrame, path: str) -> None:
    """Replace the recommendations of the algorithms in ``stored`` and keep those of the others."""
    (
        stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("algorithm").parquet(path)
    )


def replace_products(products: DataFrame, products_path: str, recommendations_path: str) -> None:
    """Replace the catalog. Recommendations point to the old catalog, so they are emptied."""
    replace_table(products, products_path)
    products.sparkSession.createDataFrame([], STORED_RECOMMENDATION).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("algorithm").parquet(recommendations_path)


def append_orders(headers: DataFrame, lines: DataFrame, folder: str) -> None:
    headers.write.mode("append").parquet(f"{folder}/orders")
    lines.write.mode("append").parquet(f"{folder}/order_lines")


def dashboard(products: DataFrame, stored: DataFrame) -> DataFrame:
    """Number of products and of stored recommendations."""
    return products.agg(F.count("*").alias("products")).withColumn(
        "recommendations", stored.agg(F.count("*")).scalar()
    )
