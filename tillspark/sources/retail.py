"""Retail lines from CSV text, JDBC tables and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.functions.text import strip, to_price
from tillspark.schemas import RETAIL_COLUMNS


def read_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, sep: str = ",",
    null_tokens: tuple[str, ...] = ("",),
) -> DataFrame:
    """Retail lines from CSV files with a header.

    Every column is read as text, so no digits are lost to type guessing. Files are split over
    tasks. ``multi_line`` lets quoted values hold line breaks, at the price of one task per file.
    """
    raw = spark.read.csv(
        path, sep=sep, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"',
        encoding="UTF-8", enforceSchema=False,
    )
    return coerce(align(raw), null_tokens)


def align(raw: DataFrame) -> DataFrame:
    """Project any header onto the eight retail columns.

    Names match after trimming and ignoring case, the first match wins, absent columns are NULL
    and other columns are dropped.
    """
    found: dict[str, str] = {}
    for actual in raw.columns:
        found.setdefault(actual.strip().lower(), actual)
    return raw.select(
        [
            F.col(f"`{found[c.lower()]}`").cast("string").alias(c)
            if c.lower() in found else F.lit(None).cast("string").alias(c)
            for c in RETAIL_COLUMNS
        ]
    )


def coerce(aligned: DataFrame, null_tokens: tuple[str, ...] = ("",)) -> DataFrame:
    """Trim text columns and turn the price into a decimal, NULL where it is not a number."""
    def known(c: str):
        return F.when(~F.col(c).isin(list(null_tokens)), F.col(c))

    return aligned.select(
        [
            (to_price(known(c)) if c == "UnitPrice" else strip(known(c))).alias(c)
            for c in RETAIL_COLUMNS
        ]
    )


def read_table(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Retail lines stored earlier in a columnar format."""
    return coerce(align(spark.read.format(file_format).load(path)))


def jdbc_options(
    table: str, column: str | None, lower: str | int | None, upper: str | int | None,
    num_partitions: int, fetch_size: int,
) -> dict:
    """Scan options: split by ranges of ``column`` when its bounds are given."""
    options = {"dbtable": table, "fetchsize": str(fetch_size)}
    if column is None:
        return options
    if lower is None or upper is None:
        raise ValueError("a split column needs its lower and upper bound")
    return options | {
        "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
        "numPartitions": str(num_partitions),
    }


def read_jdbc(
    spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None,
    column: str | None = None, lower: str | int | None = None, upper: str | int | None = None,
    num_partitions: int = 64, fetch_size: int = 10_000,
) -> DataFrame:
    """Retail lines from a database table.

    Without a numeric or date split ``column`` the scan is one task, so give one for large tables.
    """
    options = jdbc_options(table, column, lower, upper, num_partitions, fetch_size)
    return coerce(align(spark.read.format("jdbc").options(url=url, **options, **(properties or {})).load()))
