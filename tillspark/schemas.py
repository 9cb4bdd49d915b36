"""Table shapes shared by the library, and the checked mining settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RETAIL_COLUMNS = (
    "InvoiceNo",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "UnitPrice",
    "CustomerID",
    "Country",
)
PRICE_TYPE = T.DecimalType(28, 4)

RETAIL_LINE = T.StructType(
    [T.StructField(c, PRICE_TYPE if c == "UnitPrice" else T.StringType()) for c in RETAIL_COLUMNS]
)
BASKET = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
ITEMSET = T.StructType(
    [
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("freq", T.LongType()),
        T.StructField("support", T.DoubleType()),
    ]
)
RULE = T.StructType(
    [
        T.StructField("antecedents", T.ArrayType(T.StringType())),
        T.StructField("consequents", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("support", T.DoubleType()),
        T.StructField("lift", T.DoubleType()),
        T.StructField("freq", T.LongType()),
        T.StructField("freq_a", T.LongType()),
        T.StructField("freq_c", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)
RECOMMENDATION = T.StructType(
    [
        T.StructField("product", T.StringType()),
        T.StructField("rec_product", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("support", T.DoubleType()),
        T.StructField("lift", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("rank", T.IntegerType()),
    ]
)
RUN = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("min_support", T.DoubleType()),
        T.StructField("min_confidence", T.DoubleType()),
        T.StructField("transaction_count", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("created_by", T.StringType()),
    ]
)

# The settings offered by default.
ALGORITHMS = ("fpgrowth", "apriori", "son")
DEFAULT_MIN_SUPPORT = 0.01
DEFAULT_MIN_CONFIDENCE = 0.5
SUPPORT_CHOICES = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1)
CONFIDENCE_CHOICES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


@dataclass(frozen=True)
class MiningSettings:
    """Thresholds of one mining run, checked when they are made."""

    min_support: float = DEFAULT_MIN_SUPPORT
    min_confidence: float = DEFAULT_MIN_CONFIDENCE
    algorithm: str = "fpgrowth"
    max_consequent: int | None = None
    min_lift: float | None = None

    def __post_init__(self):
        if not 0 < self.min_support <= 1:
            raise ValueError(f"min_support must be in (0, 1], got {self.min_support}")
        if not 0 <= self.min_confidence <= 1:
            raise ValueError(f"min_confidence must be in [0, 1], got {self.min_confidence}")
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm must be one of {ALGORITHMS}, got {self.algorithm!r}")
        if self.max_consequent is not None and self.max_consequent < 1:
            raise ValueError("max_consequent must be at least 1")
