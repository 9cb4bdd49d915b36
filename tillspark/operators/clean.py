"""Named cleaning rules. A line on which a rule is unknown (NULL) is kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions.text import is_true

RULE_NAMES = ("invoice", "customer", "quantity", "price", "description", "postage")


def _drop_conditions() -> dict[str, Column]:
    """For each rule, which lines it drops."""
    return {
        "invoice": F.upper("InvoiceNo").contains("C"),
        "customer": F.col("CustomerID").isNull(),
        "quantity": F.col("Quantity").contains("-"),
        "price": F.col("UnitPrice") <= 0,
        "description": F.col("Description").isNull() | F.col("Description").contains("?"),
        "postage": F.col("StockCode") == "POST",
    }


def hit(rule: str) -> Column:
    """True on the lines ``rule`` drops, false on all others."""
    return is_true(_drop_conditions()[rule])


def drop_by(lines: DataFrame, rule: str) -> DataFrame:
    return lines.filter(~hit(rule))


def clean(lines: DataFrame, rules: tuple[str, ...] = RULE_NAMES) -> DataFrame:
    """All rules as one filter. The order of rules does not matter."""
    return lines.filter(~reduce(lambda a, b: a | b, [hit(r) for r in rules], F.lit(False)))


def clean_report(lines: DataFrame, rules: tuple[str, ...] = RULE_NAMES) -> DataFrame:
    """Lines read, lines each rule hits on its own, and lines kept, from one scan."""
    dropped = reduce(lambda a, b: a | b, [hit(r) for r in rules], F.lit(False))
    return lines.agg(
        F.count("*").alias("raw_rows"),
        *[F.count_if(hit(r)).alias(f"hit_{r}") for r in rules],
        F.count_if(~dropped).alias("kept_rows"),
    )


def positive_price(lines: DataFrame) -> DataFrame:
    """Lines with a known price above zero."""
    return lines.filter(F.col("UnitPrice") > 0)
