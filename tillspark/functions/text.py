"""Text predicates and conversions over columns, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters removed at both ends of every text column.
WHITESPACE = " \t\r\n\x0b\x0c"


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WHITESPACE))


def is_true(predicate: Column) -> Column:
    """The predicate with unknown counted as false, so that its negation keeps NULL rows."""
    return F.coalesce(predicate, F.lit(False))


def non_blank(col: Column) -> Column:
    return col.isNotNull() & (F.trim(col) != "")


def to_price(col: Column, decimal_type: str = "decimal(28,4)") -> Column:
    """Numeric text to a price, NULL where it is not a number."""
    return strip(col).try_cast(decimal_type)


def short_description(col: Column, limit: int = 100) -> Column:
    """At most ``limit`` characters for a product card, always followed by an ellipsis."""
    return F.concat(F.substring(col, 1, limit), F.lit("..."))


def holds_text(col: Column, text: str) -> Column:
    """Case-insensitive search in an array of items or in a text column joined by spaces."""
    return F.contains(F.lower(F.concat_ws(" ", col)), F.lit(text.lower()))
