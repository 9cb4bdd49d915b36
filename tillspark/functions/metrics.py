"""Display forms of mining metrics. Rounding happens only here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(ratio: Column, digits: int) -> Column:
    return F.round(ratio * 100, digits)


def lift_band(lift: Column) -> Column:
    # Band limits.
    return F.when(lift > 3, "strong").when(lift > 1.5, "moderate").otherwise("weak")


def confidence_band(confidence: Column) -> Column:
    # Band limits, in percent.
    pct = confidence * 100
    return F.when(pct >= 80, "high").when(pct >= 50, "medium").otherwise("low")


def round_metrics(df):
    """Itemsets or rules with support and confidence to 6 places and lift to 4."""
    places = {"support": 6, "confidence": 6, "lift": 4}
    return df.withColumns({c: F.round(c, p) for c, p in places.items() if c in df.columns})


def weight(lift: Column, support: Column) -> Column:
    """Score of one recommendation: its lift, or its support where there is no lift."""
    return F.coalesce(F.nullif(lift, F.lit(0.0)), support, F.lit(0.0))
