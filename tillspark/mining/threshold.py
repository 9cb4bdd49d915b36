"""One exact support threshold for all miners."""

from __future__ import annotations

from decimal import Decimal


def support_ratio(min_support: float) -> tuple[int, int]:
    """The threshold as written, as an exact fraction: 0.07 is 7/100, not its binary neighbour."""
    return Decimal(str(min_support)).as_integer_ratio()


def min_count(min_support: float, n: int) -> int:
    """Least count c with c / n >= min_support, and at least 1."""
    num, den = support_ratio(min_support)
    return max(1, -(-num * n // den))
