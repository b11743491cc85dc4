"""Shelf capacity expressions over ``current_book_count`` and ``total_capacity``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COUNT, _CAPACITY = "current_book_count", "total_capacity"


def utilization() -> Column:
    """Unrounded percentage, exact decimal arithmetic."""
    count = F.col(_COUNT).cast("decimal(10,0)")
    capacity = F.col(_CAPACITY).cast("decimal(10,0)")
    return count / capacity * 100


def utilization_percentage() -> Column:
    return F.round(utilization(), 2)


def available_space() -> Column:
    return F.col(_CAPACITY) - F.col(_COUNT)


def has_capacity() -> Column:
    return F.col(_COUNT) < F.col(_CAPACITY)


def band() -> Column:
    """Fill band. Thresholds of 80 and 50 percent, compared as whole numbers."""
    count, capacity = F.col(_COUNT).cast("long"), F.col(_CAPACITY).cast("long")
    return (
        F.when(count == 0, "Empty")
        .when(count == capacity, "Full")
        .when(5 * count > 4 * capacity, "Nearly Full")
        .when(2 * count > capacity, "Half Full")
        .otherwise("Available")
    )
