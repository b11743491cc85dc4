"""Rows as JSON text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_json(columns: Iterable[str], prefix: str = "") -> Column:
    """One JSON object per row, null fields kept. ``prefix`` names a struct holding the columns."""
    return F.to_json(
        F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in columns]),
        {"ignoreNullFields": "false"},
    )


def value_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})
