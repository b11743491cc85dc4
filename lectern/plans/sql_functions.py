"""The collection's functions under their SQL names, for use next to the published views.

They are SQL functions: the optimizer puts their bodies in place of the calls, so they cost nothing
over writing the expression out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lectern.functions import formats
from lectern.schemas import DIGITAL_LOAN_DAYS, LOAN_DAYS


def _pattern(text: str) -> str:
    return "r'" + text.replace("'", "\\'") + "'"


FUNCTIONS = {
    "calculate_estimated_return_date": f"""
        (loan_date DATE, book_type STRING DEFAULT 'physical') RETURNS DATE
        RETURN date_add(loan_date, IF(book_type = 'digital', {DIGITAL_LOAN_DAYS}, {LOAN_DAYS}))
    """,
    "is_valid_email": f"""
        (email STRING) RETURNS BOOLEAN RETURN email RLIKE {_pattern("(?i)" + formats.EMAIL)}
    """,
    "is_valid_isbn": f"""
        (isbn STRING) RETURNS BOOLEAN RETURN isbn RLIKE {_pattern(formats.ISBN_PRINTED)}
    """,
    "check_shelf_capacity": """
        (wanted BIGINT) RETURNS BOOLEAN
        RETURN coalesce(
          (SELECT max(current_book_count < total_capacity) FROM shelves WHERE shelf_id = wanted),
          raise_error('Shelf not found'))
    """,
    "validate_shelf_capacity_consistency": """
        ()
        RETURNS TABLE (shelf_id BIGINT, location_code STRING, expected_count BIGINT,
                       actual_count INT, status STRING)
        RETURN SELECT s.shelf_id, s.location_code, coalesce(b.n, 0), s.current_book_count,
                      IF(coalesce(b.n, 0) = s.current_book_count, 'OK', 'MISMATCH')
               FROM shelves s LEFT JOIN (
                 SELECT shelf_id, count(*) AS n FROM books
                 WHERE book_type = 'physical' GROUP BY shelf_id) b ON s.shelf_id = b.shelf_id
    """,
}


def publish_functions(spark: SparkSession) -> list[str]:
    """Register the functions; the published ``shelves`` and ``books`` must exist."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
    return list(FUNCTIONS)
