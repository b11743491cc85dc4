"""Formats of identifiers and contact data.

Fixed values: the patterns below decide which rows are valid. Each ends in ``\\z`` since the
``$`` of Java patterns also accepts a trailing newline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STUDENT_NUMBER = r"^[0-9]{4,20}\z"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"
PHONE = r"^[\+]?[0-9\-\s\(\)]{7,20}\z"
LOCATION_CODE = r"^[A-Z][0-9]{1,2}\z"
ISBN = r"^(97[89])?[0-9]{9}[0-9X]\z"
ISBN_10 = r"^[0-9]{9}[0-9X]\z"
ISBN_13 = r"^97[89][0-9]{9}[0-9X]\z"
ISBN_PRINTED = r"^(?:ISBN(?:-1[03])?:? )?(?=[0-9X]{10}\z|(?=(?:[0-9]+[- ]){3})[- 0-9X]{13}\z|97[89][0-9]{10}\z|(?=(?:[0-9]+[- ]){4})[- 0-9]{17}\z)(?:97[89][- ]?)?[0-9]{1,5}[- ]?[0-9]+[- ]?[0-9]+[- ]?[0-9X]\z"
EMAIL_LIKE = "%@%.%"


def is_valid_email(email: Column) -> Column:
    return email.rlike("(?i)" + EMAIL)


def is_printed_isbn(isbn: Column) -> Column:
    """ISBN as printed: optional label, hyphens or spaces between the groups."""
    return isbn.rlike(ISBN_PRINTED)


def bare_isbn(isbn: Column) -> Column:
    return F.regexp_replace(isbn, r"[-\s]", "")


def is_intake_isbn(isbn: Column) -> Column:
    """ISBN of 10 or 13 places once hyphens and spaces are dropped."""
    bare = bare_isbn(isbn)
    return bare.rlike(ISBN_10) | bare.rlike(ISBN_13)
