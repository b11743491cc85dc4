"""Text predicates and name building."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(column: str | Column, term: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the term stay wildcards."""
    column = F.col(column) if isinstance(column, str) else column
    return column.ilike(f"%{term}%")


def any_contains(columns: Iterable[str | Column], terms: str | Iterable[str]) -> Column:
    """True where one of the columns contains one of the terms."""
    terms = [terms] if isinstance(terms, str) else list(terms)
    return reduce(or_, [contains(c, t) for c in columns for t in terms])


def joined(*parts: str | Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *parts)


def display_name(first: str = "first_name", last: str = "last_name") -> Column:
    """First and last name with a space; null when either is null."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def blank(column: str | Column) -> Column:
    """True for text of spaces only. Other white space counts as text."""
    return F.length(F.trim(column)) == 0


def blank_or_white(column: str | Column) -> Column:
    """True for text of any white space only."""
    column = F.col(column) if isinstance(column, str) else column
    return column.rlike(r"^\s*\z")


def lenient_int(text: Column) -> Column:
    return text.try_cast("int")
