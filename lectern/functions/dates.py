"""Calendar expressions. "Today" is always a parameter, never the clock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.schemas import DIGITAL_LOAN_DAYS, LOAN_DAYS


def as_date(value: Column | str | date) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, date):
        return F.lit(value)
    return F.col(value)


def days_between(later: Column | str | date, earlier: Column | str | date) -> Column:
    """Whole days from ``earlier`` to ``later``, negative when they are the other way round."""
    return F.datediff(as_date(later), as_date(earlier))


def due_date(loan_date: Column, book_type: Column) -> Column:
    return F.date_add(
        loan_date, F.when(book_type == "digital", DIGITAL_LOAN_DAYS).otherwise(LOAN_DAYS)
    )


def month_start(day: Column | str) -> Column:
    return F.date_trunc("month", as_date(day)).cast("date").cast("timestamp_ntz")


def month_label(day: Column | str) -> Column:
    return F.date_format(as_date(day), "yyyy-MM")


def lenient_date(text: Column) -> Column:
    """``YYYY-M-D`` text as a date, null where it is not one."""
    shaped = F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), text)
    return F.try_to_date(shaped, "yyyy-M-d")
