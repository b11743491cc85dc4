"""Filtered, searched and ordered listings of tables and views.

Ordering is part of a listing, and costs a range shuffle of the result; pass ``ordered=False`` where
the rows go on into another step. Nulls sort last when ascending and first when descending. Every
order ends in a key, so that a value shared by very many rows can still be cut into several ranges.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import capacity, text
from lectern.functions.dates import days_between
from lectern.functions.formats import EMAIL_LIKE
from lectern.operators.lookup import books_with_shelf, by_key, loans_with_parties
from lectern.plans import views
from lectern.sources.collection import Collection

SEARCH_FIELDS = ("title", "author", "publisher", "isbn")


def up(column: str) -> Column:
    return F.col(column).asc_nulls_last()


def down(column: str) -> Column:
    return F.col(column).desc_nulls_first()


def _listed(df: DataFrame, ordered: bool, *order: Column) -> DataFrame:
    return df.orderBy(*order) if ordered else df


def _where(df: DataFrame, column: str, wanted) -> DataFrame:
    """Rows with the wanted value, or with one of the keys in a wanted DataFrame; all for none."""
    if isinstance(wanted, DataFrame):
        return by_key(df, wanted, column)
    return df.where(F.col(column) == wanted) if wanted else df


# Students


def students(tables: Collection, status: str | None = None, ordered: bool = True) -> DataFrame:
    found = _where(tables.students, "status", status)
    return _listed(found, ordered, up("last_name"), up("first_name"), up("student_id"))


def students_by_name(tables: Collection, name: str, ordered: bool = True) -> DataFrame:
    full = text.joined("first_name", F.lit(" "), "last_name")
    found = tables.students.where(text.any_contains(["first_name", "last_name", full], name))
    return _listed(found, ordered, up("last_name"), up("first_name"), up("student_id"))


def students_by_program(tables: Collection, program: str) -> DataFrame:
    return tables.students.where(text.contains("program", program)).select(
        "student_number", "first_name", "last_name", "program"
    )


def malformed_emails(tables: Collection) -> DataFrame:
    return tables.students.where(~F.col("email").like(EMAIL_LIKE))


# Shelves


def shelves(tables: Collection, section: str | None = None, ordered: bool = True) -> DataFrame:
    found = _where(tables.shelves, "section", section)
    return _listed(found, ordered, up("location_code"), up("shelf_id"))


def shelves_by_topic(tables: Collection, topic: str, ordered: bool = True) -> DataFrame:
    found = views.shelf_utilization(tables).where(text.contains("main_topic", topic))
    return _listed(found, ordered, up("location_code"), up("shelf_id"))


def shelves_with_space(tables: Collection, at_least: int = 1, ordered: bool = True) -> DataFrame:
    found = views.shelf_utilization(tables).where(F.col("available_space") >= at_least)
    return _listed(found, ordered, down("available_space"), up("location_code"), up("shelf_id"))


def shelf_utilization(
    tables: Collection, shelf_id: int | DataFrame | None = None, ordered: bool = True
) -> DataFrame:
    found = _where(views.shelf_utilization(tables), "shelf_id", shelf_id)
    return _listed(found, ordered, up("location_code"), up("shelf_id"))


def most_utilized_shelves(tables: Collection, ordered: bool = True) -> DataFrame:
    found = tables.shelves.where(F.col("total_capacity") > 0).select(
        "location_code",
        "section",
        "main_topic",
        capacity.utilization_percentage().alias("utilization_percent"),
    )
    return _listed(found, ordered, down("utilization_percent"), up("location_code"))


def empty_shelves(tables: Collection) -> DataFrame:
    return tables.shelves.where(F.col("current_book_count") == 0)


def full_shelves(tables: Collection) -> DataFrame:
    return tables.shelves.where(F.col("current_book_count") == F.col("total_capacity"))


# Books


def books_with_location(tables: Collection, ordered: bool = True) -> DataFrame:
    found = books_with_shelf(tables).select(
        "book_id",
        "title",
        "author",
        "isbn",
        "status",
        "publication_year",
        "location_code",
        "section",
        "main_topic",
    )
    return _listed(found, ordered, up("title"), up("book_id"))


def books_by_status(tables: Collection, status: str, ordered: bool = True) -> DataFrame:
    found = books_with_shelf(tables).where(F.col("status") == status)
    return _listed(found, ordered, up("title"), up("author"), up("book_id"))


def books_on_shelf(
    tables: Collection,
    shelf_id: int | DataFrame,
    physical_only: bool = False,
    ordered: bool = True,
) -> DataFrame:
    found = _where(tables.books, "shelf_id", shelf_id)
    if physical_only:
        found = found.where(F.col("book_type") == "physical")
    return _listed(found, ordered, up("title"), up("author"), up("book_id"))


def available_books(tables: Collection, ordered: bool = True) -> DataFrame:
    return _listed(views.available_books(tables), ordered, up("title"), up("author"), up("book_id"))


def search_books(
    tables: Collection,
    terms: str | list[str],
    fields: tuple[str, ...] = SEARCH_FIELDS,
    ordered: bool = True,
) -> DataFrame:
    """Inventory rows where one of the fields contains one of the terms."""
    found = views.book_inventory(tables).where(text.any_contains(fields, terms))
    return _listed(found, ordered, up("title"), up("author"), up("book_id"))


def inventory(
    tables: Collection,
    status: str | None = None,
    book_type: str | None = None,
    shelf_id: int | DataFrame | None = None,
    author: str | None = None,
    title: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Inventory under any of the given filters; an empty filter is ignored."""
    found = views.book_inventory(tables)
    for column, wanted in (("status", status), ("book_type", book_type), ("shelf_id", shelf_id)):
        found = _where(found, column, wanted)
    for column, term in (("author", author), ("title", title)):
        if term:
            found = found.where(text.contains(column, term))
    return _listed(found, ordered, up("title"), up("author"), up("book_id"))


def books_by_shelf(
    tables: Collection, shelf_id: int | DataFrame | None = None, ordered: bool = True
) -> DataFrame:
    found = _where(views.books_by_shelf(tables), "shelf_id", shelf_id)
    return _listed(found, ordered, up("location_code"), up("page"), up("shelf_id"))


def never_loaned(tables: Collection, ordered: bool = True) -> DataFrame:
    """Books without a loan. Loans shrink to their distinct books before they are shuffled."""
    loaned = tables.loans.select("book_id").distinct()
    found = tables.books.join(loaned, "book_id", "left_anti").select(
        "book_id", "title", "author", "status", "publication_year"
    )
    return _listed(found, ordered, up("title"), up("book_id"))


# Loans


def active_loans(
    tables: Collection,
    as_of: date,
    student_id: int | DataFrame | None = None,
    ordered: bool = True,
) -> DataFrame:
    found = _where(views.active_loans(tables, as_of), "student_id", student_id)
    return _listed(found, ordered, up("estimated_return_date"), up("loan_id"))


def overdue_loans(
    tables: Collection, as_of: date, worst_first: bool = True, ordered: bool = True
) -> DataFrame:
    order = down("days_overdue") if worst_first else up("estimated_return_date")
    return _listed(views.overdue_loans(tables, as_of), ordered, order, up("loan_id"))


def loan_history(
    tables: Collection,
    as_of: date,
    student_id: int | DataFrame | None = None,
    book_id: int | DataFrame | None = None,
    ordered: bool = True,
) -> DataFrame:
    found = _where(views.loan_history(tables, as_of), "student_id", student_id)
    found = _where(found, "book_id", book_id)
    return _listed(found, ordered, down("loan_date"), up("loan_id"))


def student_loans(
    tables: Collection, keys: DataFrame, open_only: bool = False, ordered: bool = True
) -> DataFrame:
    """Loans of the asked students with the book's title, author and ISBN."""
    loans = tables.loans.where(views.is_open()) if open_only else tables.loans
    titles = tables.books.select("book_id", "title", "author", "isbn")
    found = (
        by_key(loans, keys, "student_id")
        .join(titles, "book_id")
        .select(*tables.loans.columns, "title", "author", "isbn")
    )
    order = up("estimated_return_date") if open_only else down("loan_date")
    return _listed(found, ordered, order, up("loan_id"))


def book_loans(tables: Collection, keys: DataFrame, ordered: bool = True) -> DataFrame:
    """Loans of the asked books with the student's number, names and email."""
    people = tables.students.select(
        "student_id", "student_number", "first_name", "last_name", "email"
    )
    found = (
        by_key(tables.loans, keys, "book_id")
        .join(people, "student_id")
        .select(*tables.loans.columns, "student_number", "first_name", "last_name", "email")
    )
    return _listed(found, ordered, down("loan_date"), up("loan_id"))


def loans_with_details(tables: Collection, as_of: date, ordered: bool = True) -> DataFrame:
    found = loans_with_parties(tables).select(
        "loan_id",
        "student_number",
        text.display_name().alias("student_name"),
        F.col("title").alias("book_title"),
        "author",
        "loan_date",
        "estimated_return_date",
        "actual_return_date",
        "loan_status",
        "renewal_count",
        views.loan_duration(as_of).alias("days_on_loan"),
    )
    return _listed(found, ordered, down("loan_date"), up("loan_id"))


def active_loan_flags(tables: Collection, as_of: date, ordered: bool = True) -> DataFrame:
    """Loans of status active, flagged late or on time; days are negative before the due date."""
    due = F.col("estimated_return_date")
    active = tables.loans.where(F.col("loan_status") == "active")
    found = loans_with_parties(tables, active).select(
        "loan_id",
        "student_number",
        text.display_name().alias("student_name"),
        "title",
        "author",
        "loan_date",
        "estimated_return_date",
        days_between(as_of, due).alias("days_overdue"),
        F.when(due < F.lit(as_of), "OVERDUE").otherwise("ON TIME").alias("status"),
    )
    return _listed(found, ordered, up("estimated_return_date"), up("loan_id"))
