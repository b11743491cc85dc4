"""The seven named views as DataFrame functions.

Each is a plain composition, so filters and column choices made on top of a view reach the file
scans. No join is hinted: the optimizer broadcasts a side only when its measured size allows it,
and splits skewed keys of the loans side otherwise.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import capacity
from lectern.functions.dates import days_between
from lectern.functions.text import joined
from lectern.operators import paging
from lectern.schemas import OPEN_LOAN_STATUSES
from lectern.sources.collection import Collection


def is_open(status: str | Column = "loan_status") -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return status.isin(*OPEN_LOAN_STATUSES)


def is_past_due(as_of: date) -> Column:
    """Open and late: marked overdue, or still active with the due date behind us."""
    status = F.col("loan_status")
    return (status == "overdue") | (
        (status == "active") & (F.col("estimated_return_date") < F.lit(as_of))
    )


def shelf_utilization(tables: Collection) -> DataFrame:
    return tables.shelves.select(
        "shelf_id",
        "location_code",
        "section",
        "main_topic",
        "material",
        "total_capacity",
        "current_book_count",
        capacity.utilization_percentage().alias("utilization_percentage"),
        capacity.available_space().alias("available_space"),
        capacity.band().alias("status"),
        "created_at",
        "updated_at",
    )


def book_inventory(tables: Collection) -> DataFrame:
    places = tables.shelves.select(
        "shelf_id",
        "location_code",
        "section",
        F.col("main_topic").alias("shelf_topic"),
        F.col("material").alias("shelf_material"),
    )
    status = F.col("status")
    return tables.books.join(places, "shelf_id", "left").select(
        "book_id",
        "isbn",
        "title",
        "author",
        "publisher",
        "publication_year",
        "edition",
        "language",
        "pages",
        "book_type",
        "status",
        "acquisition_date",
        "shelf_id",
        "location_code",
        "section",
        "shelf_topic",
        "shelf_material",
        F.when(F.col("book_type") == "digital", "Digital Collection")
        .when(F.col("shelf_id").isNull(), "Unassigned")
        .otherwise(joined("section", F.lit(" - "), "location_code"))
        .alias("location"),
        F.when(status == "available", "Available")
        .when(status == "loaned", "On Loan")
        .when(status == "maintenance", "Under Maintenance")
        .when(status == "lost", "Lost")
        .alias("availability_status"),
        "created_at",
        "updated_at",
    )


def available_books(tables: Collection) -> DataFrame:
    return book_inventory(tables).where(F.col("status") == "available")


def physical_books(books: DataFrame) -> DataFrame:
    return books.where((F.col("book_type") == "physical") & F.col("shelf_id").isNotNull())


def shelf_sizes(books: DataFrame) -> DataFrame:
    """``shelf_id, rows``: physical books found per shelf. Combines map-side, so any skew is fine."""
    return physical_books(books).groupBy("shelf_id").agg(F.count("*").alias("rows"))


def books_by_shelf(tables: Collection, page_size: int = paging.PAGE_SIZE) -> DataFrame:
    """Shelves with their physical books as an array, null for an empty shelf.

    A row per shelf and ``page_size`` of its books, in order of their keys; nothing runs until it is read.
    """
    sizes = shelf_sizes(tables.books)
    gathered = paging.gather(
        physical_books(tables.books),
        "shelf_id",
        "book_id",
        F.struct("book_id", "title", "author", "status"),
        "books",
        page_size,
    )
    return (
        tables.shelves.join(sizes, "shelf_id", "left")
        .join(gathered, "shelf_id", "left")
        .select(
            "shelf_id",
            "location_code",
            "section",
            "main_topic",
            "total_capacity",
            "current_book_count",
            F.coalesce("rows", F.lit(0)).alias("actual_book_count"),
            F.coalesce("page", F.lit(0)).alias("page"),
            "books",
        )
    )


def active_loans(tables: Collection, as_of: date) -> DataFrame:
    due = F.col("estimated_return_date")
    titles = tables.books.select(
        "book_id",
        F.col("title").alias("book_title"),
        F.col("author").alias("book_author"),
        "isbn",
        "book_type",
    )
    people = tables.students.select(
        "student_id", "student_number", "first_name", "last_name", "email", "program"
    )
    return (
        tables.loans.where(is_open())
        .join(titles, "book_id")
        .join(people, "student_id")
        .select(
            "loan_id",
            "loan_date",
            "estimated_return_date",
            "actual_return_date",
            "loan_status",
            "renewal_count",
            "notes",
            "book_id",
            "book_title",
            "book_author",
            "isbn",
            "book_type",
            "student_id",
            "student_number",
            "first_name",
            "last_name",
            "email",
            "program",
            F.when(is_past_due(as_of), days_between(as_of, due)).otherwise(0).alias("days_overdue"),
            days_between(due, as_of).alias("days_until_due"),
            "created_at",
            "updated_at",
        )
    )


def overdue_loans(tables: Collection, as_of: date) -> DataFrame:
    return active_loans(tables, as_of).where(is_past_due(as_of))


def loan_duration(as_of: date) -> Column:
    return days_between(F.coalesce("actual_return_date", F.lit(as_of)), "loan_date")


def loan_history(tables: Collection, as_of: date) -> DataFrame:
    titles = tables.books.select(
        "book_id", F.col("title").alias("book_title"), F.col("author").alias("book_author"), "isbn"
    )
    people = tables.students.select(
        "student_id", "student_number", "first_name", "last_name", "email"
    )
    late = days_between("actual_return_date", "estimated_return_date")
    return (
        tables.loans.join(titles, "book_id")
        .join(people, "student_id")
        .select(
            "loan_id",
            "loan_date",
            "estimated_return_date",
            "actual_return_date",
            "loan_status",
            "renewal_count",
            loan_duration(as_of).alias("loan_duration"),
            F.greatest(F.coalesce(late, F.lit(0)), F.lit(0)).alias("days_late"),
            "book_id",
            "book_title",
            "book_author",
            "isbn",
            "student_id",
            "student_number",
            "first_name",
            "last_name",
            "email",
            "created_at",
            "updated_at",
        )
    )


def all_views(tables: Collection, as_of: date) -> dict[str, DataFrame]:
    return {
        "shelf_utilization": shelf_utilization(tables),
        "book_inventory": book_inventory(tables),
        "available_books": available_books(tables),
        "books_by_shelf": books_by_shelf(tables),
        "active_loans": active_loans(tables, as_of),
        "overdue_loans": overdue_loans(tables, as_of),
        "loan_history": loan_history(tables, as_of),
    }


def publish(spark: SparkSession, tables: Collection, as_of: date) -> list[str]:
    """Register tables and views under their names for use from SQL; returns the names."""
    named = {**tables.as_dict(), **all_views(tables, as_of)}
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    return list(named)
