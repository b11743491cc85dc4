"""Lookups by key, for a whole batch of keys at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import capacity
from lectern.session import apart
from lectern.sources.collection import Collection


def by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in ``keys``; each at most once however often asked for.

    Also used to cut a large table down to what a batch of requests is about, before joining the two:
    a small batch is broadcast and the table is then only scanned. Equal keys collapse map-side.
    """
    return df.join(apart(keys.select(key).distinct()), key, "left_semi")


def books_with_shelf(tables: Collection, books: DataFrame | None = None) -> DataFrame:
    """Books with their shelf's code, section and topic, null where there is none."""
    books = tables.books if books is None else books
    places = tables.shelves.select("shelf_id", "location_code", "section", "main_topic")
    return books.join(places, "shelf_id", "left").select(
        *books.columns, "location_code", "section", "main_topic"
    )


def loans_with_parties(
    tables: Collection, loans: DataFrame | None = None, email: bool = False
) -> DataFrame:
    """Loans with title, author and ISBN of the book and number and names of the student."""
    loans = tables.loans if loans is None else loans
    titles = tables.books.select("book_id", "title", "author", "isbn")
    shown = ["student_number", "first_name", "last_name", *(["email"] if email else [])]
    return (
        loans.join(titles, "book_id")
        .join(tables.students.select("student_id", *shown), "student_id")
        .select(*loans.columns, "title", "author", "isbn", *shown)
    )


def book_by_id(tables: Collection, keys: DataFrame) -> DataFrame:
    return books_with_shelf(tables, by_key(tables.books, keys, "book_id"))


def loan_by_id(tables: Collection, keys: DataFrame) -> DataFrame:
    return loans_with_parties(tables, by_key(tables.loans, keys, "loan_id"), email=True)


def shelf_room(tables: Collection, requests: DataFrame) -> DataFrame:
    """Requests with ``has_capacity`` of their shelf; ``reason`` is set where the shelf is unknown."""
    asked = by_key(tables.shelves, requests, "shelf_id")
    room = asked.select("shelf_id", capacity.has_capacity().alias("has_capacity"))
    return requests.join(apart(room), "shelf_id", "left").withColumn(
        "reason", F.when(F.col("has_capacity").isNull(), "shelf_not_found")
    )


def missing_parties(tables: Collection, requests: DataFrame) -> DataFrame:
    """Requests with flags telling whether their book and student exist."""
    books = by_key(tables.books, requests, "book_id").select("book_id", F.lit(True).alias("_book"))
    students = by_key(tables.students, requests, "student_id").select(
        "student_id", F.lit(True).alias("_student")
    )
    return (
        requests.join(apart(books), "book_id", "left")
        .join(apart(students), "student_id", "left")
        .select(
            *requests.columns,
            F.col("_book").isNotNull().alias("book_exists"),
            F.col("_student").isNotNull().alias("student_exists"),
        )
    )
