"""Grouped and summary reports.

Loans are the large table. Every report aggregates them to their key before joining, so a book or
student holding a third of all loans arrives at the join as a single row.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import capacity, text
from lectern.functions.dates import days_between, month_label, month_start
from lectern.functions.formats import EMAIL_LIKE
from lectern.operators import paging
from lectern.plans import views
from lectern.plans.listings import down, up
from lectern.session import pin
from lectern.sources.collection import Collection

_LATE = "actual_return_date > estimated_return_date"


def _status_count(column: str, value: str) -> Column:
    return F.count_if(F.col(column) == value)


def _counted(df: DataFrame, key: str, count: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(count))


# Students


def students_by_program(tables: Collection) -> DataFrame:
    found = _counted(tables.students, "program", "student_count")
    return found.orderBy(down("student_count"), up("program"))


def students_by_year(tables: Collection) -> DataFrame:
    known = tables.students.where(F.col("enrollment_year").isNotNull())
    return _counted(known, "enrollment_year", "student_count").orderBy(down("enrollment_year"))


# Books


def books_by_status(tables: Collection) -> DataFrame:
    found = _counted(tables.books, "status", "book_count")
    return found.orderBy(down("book_count"), up("status"))


def books_by_year(tables: Collection) -> DataFrame:
    known = tables.books.where(F.col("publication_year").isNotNull())
    return _counted(known, "publication_year", "book_count").orderBy(down("publication_year"))


def books_by_language(tables: Collection) -> DataFrame:
    found = _counted(tables.books, "language", "book_count")
    return found.orderBy(down("book_count"), up("language"))


def books_per_shelf(tables: Collection) -> DataFrame:
    """Books of any type per shelf, shelves without books included."""
    held = tables.books.where(F.col("shelf_id").isNotNull())
    return (
        tables.shelves.join(_counted(held, "shelf_id", "held"), "shelf_id", "left")
        .select(
            "shelf_id",
            "section",
            "location_code",
            F.coalesce("held", F.lit(0)).alias("book_count"),
        )
        .orderBy(up("section"), up("location_code"))
    )


def inventory_stats(tables: Collection) -> DataFrame:
    return tables.books.agg(*_inventory_counts())


def _inventory_counts() -> list[Column]:
    return [
        F.count("*").alias("total_books"),
        *[_status_count("book_type", t).alias(f"{t}_books") for t in ("physical", "digital")],
        *[
            _status_count("status", s).alias(f"{s}_books")
            for s in ("available", "loaned", "maintenance", "lost")
        ],
    ]


def _distinct(df: DataFrame, column: str) -> Column:
    return df.agg(F.countDistinct(column).alias("n")).scalar()


def book_statistics(tables: Collection) -> DataFrame:
    """Inventory counts, distinct authors, publishers and languages, and the year range.

    The distinct counts are scalar subqueries, which Spark merges into one. Apart from the other counts
    they read three columns only, and equal values collapse before they are shuffled.
    """
    counts = tables.books.agg(
        *_inventory_counts(),
        F.avg("publication_year").alias("avg_publication_year"),
        F.min("publication_year").alias("oldest_book_year"),
        F.max("publication_year").alias("newest_book_year"),
    )
    return counts.withColumns(
        {
            "unique_authors": _distinct(tables.books, "author"),
            "unique_publishers": _distinct(tables.books, "publisher"),
            "languages": _distinct(tables.books, "language"),
        }
    )


# Shelves


def shelves_by_section(tables: Collection) -> DataFrame:
    return (
        tables.shelves.groupBy("section")
        .agg(
            F.count("*").alias("shelf_count"),
            F.sum("total_capacity").alias("total_capacity"),
            F.sum("current_book_count").alias("total_books"),
            F.round(F.avg(capacity.utilization()), 2).alias("avg_utilization"),
        )
        .orderBy(up("section"))
    )


def capacity_report(tables: Collection) -> DataFrame:
    """Totals and the average of the per-shelf percentages as shown, that is, rounded."""
    return views.shelf_utilization(tables).agg(
        F.count("*").alias("total_shelves"),
        F.sum("total_capacity").alias("total_capacity"),
        F.sum("current_book_count").alias("total_books"),
        F.sum("available_space").alias("total_available_space"),
        F.round(F.avg("utilization_percentage"), 2).alias("avg_utilization"),
        _status_count("status", "Full").alias("full_shelves"),
        _status_count("status", "Nearly Full").alias("nearly_full_shelves"),
        _status_count("status", "Empty").alias("empty_shelves"),
    )


def capacity_stats(tables: Collection) -> DataFrame:
    """Totals and the average of the unrounded percentages."""
    return tables.shelves.agg(
        F.count("*").alias("total_shelves"),
        F.sum("total_capacity").alias("total_capacity"),
        F.sum("current_book_count").alias("total_books"),
        F.sum(capacity.available_space()).alias("total_available_space"),
        F.round(F.avg(capacity.utilization()), 2).alias("avg_utilization"),
        F.count_if(F.col("current_book_count") == F.col("total_capacity")).alias("full_shelves"),
        F.count_if(F.col("current_book_count") == 0).alias("empty_shelves"),
    )


def shelf_consistency(tables: Collection) -> DataFrame:
    """Recorded count of every shelf next to the physical books found on it."""
    found = F.coalesce("rows", F.lit(0))
    recorded = F.col("current_book_count")
    return tables.shelves.join(views.shelf_sizes(tables.books), "shelf_id", "left").select(
        "shelf_id",
        "location_code",
        recorded.alias("recorded_count"),
        found.alias("actual_count"),
        F.when(found == recorded, "OK").otherwise("MISMATCH").alias("status"),
    )


def shelf_mismatches(tables: Collection) -> DataFrame:
    wrong = F.col("recorded_count") != F.col("actual_count")
    return shelf_consistency(tables).where(wrong).orderBy(up("location_code"))


# Loans


def loan_statistics(tables: Collection) -> DataFrame:
    status = "loan_status"
    return tables.loans.agg(
        F.count("*").alias("total_loans"),
        *[
            _status_count(status, s).alias(f"{s}_loans")
            for s in ("active", "overdue", "returned", "lost")
        ],
        F.avg(days_between("actual_return_date", "loan_date")).alias("avg_loan_duration"),
        F.count_if(F.expr(_LATE)).alias("late_returns"),
        F.avg("renewal_count").alias("avg_renewals"),
    )


def student_loan_summary(tables: Collection) -> DataFrame:
    """Loan counts of every student, zeroes for one without loans."""
    per_student = tables.loans.groupBy("student_id").agg(
        F.count("*").alias("total_loans"),
        F.count_if(views.is_open()).alias("current_loans"),
        _status_count("loan_status", "overdue").alias("overdue_loans"),
        F.count_if(F.expr(_LATE)).alias("late_returns"),
        F.max("loan_date").alias("last_loan_date"),
    )
    counts = ("total_loans", "current_loans", "overdue_loans", "late_returns")
    return (
        tables.students.select("student_id")
        .join(per_student, "student_id", "left")
        .select(
            "student_id",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            "last_loan_date",
        )
    )


def loans_by_status(tables: Collection) -> DataFrame:
    found = _counted(tables.loans, "loan_status", "loan_count")
    return found.orderBy(down("loan_count"), up("loan_status"))


def loans_by_month(tables: Collection) -> DataFrame:
    status = "loan_status"
    return (
        tables.loans.groupBy(month_start("loan_date").alias("month"))
        .agg(
            F.count("*").alias("loans_created"),
            _status_count(status, "returned").alias("loans_returned"),
            _status_count(status, "active").alias("loans_active"),
            _status_count(status, "overdue").alias("loans_overdue"),
        )
        .orderBy(down("month"))
    )


def monthly_report(tables: Collection) -> DataFrame:
    status = "loan_status"
    return (
        tables.loans.groupBy(month_label("loan_date").alias("month"))
        .agg(
            F.count("*").alias("total_loans"),
            _status_count(status, "returned").alias("returned"),
            _status_count(status, "active").alias("active"),
            _status_count(status, "overdue").alias("overdue"),
        )
        .orderBy(down("month"))
    )


def student_history(tables: Collection) -> DataFrame:
    per_student = tables.loans.groupBy("student_id").agg(
        F.count("*").alias("total_loans"),
        _status_count("loan_status", "active").alias("active_loans"),
        F.count_if((F.col("loan_status") == "returned") & F.expr(_LATE)).alias("late_returns"),
        F.max("loan_date").alias("last_loan_date"),
    )
    counts = ("total_loans", "active_loans", "late_returns")
    return (
        tables.students.join(per_student, "student_id", "left")
        .select(
            "student_number",
            text.display_name().alias("student_name"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            "last_loan_date",
        )
        .orderBy(down("total_loans"), up("student_number"))
    )


def popular_books(tables: Collection, top: int = 10) -> DataFrame:
    """Most loaned books; ties go to the smaller ``book_id``."""
    per_book = tables.loans.groupBy("book_id").agg(
        F.count("*").alias("loan_count"), F.max("loan_date").alias("last_loaned")
    )
    order = F.desc("loan_count"), "book_id"
    # Only the keys of the books decide; titles join the few rows that are left.
    most = per_book.join(tables.books.select("book_id"), "book_id", "left_semi").orderBy(*order).limit(top)
    return (
        tables.books.join(most, "book_id")
        .select("book_id", "title", "author", "loan_count", "last_loaned")
        .orderBy(*order)
    )


def students_with_several_active(
    tables: Collection, page_size: int = paging.PAGE_SIZE
) -> DataFrame:
    """Students with more than one active loan and the titles they hold.

    Every ``page_size`` loans, in order of their keys, make a page, whose titles are joined in order.
    """
    # A loan counts when its book exists, and that needs only the keys of the books.
    per_student = pin(
        tables.loans.where(F.col("loan_status") == "active")
        .join(tables.books.select("book_id"), "book_id", "left_semi")
        .groupBy("student_id")
        .agg(F.count("*").alias("rows"))
        .where("rows > 1")
    )
    held = (
        tables.loans.where(F.col("loan_status") == "active")
        .join(per_student.select("student_id"), "student_id", "left_semi")
        .join(tables.books.select("book_id", "title"), "book_id")
        .select("student_id", "loan_id", "title")
    )
    lists = paging.gather(
        held, "student_id", "loan_id", F.struct("title", "loan_id"), "held", page_size
    )
    return (
        lists.join(per_student, "student_id")
        .join(
            tables.students.select(
                "student_id", "student_number", text.display_name().alias("student_name")
            ),
            "student_id",
        )
        .select(
            "student_number",
            "student_name",
            F.col("rows").alias("active_loans"),
            "page",
            F.array_join("held.title", ", ").alias("books_on_loan"),
        )
        .orderBy(down("active_loans"), up("student_number"), up("page"))
    )


def average_duration(tables: Collection) -> DataFrame:
    """Mean days on loan of returned loans, rounded half up from the exact quotient."""
    days = F.sum(days_between("actual_return_date", "loan_date"))
    returned = F.count("actual_return_date")
    return tables.loans.where(F.col("actual_return_date").isNotNull()).agg(
        F.round(
            F.try_divide(days.cast("decimal(20,0)"), returned.cast("decimal(18,0)")), 2
        ).alias("avg_loan_days"),
        returned.alias("returned_loans"),
    )


def section_popularity(tables: Collection) -> DataFrame:
    per_book = _counted(tables.loans, "book_id", "loans")
    per_shelf = (
        tables.books.where(F.col("shelf_id").isNotNull())
        .join(per_book, "book_id")
        .groupBy("shelf_id")
        .agg(F.sum("loans").alias("loans"))
    )
    return (
        tables.shelves.join(per_shelf, "shelf_id")
        .groupBy("section", "main_topic")
        .agg(F.sum("loans").alias("total_loans"))
        .orderBy(down("total_loans"), up("section"), up("main_topic"))
    )


# Integrity


def duplicate_isbns(tables: Collection) -> DataFrame:
    known = tables.books.where(F.col("isbn").isNotNull())
    return _counted(known, "isbn", "duplicate_count").where("duplicate_count > 1")


def malformed_emails(tables: Collection) -> DataFrame:
    return tables.students.agg(
        F.lit("Invalid email formats").alias("check_type"),
        F.count_if(~F.col("email").like(EMAIL_LIKE)).alias("count"),
    )


def _orphans(child: DataFrame, parent: DataFrame, key: str, label: str) -> DataFrame:
    """Child rows without parent, counted. One row per key reaches the join."""
    return (
        _counted(child, key, "n")
        .join(parent.select(key), key, "left_anti")
        .agg(F.lit(label).alias("check_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
    )


def orphan_checks(tables: Collection) -> DataFrame:
    placed = tables.books.where(F.col("shelf_id").isNotNull())
    return (
        _orphans(placed, tables.shelves, "shelf_id", "Orphaned Books (invalid shelf_id)")
        .unionByName(
            _orphans(
                tables.loans, tables.students, "student_id", "Orphaned Loans (invalid student_id)"
            )
        )
        .unionByName(
            _orphans(tables.loans, tables.books, "book_id", "Orphaned Loans (invalid book_id)")
        )
    )


# Overviews


def table_overview(tables: Collection) -> DataFrame:
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        for name, df in tables.as_dict().items()
    ]
    first, *rest = counts
    for df in rest:
        first = first.unionByName(df)
    return first.orderBy("table_name")


def _metrics(df: DataFrame, **counts: Column) -> DataFrame:
    """One pass over ``df``, one row per named count."""
    counted = df.agg(*[c.alias(name) for name, c in counts.items()])
    return counted.unpivot([], list(counts), "metric", "value")


def usage_summary(tables: Collection) -> DataFrame:
    """Eight headline counts as text. Each table is read once."""
    labels = {
        "total_students": "Total Students",
        "active_students": "Active Students",
        "total_books": "Total Books",
        "available_books": "Available Books",
        "books_on_loan": "Books on Loan",
        "total_shelves": "Total Shelves",
        "active_loans": "Active Loans",
        "overdue_loans": "Overdue Loans",
    }
    rows = (
        _metrics(
            tables.students,
            total_students=F.count("*"),
            active_students=_status_count("status", "active"),
        )
        .unionByName(
            _metrics(
                tables.books,
                total_books=F.count("*"),
                available_books=_status_count("status", "available"),
                books_on_loan=_status_count("status", "loaned"),
            )
        )
        .unionByName(_metrics(tables.shelves, total_shelves=F.count("*")))
        .unionByName(
            _metrics(
                tables.loans,
                active_loans=_status_count("loan_status", "active"),
                overdue_loans=_status_count("loan_status", "overdue"),
            )
        )
    )
    shown = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return rows.select(
        shown[F.col("metric")].alias("metric"), F.col("value").cast("string").alias("value")
    )


def health(tables: Collection) -> DataFrame:
    """Key figures in one row: one pass per table, put together as scalar subqueries."""
    loans = tables.loans.agg(
        _status_count("loan_status", "active").alias("active"),
        _status_count("loan_status", "overdue").alias("overdue"),
        F.count("*").alias("total"),
    ).select(F.struct("active", "overdue", "total").alias("of"))
    shelves = tables.shelves.agg(
        F.sum("current_book_count").alias("held"), F.sum("total_capacity").alias("room")
    ).select(F.struct("held", "room").alias("of"))
    available = tables.books.agg(_status_count("status", "available").alias("n"))
    gathered = tables.students.agg(F.count("*").alias("total_students")).select(
        "total_students",
        available.scalar().alias("available_books"),
        loans.scalar().alias("loans"),
        shelves.scalar().alias("shelves"),
    )
    return gathered.select(
        "total_students",
        "available_books",
        F.col("loans.active").alias("active_loans"),
        F.col("loans.overdue").alias("overdue_loans"),
        F.round(F.try_divide(100.0 * F.col("loans.overdue"), F.col("loans.total")), 2).alias(
            "overdue_percentage"
        ),
        F.round(F.try_divide(100.0 * F.col("shelves.held"), F.col("shelves.room")), 2).alias(
            "utilization_rate"
        ),
    )
