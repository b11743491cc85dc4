"""Data-quality rules over DataFrames.

Two sets per table. ``strict`` works on typed rows and follows constraint semantics: a rule whose
inputs are null is not violated. ``intake`` works on raw text as it arrives, before casting, and
reports messages for people. Row rules are plain column expressions evaluated in one pass; rules
over several rows (uniqueness, one open loan per book, references) aggregate to their key first.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import schemas as S
from lectern.functions import formats
from lectern.functions.dates import days_between, lenient_date
from lectern.functions.text import blank, blank_or_white, lenient_int
from lectern.plans.views import is_open
from lectern.session import apart
from lectern.sources.collection import Collection


@dataclass(frozen=True)
class Rule:
    name: str
    violated: Column
    message: str = ""


def _unless(check: Column) -> Column:
    """Violated where the check is false; a check on nulls passes."""
    return F.coalesce(~check, F.lit(False))


def _outside(column: str, allowed: Iterable[str]) -> Column:
    return _unless(F.col(column).isin(*allowed))


def _not_null(table: str) -> list[Rule]:
    return [Rule(f"{c}_missing", F.col(c).isNull()) for c in S.NOT_NULL[table]]


def _too_long(table: str) -> list[Rule]:
    return [
        Rule(f"{c}_too_long", _unless(F.length(c) <= limit))
        for c, limit in S.MAX_LENGTH[table].items()
    ]


def strict_rules(table: str, as_of: date) -> list[Rule]:
    """Constraints of a table, for typed rows."""
    last_year = as_of.year + 1
    col = F.col
    if table == "students":
        own = [
            Rule("student_number_format", _unless(col("student_number").rlike(formats.STUDENT_NUMBER))),
            Rule("email_format", _unless(col("email").rlike(formats.EMAIL))),
            Rule("phone_format", _unless(col("phone").rlike(formats.PHONE))),
            Rule("enrollment_year_range", _unless(col("enrollment_year").between(1900, last_year))),
            Rule("names_blank", _unless(~blank("first_name") & ~blank("last_name"))),
            Rule("status_unknown", _outside("status", S.STUDENT_STATUSES)),
        ]
    elif table == "shelves":
        count, capacity = col("current_book_count"), col("total_capacity")
        own = [
            Rule("location_code_format", _unless(col("location_code").rlike(formats.LOCATION_CODE))),
            Rule("section_blank", _unless(~blank("section"))),
            Rule("main_topic_blank", _unless(~blank("main_topic"))),
            Rule("total_capacity_not_positive", _unless(capacity > 0)),
            Rule("current_book_count_range", _unless((count >= 0) & (count <= capacity))),
            Rule("material_unknown", _outside("material", S.SHELF_MATERIALS)),
        ]
    elif table == "books":
        shelf, kind = col("shelf_id"), col("book_type")
        own = [
            Rule("isbn_format", _unless(col("isbn").rlike(formats.ISBN))),
            Rule("title_blank", _unless(~blank("title"))),
            Rule("author_blank", _unless(~blank("author"))),
            Rule("publication_year_range", _unless(col("publication_year").between(1000, last_year))),
            Rule("pages_not_positive", _unless(col("pages") > 0)),
            Rule("acquisition_in_future", _unless(col("acquisition_date") <= F.lit(as_of))),
            Rule("physical_without_shelf", _unless((kind == "digital") | shelf.isNotNull())),
            Rule("digital_with_shelf", _unless((kind == "physical") | shelf.isNull())),
            Rule("book_type_unknown", _outside("book_type", S.BOOK_TYPES)),
            Rule("status_unknown", _outside("status", S.BOOK_STATUSES)),
        ]
    elif table == "loans":
        own = [*loan_period_rules(as_of), *_loan_state_rules()]
    else:
        raise ValueError(f"no rules for table {table!r}")
    return [*_not_null(table), *_too_long(table), *own]


def loan_period_rules(as_of: date) -> list[Rule]:
    opened, due = F.col("loan_date"), F.col("estimated_return_date")
    return [
        Rule("loan_date_in_future", _unless(opened <= F.lit(as_of))),
        Rule("due_not_after_loan", _unless(due > opened)),
        Rule("loan_period_too_long", _unless(due <= F.date_add(opened, S.MAX_LOAN_DAYS))),
    ]


def _loan_state_rules() -> list[Rule]:
    opened, actual = F.col("loan_date"), F.col("actual_return_date")
    status = F.col("loan_status")
    return [
        Rule("return_before_loan", _unless(actual >= opened)),
        Rule("renewal_count_negative", _unless(F.col("renewal_count") >= 0)),
        Rule("returned_without_date", _unless((status != "returned") | actual.isNotNull())),
        Rule("active_with_return_date", _unless((status != "active") | actual.isNull())),
        Rule("loan_status_unknown", _outside("loan_status", S.LOAN_STATUSES)),
    ]


# Wording of the intake messages, by table.
STUDENT_MESSAGES = {
    "required": "{} is required",
    "digits": "Student number must contain only digits",
    "length": "Student number must be between 4 and 20 digits",
    "email": "Invalid email format",
    "status": "Status must be 'active', 'inactive', or 'graduated'",
    "year_range": "Enrollment year must be between 1900 and 2030",
    "year_integer": "Enrollment year must be a valid integer",
}
SHELF_MESSAGES = {
    "required": "{} is required",
    "location": "Location code must be in format: Letter followed by 1-2 digits (e.g., A1, B12)",
    "section": "Section cannot be empty",
    "topic": "Main topic cannot be empty",
    "capacity_positive": "Total capacity must be a positive integer",
    "capacity_integer": "Total capacity must be a valid integer",
    "count_negative": "Current book count cannot be negative",
    "count_exceeds": "Current book count cannot exceed total capacity",
    "count_integer": "Current book count must be a valid integer",
    "material": "Material must be one of: Wood, Metal, Plastic, Glass, Composite",
}
BOOK_MESSAGES = {
    "required": "{} is required and cannot be empty",
    "isbn": "ISBN must be in valid format (10 or 13 digits, last digit can be X)",
    "year_range": "Publication year must be between 1000 and {}",
    "year_integer": "Publication year must be a valid integer",
    "pages_positive": "Pages must be a positive integer",
    "pages_integer": "Pages must be a valid integer",
    "type": "Book type must be 'physical' or 'digital'",
    "status": "Status must be 'available', 'loaned', 'maintenance', or 'lost'",
    "physical": "Physical books must be assigned to a shelf",
    "digital": "Digital books cannot be assigned to a shelf",
    "acquisition": "Acquisition date must be in YYYY-MM-DD format",
}
LOAN_MESSAGES = {
    "required": "{} is required",
    "future": "Loan date cannot be in the future",
    "loan_date": "Loan date must be in YYYY-MM-DD format",
    "due_order": "Estimated return date must be after loan date",
    "period": "Loan period cannot exceed 365 days",
    "due_date": "Estimated return date must be in YYYY-MM-DD format",
    "actual_order": "Actual return date cannot be before loan date",
    "actual_date": "Actual return date must be in YYYY-MM-DD format",
    "status": "Loan status must be 'active', 'returned', 'overdue', or 'lost'",
    "returned": "Returned loans must have an actual return date",
    "active": "Active loans cannot have an actual return date",
    "renewals_negative": "Renewal count cannot be negative",
    "renewals_integer": "Renewal count must be a valid integer",
}
LAST_ENROLLMENT_YEAR = 2030
LAST_PUBLICATION_YEAR = 2025


def _given(column: str) -> Column:
    """Text that is present and not empty."""
    return F.coalesce(F.col(column) != "", F.lit(False))


def _intake(messages: dict[str, str], *found: tuple) -> list[Rule]:
    """Rules from ``(name, condition)`` or ``(name, condition, word for the message)``."""
    rules = []
    for name, condition, *word in found:
        key = "required" if name.endswith("_required") else name
        rules.append(Rule(name, F.coalesce(condition, F.lit(False)), messages[key].format(*word)))
    return rules


def _required(*columns: str) -> list[tuple]:
    return [(f"{c}_required", ~_given(c), c) for c in columns]


def student_intake() -> list[Rule]:
    number = F.coalesce(F.col("student_number"), F.lit(""))
    year = lenient_int(F.col("enrollment_year"))
    return _intake(
        STUDENT_MESSAGES,
        *_required("student_number", "first_name", "last_name", "email"),
        ("digits", (number != "") & ~number.rlike(r"^[0-9]+\z")),
        ("length", ~F.length(number).between(4, 20)),
        ("email", _given("email") & ~F.col("email").contains("@")),
        ("status", ~F.col("status").isin(*S.STUDENT_STATUSES)),
        ("year_range", ~year.between(1900, LAST_ENROLLMENT_YEAR)),
        ("year_integer", _given("enrollment_year") & year.isNull()),
    )


def shelf_intake() -> list[Rule]:
    capacity = lenient_int(F.col("total_capacity"))
    count = lenient_int(F.coalesce(F.col("current_book_count"), F.lit("0")))
    given_capacity = F.col("total_capacity").isNotNull()
    # A capacity of zero counts as absent as well as not positive.
    absent = ~_given("total_capacity") | F.coalesce(capacity == 0, F.lit(False))
    return _intake(
        SHELF_MESSAGES,
        *_required("location_code", "section", "main_topic"),
        ("total_capacity_required", absent, "total_capacity"),
        ("location", _given("location_code") & ~F.col("location_code").rlike(formats.LOCATION_CODE)),
        ("section", _given("section") & blank_or_white("section")),
        ("topic", _given("main_topic") & blank_or_white("main_topic")),
        ("capacity_positive", capacity <= 0),
        ("capacity_integer", given_capacity & capacity.isNull()),
        ("count_negative", count < 0),
        ("count_exceeds", (count >= 0) & (capacity != 0) & (count > capacity)),
        ("count_integer", F.col("current_book_count").isNotNull() & count.isNull()),
        ("material", _given("material") & ~F.col("material").isin(*S.SHELF_MATERIALS)),
    )


def book_intake(last_year: int = LAST_PUBLICATION_YEAR) -> list[Rule]:
    year, pages = lenient_int(F.col("publication_year")), lenient_int(F.col("pages"))
    kind = F.coalesce(F.col("book_type"), F.lit("physical"))
    shelved = _given("shelf_id") & F.coalesce(F.col("shelf_id") != "0", F.lit(False))
    rules = _intake(
        BOOK_MESSAGES | {"year_range": BOOK_MESSAGES["year_range"].format(last_year)},
        *[(f"{c}_required", F.col(c).isNull() | blank_or_white(c), c) for c in ("title", "author")],
        ("isbn", _given("isbn") & ~formats.is_intake_isbn(F.col("isbn"))),
        ("year_range", ~year.between(1000, last_year)),
        ("year_integer", F.col("publication_year").isNotNull() & year.isNull()),
        ("pages_positive", pages <= 0),
        ("pages_integer", F.col("pages").isNotNull() & pages.isNull()),
        ("type", ~kind.isin(*S.BOOK_TYPES)),
        ("status", ~F.col("status").isin(*S.BOOK_STATUSES)),
        ("physical", (kind == "physical") & ~shelved),
        ("digital", (kind == "digital") & shelved),
        ("acquisition", _given("acquisition_date") & lenient_date(F.col("acquisition_date")).isNull()),
    )
    return rules


def loan_intake(as_of: date) -> list[Rule]:
    opened = lenient_date(F.col("loan_date"))
    due = lenient_date(F.col("estimated_return_date"))
    actual = lenient_date(F.col("actual_return_date"))
    status = F.coalesce(F.col("loan_status"), F.lit("active"))
    renewals = lenient_int(F.col("renewal_count"))
    return _intake(
        LOAN_MESSAGES,
        *_required("book_id", "student_id"),
        ("future", opened > F.lit(as_of)),
        ("loan_date", _given("loan_date") & opened.isNull()),
        ("due_order", due <= opened),
        ("period", days_between(due, opened) > S.MAX_LOAN_DAYS),
        ("due_date", _given("estimated_return_date") & due.isNull()),
        ("actual_order", actual < opened),
        ("actual_date", _given("actual_return_date") & actual.isNull()),
        ("status", ~status.isin(*S.LOAN_STATUSES)),
        ("returned", (status == "returned") & ~_given("actual_return_date")),
        ("active", (status == "active") & _given("actual_return_date")),
        ("renewals_negative", renewals < 0),
        ("renewals_integer", F.col("renewal_count").isNotNull() & renewals.isNull()),
    )


def intake_rules(table: str, as_of: date) -> list[Rule]:
    """Checks of a table's raw text rows, with messages."""
    return {
        "students": student_intake,
        "shelves": shelf_intake,
        "books": book_intake,
        "loans": lambda: loan_intake(as_of),
    }[table]()


# Applying rules


def first_broken(rules: list[Rule]) -> Column:
    """Name of the first violated rule, null for a clean row."""
    return F.coalesce(*[F.when(r.violated, F.lit(r.name)) for r in rules])


def validate(df: DataFrame, rules: list[Rule], messages: bool = False) -> DataFrame:
    """Adds ``violations``: names (or messages) of the broken rules, empty for a clean row."""
    said = [
        F.when(r.violated, F.lit(r.message if messages else r.name)) for r in rules
    ]
    return df.withColumn("violations", F.array_compact(F.array(*said)))


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; the rejected rows carry their violations."""
    checked = validate(df, rules)
    clean = F.size("violations") == 0
    return checked.where(clean).drop("violations"), checked.where(~clean)


def summary(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule, n`` for every rule, in one pass over ``df``."""
    names = [r.name for r in rules]
    return df.agg(*[F.count_if(r.violated).alias(r.name) for r in rules]).unpivot(
        [], names, "rule", "n"
    )


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Non-null values of ``column`` held by more than one row, with their row counts."""
    known = df.where(F.col(column).isNotNull())
    return known.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def repeated_rows(df: DataFrame, column: str) -> DataFrame:
    """All rows that share their ``column`` value with another row."""
    return df.join(apart(repeated_values(df, column).select(column)), column, "left_semi")


def several_open_loans(loans: DataFrame) -> DataFrame:
    """Books with more than one open loan, with their open-loan counts."""
    return loans.where(is_open() & F.col("book_id").isNotNull()).groupBy("book_id").agg(
        F.count("*").alias("n")
    ).where("n > 1")


def _missing_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    known = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return known.join(parent.select(key), key, "left_anti")


def set_checks(tables: Collection) -> DataFrame:
    """``rule, n`` for the rules over several rows; ``n`` counts offending rows.

    Each check aggregates to one row per key before anything is joined or compared.
    """
    t = tables.as_dict()
    found = [
        (f"{table}.{column}_repeated", repeated_values(t[table], column))
        for table, columns in S.UNIQUE.items()
        for column in columns
    ]
    found.append(("loans.book_with_several_open_loans", several_open_loans(t["loans"])))
    found += [
        ("books.shelf_unknown", _missing_parent(t["books"], t["shelves"], "shelf_id")),
        ("loans.book_unknown", _missing_parent(t["loans"], t["books"], "book_id")),
        ("loans.student_unknown", _missing_parent(t["loans"], t["students"], "student_id")),
    ]
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.lit(name).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
            for name, df in found
        ],
    )
