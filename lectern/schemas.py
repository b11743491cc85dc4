"""Explicit schemas of the four collection tables, the audit table and the job inputs."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_DATE, _TIME = T.DateType(), T.TimestampNTZType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_TOUCHED = (("created_at", _TIME), ("updated_at", _TIME))

STUDENTS = _struct(
    ("student_id", _LONG),
    ("student_number", _TEXT),
    ("first_name", _TEXT),
    ("last_name", _TEXT),
    ("email", _TEXT),
    ("phone", _TEXT),
    ("program", _TEXT),
    ("enrollment_year", _INT),
    ("status", _TEXT),
    *_TOUCHED,
)

SHELVES = _struct(
    ("shelf_id", _LONG),
    ("location_code", _TEXT),
    ("section", _TEXT),
    ("main_topic", _TEXT),
    ("material", _TEXT),
    ("total_capacity", _INT),
    ("current_book_count", _INT),
    *_TOUCHED,
)

BOOKS = _struct(
    ("book_id", _LONG),
    ("isbn", _TEXT),
    ("title", _TEXT),
    ("author", _TEXT),
    ("publisher", _TEXT),
    ("publication_year", _INT),
    ("edition", _TEXT),
    ("language", _TEXT),
    ("pages", _INT),
    ("book_type", _TEXT),
    ("shelf_id", _LONG),
    ("status", _TEXT),
    ("acquisition_date", _DATE),
    *_TOUCHED,
)

LOANS = _struct(
    ("loan_id", _LONG),
    ("book_id", _LONG),
    ("student_id", _LONG),
    ("loan_date", _DATE),
    ("estimated_return_date", _DATE),
    ("actual_return_date", _DATE),
    ("loan_status", _TEXT),
    ("renewal_count", _INT),
    ("notes", _TEXT),
    *_TOUCHED,
)

AUDIT_LOG = _struct(
    ("log_id", _LONG),
    ("table_name", _TEXT),
    ("operation", _TEXT),
    ("old_values", _TEXT),
    ("new_values", _TEXT),
    ("user_id", _TEXT),
    ("timestamp", _TIME),
)

TABLES = {"students": STUDENTS, "shelves": SHELVES, "books": BOOKS, "loans": LOANS}

PRIMARY_KEY = {
    "students": "student_id",
    "shelves": "shelf_id",
    "books": "book_id",
    "loans": "loan_id",
}

LOAN_REQUESTS = _struct(
    ("seq", _LONG),
    ("book_id", _LONG),
    ("student_id", _LONG),
    ("loan_date", _DATE),
    ("estimated_return_date", _DATE),
    ("notes", _TEXT),
)
RETURNS = _struct(("seq", _LONG), ("loan_id", _LONG), ("return_date", _DATE))
RENEWALS = _struct(("seq", _LONG), ("loan_id", _LONG), ("new_due", _DATE))
MOVES = _struct(("seq", _LONG), ("book_id", _LONG), ("shelf_id", _LONG))

LOAN_EVENTS = _struct(
    ("seq", _LONG),
    ("event", _TEXT),
    ("loan_id", _LONG),
    ("book_id", _LONG),
    ("student_id", _LONG),
    ("event_date", _DATE),
    ("new_due", _DATE),
)
SHELF_DELTAS = _struct(("seq", _LONG), ("shelf_id", _LONG), ("delta", _INT))

# Fixed values -----------------------------------------------------------------
# Enumerations, column lengths, defaults and policy numbers that every result
# depends on.
STUDENT_STATUSES = ("active", "inactive", "graduated")
BOOK_TYPES = ("physical", "digital")
BOOK_STATUSES = ("available", "loaned", "maintenance", "lost")
LOAN_STATUSES = ("active", "returned", "overdue", "lost")
OPEN_LOAN_STATUSES = ("active", "overdue")
SHELF_MATERIALS = ("Wood", "Metal", "Plastic", "Glass", "Composite")

MAX_LENGTH = {
    "students": {
        "student_number": 20,
        "first_name": 100,
        "last_name": 100,
        "email": 255,
        "phone": 20,
        "program": 100,
        "status": 20,
    },
    "shelves": {"location_code": 10, "section": 50, "main_topic": 100, "material": 50},
    "books": {
        "isbn": 20,
        "title": 500,
        "author": 300,
        "publisher": 200,
        "edition": 50,
        "language": 50,
        "book_type": 20,
        "status": 20,
    },
    "loans": {"loan_status": 20},
}

NOT_NULL = {
    "students": ("student_number", "first_name", "last_name", "email"),
    "shelves": ("location_code", "section", "main_topic", "total_capacity"),
    "books": ("title", "author"),
    "loans": ("book_id", "student_id", "loan_date", "estimated_return_date"),
}

UNIQUE = {
    "students": ("student_number", "email"),
    "shelves": ("location_code",),
    "books": ("isbn",),
    "loans": (),
}

DEFAULTS = {
    "students": {"status": "active"},
    "shelves": {"current_book_count": 0},
    "books": {"language": "Spanish", "book_type": "physical", "status": "available"},
    "loans": {"loan_status": "active", "renewal_count": 0},
}

# Columns a patch may change; keys, derived counts and timestamps are not among them.
PATCHABLE = {
    "students": (
        "student_number",
        "first_name",
        "last_name",
        "email",
        "phone",
        "program",
        "enrollment_year",
        "status",
    ),
    "shelves": ("location_code", "section", "main_topic", "material", "total_capacity"),
    "books": (
        "isbn",
        "title",
        "author",
        "publisher",
        "publication_year",
        "edition",
        "language",
        "pages",
        "book_type",
        "shelf_id",
        "status",
        "acquisition_date",
    ),
}

LOAN_DAYS = 14
DIGITAL_LOAN_DAYS = 7
MAX_LOAN_DAYS = 365
MAX_OPEN_LOANS = 5
# ------------------------------------------------------------------------------
