import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lectern import schemas as S  # noqa: E402
from lectern.operators.shelving import fix_capacity_counts  # noqa: E402
from lectern.session import local_session  # noqa: E402
from lectern.sources.collection import Collection  # noqa: E402

SMALL = "/root/testdata/sf0.001"
AS_OF = date(2024, 12, 10)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "lectern-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame(spark, schema, rows):
    """Rows given as dicts; absent columns are null."""
    names = [f.name for f in schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def rows(df, *columns):
    """Sorted tuples of the named columns, nulls first."""
    columns = columns or df.columns
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: [(v is not None, v) for v in r])


def day(text):
    return date.fromisoformat(text)


SHELVES = [
    ("A1", "Section A", "Computer Science", "Wood", 50),
    ("A2", "Section A", "Mathematics", "Wood", 45),
    ("B1", "Section B", "Physics", "Metal", 40),
    ("B2", "Section B", "Chemistry", "Metal", 35),
    ("C1", "Section C", "Literature", "Wood", 60),
]
BOOKS_PER_SHELF = (5, 3, 2, 2, 2)
LOANS = [
    (1, 1, "2024-11-01", "2024-11-15", "2024-11-14", "returned"),
    (2, 1, "2024-11-20", "2024-12-04", None, "active"),
    (3, 2, "2024-11-15", "2024-11-29", "2024-12-01", "returned"),
    (4, 3, "2024-12-01", "2024-12-15", None, "active"),
    (5, 4, "2024-11-10", "2024-11-24", None, "overdue"),
]


@pytest.fixture(scope="session")
def seed(spark) -> Collection:
    """A small collection: five shelves, five students, fourteen books, five loans."""
    shelves = [
        {
            "shelf_id": i, "location_code": code, "section": section, "main_topic": topic,
            "material": material, "total_capacity": capacity, "current_book_count": 0,
        }
        for i, (code, section, topic, material, capacity) in enumerate(SHELVES, 1)
    ]
    students = [
        {
            "student_id": i, "student_number": f"202400{i}", "first_name": f"First{i}",
            "last_name": f"Last{i}", "email": f"reader{i}@example.org",
            "program": "Programme " + "AABBC"[i - 1], "enrollment_year": 2021 + i % 3,
            "status": "active",
        }
        for i in range(1, 6)
    ]
    books, shelf_of = [], [s for s, n in enumerate(BOOKS_PER_SHELF, 1) for _ in range(n)]
    for i, shelf in enumerate(shelf_of, 1):
        books.append(
            {
                "book_id": i, "isbn": f"978{i:09d}0", "title": f"Title {i:02d}",
                "author": f"Author {i % 4}", "publisher": f"House {i % 3}",
                "publication_year": 1990 + i, "language": "English", "pages": 100 + i,
                "book_type": "physical", "shelf_id": shelf, "status": "available",
            }
        )
    loans = [
        {
            "loan_id": i, "book_id": book, "student_id": student, "loan_date": day(opened),
            "estimated_return_date": day(due),
            "actual_return_date": day(actual) if actual else None,
            "loan_status": status, "renewal_count": 0,
        }
        for i, (book, student, opened, due, actual, status) in enumerate(LOANS, 1)
    ]
    bare = Collection(
        students=frame(spark, S.STUDENTS, students),
        shelves=frame(spark, S.SHELVES, shelves),
        books=frame(spark, S.BOOKS, books),
        loans=frame(spark, S.LOANS, loans),
    )
    return bare.with_tables(shelves=fix_capacity_counts(bare))
