from datetime import date

import pytest

from conftest import AS_OF, frame, rows
from lectern import schemas as S
from lectern.functions import formats
from lectern.operators import quality
from pyspark.sql import functions as F

GOOD = {
    "students": {
        "student_number": "2024001", "first_name": "A", "last_name": "B", "email": "a@b.org",
    },
    "shelves": {"location_code": "A1", "section": "S", "main_topic": "T", "total_capacity": 50},
    "books": {"title": "T", "author": "A", "book_type": "physical", "shelf_id": 1},
    "loans": {
        "book_id": 1, "student_id": 1, "loan_date": AS_OF,
        "estimated_return_date": date(2024, 12, 24), "loan_status": "active",
    },
}


def broken(spark, table, cases):
    """Violated strict rules per case, each a change to a good row."""
    schema = S.TABLES[table]
    made = [{**GOOD[table], S.PRIMARY_KEY[table]: i, **c} for i, c in enumerate(cases)]
    checked = quality.validate(frame(spark, schema, made), quality.strict_rules(table, AS_OF))
    found = {r[S.PRIMARY_KEY[table]]: set(r.violations) for r in checked.collect()}
    return [found[i] for i in range(len(cases))]


STRICT = {
    "students": [
        ({}, set()),
        ({"student_number": "1234"}, set()),
        ({"student_number": "20241234567890123456"}, set()),
        ({"student_number": "ABC123"}, {"student_number_format"}),
        ({"student_number": "123"}, {"student_number_format"}),
        ({"student_number": "1234\n"}, {"student_number_format"}),
        ({"student_number": "1" * 21}, {"student_number_format", "student_number_too_long"}),
        ({"student_number": None}, {"student_number_missing"}),
        ({"email": "test.email@domain.co.uk"}, set()),
        ({"email": "user+tag@example.org"}, set()),
        ({"email": "invalid-email"}, {"email_format"}),
        ({"email": "a@b.org\n"}, {"email_format"}),
        ({"phone": "+1-555-123-4567"}, set()),
        ({"phone": "call me"}, {"phone_format"}),
        ({"enrollment_year": 2023}, set()),
        ({"enrollment_year": 2025}, set()),
        ({"enrollment_year": 2026}, {"enrollment_year_range"}),
        ({"enrollment_year": 1800}, {"enrollment_year_range"}),
        ({"first_name": "  "}, {"names_blank"}),
        ({"first_name": "\t"}, set()),
        ({"status": "graduated"}, set()),
        ({"status": "invalid_status"}, {"status_unknown"}),
    ],
    "shelves": [
        *[({"location_code": c}, set()) for c in ("A1", "B2", "C10", "Z99")],
        *[({"location_code": c}, {"location_code_format"}) for c in ("1A", "AB", "123", "A", "A123", "A1\n")],
        ({"section": "   "}, {"section_blank"}),
        ({"total_capacity": 0}, {"total_capacity_not_positive"}),
        ({"current_book_count": 25}, set()),
        ({"total_capacity": 10, "current_book_count": 15}, {"current_book_count_range"}),
        ({"current_book_count": -1}, {"current_book_count_range"}),
        ({"material": "Glass"}, set()),
        ({"material": "Paper"}, {"material_unknown"}),
    ],
    "books": [
        ({"isbn": "9781234567890"}, set()),
        ({"isbn": "012345678X"}, set()),
        ({"isbn": "978-1-234-56789-0"}, {"isbn_format"}),
        ({"isbn": "9761234567890"}, {"isbn_format"}),
        ({"title": " "}, {"title_blank"}),
        ({"author": None}, {"author_missing"}),
        ({"publication_year": 500}, {"publication_year_range"}),
        ({"publication_year": 2025}, set()),
        ({"pages": -10}, {"pages_not_positive"}),
        ({"acquisition_date": date(2024, 12, 11)}, {"acquisition_in_future"}),
        ({"shelf_id": None}, {"physical_without_shelf"}),
        ({"book_type": "digital", "shelf_id": None}, set()),
        ({"book_type": "digital"}, {"digital_with_shelf"}),
        ({"status": "burnt"}, {"status_unknown"}),
        ({"book_type": "scroll"}, {"book_type_unknown", "digital_with_shelf"}),
    ],
    "loans": [
        ({}, set()),
        ({"loan_date": date(2024, 12, 11)}, {"loan_date_in_future"}),
        ({"estimated_return_date": date(2024, 12, 1)}, {"due_not_after_loan"}),
        ({"estimated_return_date": date(2026, 1, 14)}, {"loan_period_too_long"}),
        ({"estimated_return_date": date(2025, 12, 10)}, set()),
        ({"loan_status": "returned", "actual_return_date": date(2024, 12, 9)}, {"return_before_loan"}),
        ({"loan_status": "returned"}, {"returned_without_date"}),
        ({"actual_return_date": AS_OF}, {"active_with_return_date"}),
        ({"loan_status": "invalid_status"}, {"loan_status_unknown"}),
        ({"renewal_count": -1}, {"renewal_count_negative"}),
        ({"renewal_count": 10}, set()),
        ({"book_id": None}, {"book_id_missing"}),
    ],
}


@pytest.mark.parametrize("table", list(STRICT))
def test_strict_rules(spark, table):
    cases = STRICT[table]
    assert broken(spark, table, [c for c, _ in cases]) == [e for _, e in cases]


def messages(spark, table, cases):
    columns = [f.name for f in S.TABLES[table]]
    schema = ", ".join(f"{c} string" for c in columns) + ", case int"
    made = [
        tuple({**{k: str(v) for k, v in GOOD[table].items()}, **c}.get(n) for n in columns) + (i,)
        for i, c in enumerate(cases)
    ]
    df = spark.createDataFrame(made, schema)
    checked = quality.validate(df, quality.intake_rules(table, AS_OF), messages=True)
    found = {r.case: r.violations for r in checked.collect()}
    return [found[i] for i in range(len(cases))]


INTAKE = {
    "students": [
        ({}, []),
        ({"student_number": "12x4"}, ["Student number must contain only digits"]),
        ({"student_number": "123"}, ["Student number must be between 4 and 20 digits"]),
        ({"student_number": None},
         ["student_number is required", "Student number must be between 4 and 20 digits"]),
        ({"email": "invalid-email"}, ["Invalid email format"]),
        ({"enrollment_year": "1800"}, ["Enrollment year must be between 1900 and 2030"]),
        ({"enrollment_year": "soon"}, ["Enrollment year must be a valid integer"]),
        ({"status": "expelled"}, ["Status must be 'active', 'inactive', or 'graduated'"]),
    ],
    "shelves": [
        ({"total_capacity": "0"},
         ["total_capacity is required", "Total capacity must be a positive integer"]),
        ({"section": "   "}, ["Section cannot be empty"]),
        ({"main_topic": ""}, ["main_topic is required"]),
        ({"total_capacity": "10", "current_book_count": "15"},
         ["Current book count cannot exceed total capacity"]),
        ({"total_capacity": "many"}, ["Total capacity must be a valid integer"]),
        ({"material": "Paper"}, ["Material must be one of: Wood, Metal, Plastic, Glass, Composite"]),
    ],
    "books": [
        ({}, []),
        ({"title": " \t"}, ["title is required and cannot be empty"]),
        ({"isbn": "978-1-234-56789-0"}, []),
        ({"isbn": "0-123-45678-9"}, []),
        ({"isbn": "123"}, ["ISBN must be in valid format (10 or 13 digits, last digit can be X)"]),
        ({"publication_year": "500"}, ["Publication year must be between 1000 and 2025"]),
        ({"publication_year": "x"}, ["Publication year must be a valid integer"]),
        ({"pages": "-10"}, ["Pages must be a positive integer"]),
        ({"shelf_id": None}, ["Physical books must be assigned to a shelf"]),
        ({"book_type": "digital"}, ["Digital books cannot be assigned to a shelf"]),
        ({"acquisition_date": "2024-1-5"}, []),
        ({"acquisition_date": "05/01/2024"}, ["Acquisition date must be in YYYY-MM-DD format"]),
    ],
    "loans": [
        ({}, []),
        ({"loan_date": "2024-12-11"}, ["Loan date cannot be in the future"]),
        ({"loan_date": "2024-13-01"}, ["Loan date must be in YYYY-MM-DD format"]),
        ({"estimated_return_date": "2024-12-01"}, ["Estimated return date must be after loan date"]),
        ({"estimated_return_date": "2026-1-14"}, ["Loan period cannot exceed 365 days"]),
        ({"loan_status": "returned"}, ["Returned loans must have an actual return date"]),
        ({"actual_return_date": "2024-12-12"}, ["Active loans cannot have an actual return date"]),
        ({"loan_status": "returned", "actual_return_date": "2024-12-01"},
         ["Actual return date cannot be before loan date"]),
        ({"renewal_count": "-1"}, ["Renewal count cannot be negative"]),
        ({"renewal_count": "two"}, ["Renewal count must be a valid integer"]),
        ({"book_id": None}, ["book_id is required"]),
    ],
}


@pytest.mark.parametrize("table", list(INTAKE))
def test_intake_messages(spark, table):
    cases = INTAKE[table]
    assert messages(spark, table, [c for c, _ in cases]) == [e for _, e in cases]


def test_isbn_formats(spark):
    good = ["0123456789", "012345678X", "0-123-45678-9", "9781234567890", "9791234567890",
            "978-1-234-56789-0"]
    bad = ["123", "12345678901234", "abcd567890", "9761234567890"]
    df = spark.createDataFrame([(x,) for x in good + bad], "isbn string")
    found = dict(rows(df.select("isbn", formats.is_intake_isbn(F.col("isbn")).alias("ok"))))
    assert all(found[x] for x in good) and not any(found[x] for x in bad)
    printed = dict(rows(df.select("isbn", formats.is_printed_isbn(F.col("isbn")).alias("ok"))))
    assert printed["978-1-234-56789-0"] and not printed["12345678901234"]


def test_seed_is_clean_and_split_keeps_all_rows(seed):
    for table, df in seed.as_dict().items():
        accepted, rejected = quality.split(df, quality.strict_rules(table, AS_OF))
        assert rejected.count() == 0 and accepted.count() == df.count()
    assert {r.n for r in quality.set_checks(seed).collect()} == {0}


def test_set_checks_find_offenders(spark, seed):
    twin = frame(
        spark, S.LOANS,
        [{"loan_id": 9, "book_id": 2, "student_id": 3, "loan_status": "overdue"},
         {"loan_id": 10, "book_id": 404, "student_id": 405, "loan_status": "lost"}],
    )
    books = seed.books.withColumn("isbn", F.when(F.col("book_id") < 4, "9780000000000"))
    found = dict(rows(quality.set_checks(
        seed.with_tables(loans=seed.loans.unionByName(twin), books=books))))
    assert found["loans.book_with_several_open_loans"] == 2
    assert found["books.isbn_repeated"] == 3
    assert found["loans.book_unknown"] == 1 and found["loans.student_unknown"] == 1
