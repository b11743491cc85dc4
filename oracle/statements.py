"""One statement per query name, to be run on the star tables."""

from oracle.prelude import AS_OF, BATCHES, MOMENT, statement

ORACLES: dict[str, str] = {}


def sql(name: str, body: str, *more: str) -> None:
    ORACLES[name] = statement(body, *more)


def batch_sql(name: str, body: str, *more: str) -> None:
    ORACLES[name] = statement(body, BATCHES, *more)


STUDENT = "student_number, first_name, last_name"
PLACE = "s.location_code, s.section, s.main_topic"
OPEN = "('active', 'overdue')"

# Sources, sinks

sql("src1_students", "SELECT * FROM students")
sql("src1_shelves", "SELECT * FROM shelves")
sql("src1_books", "SELECT * FROM books")
sql("src1_loans", "SELECT * FROM loans")
ORACLES["src2_load_by_format"] = (
    "SELECT o_orderstatus, COUNT(*) AS n, MAX(o_orderdate) AS last_order "
    "FROM orders GROUP BY o_orderstatus"
)
sql(
    "snk3_published_views",
    """
    SELECT o.program, COUNT(*) AS overdue, MAX(o.days_overdue) AS worst,
           COUNT(DISTINCT i.section) AS sections
    FROM overdue_loans o JOIN book_inventory i USING (book_id) GROUP BY o.program
    """,
)


def student_checks(last_year: int) -> list[tuple[str, str]]:
    return [
        ("student_number_missing", "student_number IS NULL"),
        ("first_name_missing", "first_name IS NULL"),
        ("last_name_missing", "last_name IS NULL"),
        ("email_missing", "email IS NULL"),
        ("student_number_too_long", "length(student_number) > 20"),
        ("first_name_too_long", "length(first_name) > 100"),
        ("last_name_too_long", "length(last_name) > 100"),
        ("email_too_long", "length(email) > 255"),
        ("phone_too_long", "length(phone) > 20"),
        ("program_too_long", "length(program) > 100"),
        ("status_too_long", "length(status) > 20"),
        ("student_number_format", "NOT regexp_matches(student_number, '^[0-9]{4,20}$')"),
        (
            "email_format",
            r"NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')",
        ),
        ("phone_format", r"NOT regexp_matches(phone, '^[\+]?[0-9\-\s\(\)]{7,20}$')"),
        ("enrollment_year_range", f"enrollment_year NOT BETWEEN 1900 AND {last_year}"),
        ("names_blank", "length(trim(first_name)) = 0 OR length(trim(last_name)) = 0"),
        ("status_unknown", "status NOT IN ('active', 'inactive', 'graduated')"),
    ]


SHELF_CHECKS = [
    ("location_code_missing", "location_code IS NULL"),
    ("section_missing", "section IS NULL"),
    ("main_topic_missing", "main_topic IS NULL"),
    ("total_capacity_missing", "total_capacity IS NULL"),
    ("location_code_too_long", "length(location_code) > 10"),
    ("section_too_long", "length(section) > 50"),
    ("main_topic_too_long", "length(main_topic) > 100"),
    ("material_too_long", "length(material) > 50"),
    ("location_code_format", "NOT regexp_matches(location_code, '^[A-Z][0-9]{1,2}$')"),
    ("section_blank", "length(trim(section)) = 0"),
    ("main_topic_blank", "length(trim(main_topic)) = 0"),
    ("total_capacity_not_positive", "total_capacity <= 0"),
    ("current_book_count_range", "current_book_count < 0 OR current_book_count > total_capacity"),
    ("material_unknown", "material NOT IN ('Wood', 'Metal', 'Plastic', 'Glass', 'Composite')"),
]
BOOK_CHECKS = [
    ("title_missing", "title IS NULL"),
    ("author_missing", "author IS NULL"),
    ("isbn_too_long", "length(isbn) > 20"),
    ("title_too_long", "length(title) > 500"),
    ("author_too_long", "length(author) > 300"),
    ("publisher_too_long", "length(publisher) > 200"),
    ("edition_too_long", "length(edition) > 50"),
    ("language_too_long", "length(language) > 50"),
    ("book_type_too_long", "length(book_type) > 20"),
    ("status_too_long", "length(status) > 20"),
    ("isbn_format", "NOT regexp_matches(isbn, '^(97[89])?[0-9]{9}[0-9X]$')"),
    ("title_blank", "length(trim(title)) = 0"),
    ("author_blank", "length(trim(author)) = 0"),
    ("publication_year_range", "publication_year NOT BETWEEN 1000 AND 2002"),
    ("pages_not_positive", "pages <= 0"),
    ("acquisition_in_future", f"acquisition_date > {AS_OF}"),
    ("physical_without_shelf", "book_type <> 'digital' AND shelf_id IS NULL"),
    ("digital_with_shelf", "book_type <> 'physical' AND shelf_id IS NOT NULL"),
    ("book_type_unknown", "book_type NOT IN ('physical', 'digital')"),
    ("status_unknown", "status NOT IN ('available', 'loaned', 'maintenance', 'lost')"),
]
LOAN_CHECKS = [
    ("book_id_missing", "book_id IS NULL"),
    ("student_id_missing", "student_id IS NULL"),
    ("loan_date_missing", "loan_date IS NULL"),
    ("estimated_return_date_missing", "estimated_return_date IS NULL"),
    ("loan_status_too_long", "length(loan_status) > 20"),
    ("loan_date_in_future", f"loan_date > {AS_OF}"),
    ("due_not_after_loan", "estimated_return_date <= loan_date"),
    ("loan_period_too_long", "estimated_return_date > loan_date + 365"),
    ("return_before_loan", "actual_return_date < loan_date"),
    ("renewal_count_negative", "renewal_count < 0"),
    ("returned_without_date", "loan_status = 'returned' AND actual_return_date IS NULL"),
    ("active_with_return_date", "loan_status = 'active' AND actual_return_date IS NOT NULL"),
    ("loan_status_unknown", "loan_status NOT IN ('active', 'returned', 'overdue', 'lost')"),
]


def counted(checks: list[tuple[str, str]], source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS rule, COUNT(*) AS n FROM {source} WHERE {check}"
        for name, check in checks
    )


def first_broken(checks: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {check} THEN '{name}'" for name, check in checks) + " END"


def all_broken(checks: list[tuple[str, str]]) -> str:
    return (
        "list_filter(["
        + ", ".join(f"CASE WHEN {check} THEN '{name}' END" for name, check in checks)
        + "], lambda x: x IS NOT NULL)"
    )


sql(
    "snk1_ingest_students",
    f"""
    SELECT student_id AS seq, row_number() OVER (ORDER BY student_id) AS student_id,
           student_number, status
    FROM (
      SELECT *, row_number() OVER (PARTITION BY student_number ORDER BY student_id) AS a,
             row_number() OVER (PARTITION BY email ORDER BY student_id) AS b
      FROM students WHERE {first_broken(student_checks(2025))} IS NULL)
    WHERE a = 1 AND b = 1
    """,
)
sql(
    "snk1_ingest_shelves",
    f"""
    SELECT seq, reason IS NULL AS accepted, reason FROM (
      SELECT seq, CASE WHEN broken IS NOT NULL THEN broken
                       WHEN row_number() OVER (PARTITION BY location_code, broken IS NULL
                                               ORDER BY seq) > 1
                       THEN 'location_code_taken' END AS reason
      FROM (SELECT seq, location_code, {first_broken(SHELF_CHECKS)} AS broken
            FROM (SELECT * REPLACE (chr(CAST(65 + (shelf_id // 100) % 26 AS INTEGER))
                                    || CAST(shelf_id % 100 AS VARCHAR) AS location_code),
                         shelf_id AS seq FROM shelves)))
    """,
)

sql(
    "snk1_ingest_books",
    """
    SELECT c.seq, g.seq IS NOT NULL AS accepted,
           CASE WHEN g.seq IS NOT NULL THEN NULL
                WHEN c.unplaced IS NOT NULL THEN c.unplaced
                WHEN c.broken IS NOT NULL THEN c.broken
                WHEN w.seq < c.seq THEN 'isbn_taken' ELSE 'shelf_full' END AS reason
    FROM candidates c LEFT JOIN granted g ON c.seq = g.seq
    LEFT JOIN granted w ON c.isbn = w.isbn
    """,
    f"""
candidates AS (
  SELECT b.book_id AS seq, b.isbn, b.shelf_id AS pool, s.total_capacity AS room,
         CASE WHEN b.shelf_id IS NOT NULL AND s.shelf_id IS NULL THEN 'shelf_not_found'
              WHEN s.total_capacity <= 0 THEN 'shelf_full' END AS unplaced,
         b.broken
  FROM (SELECT *, {first_broken(BOOK_CHECKS)} AS broken FROM books) b
  LEFT JOIN shelves s ON b.shelf_id = s.shelf_id
),
rounds AS (
  SELECT 0 AS round, seq, isbn, pool, room, CAST(NULL AS BOOLEAN) AS accepted
  FROM candidates WHERE unplaced IS NULL AND broken IS NULL
  UNION ALL
  SELECT round + 1, seq, isbn, pool, room,
         CASE WHEN accepted IS NOT NULL THEN accepted
              WHEN isbn IS NOT NULL AND taken THEN false
              WHEN pool IS NOT NULL AND held >= room THEN false
              WHEN (isbn IS NULL OR seq = first_seq) AND (pool IS NULL OR held + before < room)
              THEN true END
  FROM (
    SELECT *, MIN(seq) FILTER (accepted IS NULL) OVER (PARTITION BY isbn) AS first_seq,
           COUNT(*) FILTER (accepted) OVER (PARTITION BY isbn) > 0 AS taken,
           COUNT(*) FILTER (accepted) OVER (PARTITION BY pool) AS held,
           COUNT(*) FILTER (accepted IS NULL) OVER (PARTITION BY pool ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
           COUNT(*) FILTER (accepted IS NULL) OVER () AS undecided
    FROM rounds)
  WHERE undecided > 0
),
granted AS (
  SELECT seq, isbn FROM rounds WHERE accepted AND round = (SELECT MAX(round) FROM rounds)
)""",
)

# Views

sql("v1_shelf_utilization", "SELECT * FROM shelf_utilization")
sql("v2_book_inventory", "SELECT * FROM book_inventory")
sql("v3_available_books", "SELECT * FROM book_inventory WHERE status = 'available'")
sql("v4_books_by_shelf", "SELECT * FROM books_by_shelf")
ORACLES["v4_books_by_shelf_paged"] = ORACLES["v4_books_by_shelf"].replace("// 10000", "// 7")
sql("v5_active_loans", "SELECT * FROM active_loans")
sql("v6_overdue_loans", "SELECT * FROM overdue_loans")
sql("v7_loan_history", "SELECT * FROM loan_history")

# Lookups and listings

sql(
    "f1_student_by_id",
    "SELECT * FROM students WHERE student_id IN "
    "(SELECT student_id FROM loans WHERE loan_status = 'lost')",
)
sql(
    "f1_student_by_number",
    "SELECT * FROM students WHERE student_number IN "
    "(SELECT concat('20', lpad(CAST(user_id AS VARCHAR), 9, '0')) FROM events)",
)
sql(
    "f1_student_by_email",
    "SELECT * FROM students WHERE email IN (SELECT concat('customer.', "
    "lpad(CAST(user_id AS VARCHAR), 9, '0'), '@example.org') FROM events)",
)
sql(
    "f1_book_by_isbn",
    "SELECT * FROM books WHERE isbn IN "
    "(SELECT isbn FROM books GROUP BY isbn HAVING COUNT(isbn) > 1)",
)
sql(
    "f1_shelf_by_location_code",
    "SELECT * FROM shelves WHERE location_code IN (SELECT concat('Supplier#', "
    "lpad(CAST(event_id % 150 AS VARCHAR), 9, '0')) FROM events)",
)
sql(
    "f2_book_by_id",
    f"""
    SELECT b.*, {PLACE} FROM books b LEFT JOIN shelves s ON b.shelf_id = s.shelf_id
    WHERE b.book_id IN (SELECT book_id FROM loans WHERE loan_status = 'active')
    """,
)
LOAN_PARTIES = """
    SELECT l.*, b.title, b.author, b.isbn, s.student_number, s.first_name, s.last_name{more}
    FROM loans l JOIN books b ON l.book_id = b.book_id
    JOIN students s ON l.student_id = s.student_id WHERE {where}
"""
sql("f3_loan_by_id", LOAN_PARTIES.format(more=", s.email", where="l.loan_status = 'lost'"))
sql("f4_students_active", "SELECT * FROM students WHERE status = 'active'")
sql("f4_shelves_by_section", "SELECT * FROM shelves WHERE section = 'NATION_7'")
BOOKS_PLACED = f"""
    SELECT b.*, {PLACE} FROM books b LEFT JOIN shelves s ON b.shelf_id = s.shelf_id WHERE b.status =
"""
sql("f4_books_by_status", BOOKS_PLACED + "'maintenance'")
FULL = "(SELECT shelf_id FROM shelves WHERE current_book_count = total_capacity)"
sql("f4_books_on_shelf", f"SELECT * FROM books WHERE shelf_id IN {FULL}")
sql(
    "f4_physical_books_on_shelf",
    f"SELECT * FROM books WHERE shelf_id IN {FULL} AND book_type = 'physical'",
)
sql("f5_available_books", "SELECT * FROM book_inventory WHERE status = 'available'")
sql("f5_available_with_shelf", BOOKS_PLACED + "'available'")
sql(
    "f6_search_books",
    "SELECT * FROM book_inventory WHERE title ILIKE '%econ%' OR author ILIKE '%econ%' "
    "OR publisher ILIKE '%econ%' OR isbn ILIKE '%econ%'",
)
sql(
    "f6_search_books_terms",
    "SELECT * FROM book_inventory WHERE title ILIKE '%RED%' OR title ILIKE '%w_dget%'",
)
sql(
    "f7_students_by_name",
    "SELECT * FROM students WHERE first_name ILIKE '%CUSTOMER 0000001%' "
    "OR last_name ILIKE '%CUSTOMER 0000001%' "
    "OR concat(first_name, ' ', last_name) ILIKE '%CUSTOMER 0000001%'",
)
sql("f8_shelves_by_topic", "SELECT * FROM shelf_utilization WHERE main_topic ILIKE '%asia%'")
sql(
    "f8_students_by_program",
    f"SELECT {STUDENT}, program FROM students WHERE program ILIKE '%build%'",
)
sql(
    "f9_inventory_filtered",
    "SELECT * FROM book_inventory WHERE status = 'available' AND book_type = 'physical' "
    "AND author ILIKE '%brand#1%' AND title ILIKE '%e%'",
)
sql(
    "f9_inventory_on_shelves",
    f"SELECT * FROM book_inventory WHERE status = 'loaned' AND shelf_id IN {FULL}",
)
sql("f10_shelves_with_space", "SELECT * FROM shelf_utilization WHERE available_space >= 10")
sql(
    "f11_shelf_has_capacity",
    """
    SELECT r.seq, r.shelf_id, s.current_book_count < s.total_capacity AS has_capacity,
           CASE WHEN s.shelf_id IS NULL THEN 'shelf_not_found' END AS reason
    FROM (SELECT event_id AS seq,
                 event_id % ((SELECT COUNT(*) FROM supplier) + 5) AS shelf_id FROM events) r
    LEFT JOIN shelves s ON r.shelf_id = s.shelf_id
    """,
)
sql(
    "f12_utilization_of_shelves",
    """
    SELECT * FROM shelf_utilization u WHERE current_book_count <>
      (SELECT COUNT(*) FROM books b WHERE b.shelf_id = u.shelf_id AND b.book_type = 'physical')
    """,
)
sql(
    "f12_most_utilized",
    "SELECT location_code, section, main_topic, utilization_percentage AS utilization_percent "
    "FROM shelf_utilization WHERE total_capacity > 0",
)
sql("f12_empty_shelves", "SELECT * FROM shelves WHERE current_book_count = 0")
sql("f12_full_shelves", "SELECT * FROM shelves WHERE current_book_count = total_capacity")
sql("f13_books_of_shelves", f"SELECT * FROM books_by_shelf WHERE shelf_id IN {FULL}")
sql("f14_active_loans", "SELECT * FROM active_loans")
sql(
    "f14_open_loans_with_parties",
    LOAN_PARTIES.format(more="", where=f"l.loan_status IN {OPEN}"),
)
sql("f14_active_loans_of_students", "SELECT * FROM active_loans WHERE email NOT LIKE '%@%.%'")
sql(
    "f14_open_loans_of_students",
    f"""
    SELECT l.*, b.title, b.author, b.isbn FROM loans l JOIN books b ON l.book_id = b.book_id
    WHERE l.loan_status IN {OPEN}
      AND l.student_id IN (SELECT student_id FROM students WHERE status = 'inactive')
    """,
)
sql("f15_overdue_by_due_date", "SELECT * FROM overdue_loans")
sql("f15_overdue_worst_first", "SELECT * FROM overdue_loans")
sql("f16_loan_history", "SELECT * FROM loan_history")
sql("f16_history_of_students", "SELECT * FROM loan_history WHERE email NOT LIKE '%@%.%'")
sql(
    "f16_history_of_books",
    "SELECT * FROM loan_history WHERE book_id IN "
    "(SELECT book_id FROM books WHERE status = 'lost')",
)
sql(
    "f16_loans_of_students",
    """
    SELECT l.*, b.title, b.author, b.isbn FROM loans l JOIN books b ON l.book_id = b.book_id
    WHERE l.student_id IN (SELECT student_id FROM students WHERE status = 'graduated')
    """,
)
sql(
    "f16_loans_of_books",
    """
    SELECT l.*, s.student_number, s.first_name, s.last_name, s.email
    FROM loans l JOIN students s ON l.student_id = s.student_id
    WHERE l.book_id IN (SELECT book_id FROM books WHERE status = 'lost')
    """,
)
sql(
    "f17_books_with_location",
    """
    SELECT book_id, title, author, isbn, status, publication_year, location_code, section,
           shelf_topic AS main_topic
    FROM book_inventory
    """,
)
sql(
    "f18_loans_with_details",
    """
    SELECT loan_id, student_number, first_name || ' ' || last_name AS student_name, book_title,
           book_author AS author, loan_date, estimated_return_date, actual_return_date,
           loan_status, renewal_count, loan_duration AS days_on_loan
    FROM loan_history
    """,
)
sql(
    "f19_active_loan_flags",
    f"""
    SELECT loan_id, student_number, first_name || ' ' || last_name AS student_name,
           book_title AS title, book_author AS author, loan_date, estimated_return_date,
           -days_until_due AS days_overdue,
           CASE WHEN estimated_return_date < {AS_OF} THEN 'OVERDUE' ELSE 'ON TIME' END AS status
    FROM active_loans WHERE loan_status = 'active'
    """,
)
sql(
    "f20_null_filters",
    "SELECT book_id, title, shelf_id FROM books WHERE isbn IS NULL AND shelf_id IS NOT NULL",
)
sql("f21_malformed_emails", "SELECT * FROM students WHERE email NOT LIKE '%@%.%'")
sql(
    "j7_never_loaned",
    """
    SELECT book_id, title, author, status, publication_year
    FROM books b WHERE (SELECT COUNT(*) FROM loans l WHERE l.book_id = b.book_id) = 0
    """,
)
sql(
    "j10_missing_parties",
    """
    SELECT r.*, EXISTS (SELECT 1 FROM books b WHERE b.book_id = r.book_id) AS book_exists,
           EXISTS (SELECT 1 FROM students s WHERE s.student_id = r.student_id) AS student_exists
    FROM (SELECT event_id AS seq, event_id % ((SELECT COUNT(*) FROM part) + 20) AS book_id,
                 event_id * 7 % ((SELECT COUNT(*) FROM customer) + 20) AS student_id
          FROM events) r
    """,
)

# Reports

sql(
    "a1_students_by_program",
    "SELECT program, COUNT(*) AS student_count FROM students GROUP BY program",
)
sql(
    "a1_students_by_year",
    "SELECT enrollment_year, COUNT(*) AS student_count FROM students "
    "WHERE enrollment_year IS NOT NULL GROUP BY enrollment_year",
)
sql("a2_books_by_status", "SELECT status, COUNT(*) AS book_count FROM books GROUP BY status")
sql(
    "a2_books_by_year",
    "SELECT publication_year, COUNT(*) AS book_count FROM books "
    "WHERE publication_year IS NOT NULL GROUP BY publication_year",
)
sql("a2_books_by_language", "SELECT language, COUNT(*) AS book_count FROM books GROUP BY language")
sql(
    "a3_books_per_shelf",
    """
    SELECT shelf_id, section, location_code,
           (SELECT COUNT(*) FROM books WHERE books.shelf_id = shelves.shelf_id) AS book_count
    FROM shelves
    """,
)
sql(
    "a4_shelves_by_section",
    """
    SELECT section, COUNT(*) AS shelf_count,
           CAST(SUM(total_capacity) AS BIGINT) AS total_capacity,
           CAST(SUM(current_book_count) AS BIGINT) AS total_books,
           round(AVG(current_book_count * 100.0::DOUBLE / total_capacity), 2) AS avg_utilization
    FROM shelves GROUP BY section
    """,
)
sql(
    "a5_capacity_report",
    """
    SELECT COUNT(*) AS total_shelves, CAST(SUM(total_capacity) AS BIGINT) AS total_capacity,
           CAST(SUM(current_book_count) AS BIGINT) AS total_books,
           CAST(SUM(available_space) AS BIGINT) AS total_available_space,
           round(AVG(utilization_percentage), 2) AS avg_utilization,
           COUNT(*) FILTER (status = 'Full') AS full_shelves,
           COUNT(*) FILTER (status = 'Nearly Full') AS nearly_full_shelves,
           COUNT(*) FILTER (status = 'Empty') AS empty_shelves
    FROM shelf_utilization
    """,
)
sql(
    "a6_capacity_stats",
    """
    SELECT COUNT(*) AS total_shelves, CAST(SUM(total_capacity) AS BIGINT) AS total_capacity,
           CAST(SUM(current_book_count) AS BIGINT) AS total_books,
           CAST(SUM(total_capacity - current_book_count) AS BIGINT) AS total_available_space,
           round(AVG(current_book_count * 100.0::DOUBLE / total_capacity), 2) AS avg_utilization,
           COUNT(*) FILTER (current_book_count = total_capacity) AS full_shelves,
           COUNT(*) FILTER (current_book_count = 0) AS empty_shelves
    FROM shelves
    """,
)
INVENTORY = """
    SELECT COUNT(*) AS total_books,
           COUNT(*) FILTER (book_type = 'physical') AS physical_books,
           COUNT(*) FILTER (book_type = 'digital') AS digital_books,
           COUNT(*) FILTER (status = 'available') AS available_books,
           COUNT(*) FILTER (status = 'loaned') AS loaned_books,
           COUNT(*) FILTER (status = 'maintenance') AS maintenance_books,
           COUNT(*) FILTER (status = 'lost') AS lost_books
"""
sql("a7_inventory_stats", INVENTORY + "FROM books")
sql(
    "a8_book_statistics",
    INVENTORY
    + """, COUNT(DISTINCT author) AS unique_authors, COUNT(DISTINCT publisher) AS unique_publishers,
           COUNT(DISTINCT language) AS languages, AVG(publication_year) AS avg_publication_year,
           MIN(publication_year) AS oldest_book_year, MAX(publication_year) AS newest_book_year
    FROM books
    """,
)
sql(
    "a9_loan_statistics",
    """
    SELECT COUNT(*) AS total_loans,
           COUNT(*) FILTER (loan_status = 'active') AS active_loans,
           COUNT(*) FILTER (loan_status = 'overdue') AS overdue_loans,
           COUNT(*) FILTER (loan_status = 'returned') AS returned_loans,
           COUNT(*) FILTER (loan_status = 'lost') AS lost_loans,
           AVG(datediff('day', loan_date, actual_return_date)) AS avg_loan_duration,
           COUNT(*) FILTER (actual_return_date > estimated_return_date) AS late_returns,
           AVG(renewal_count) AS avg_renewals
    FROM loans
    """,
)
sql(
    "a10_student_loan_summary",
    f"""
    SELECT student_id,
           (SELECT COUNT(*) FROM loans l WHERE l.student_id = s.student_id) AS total_loans,
           (SELECT COUNT(*) FROM loans l WHERE l.student_id = s.student_id AND loan_status IN {OPEN})
             AS current_loans,
           (SELECT COUNT(*) FROM loans l WHERE l.student_id = s.student_id
              AND loan_status = 'overdue') AS overdue_loans,
           (SELECT COUNT(*) FROM loans l WHERE l.student_id = s.student_id
              AND actual_return_date > estimated_return_date) AS late_returns,
           (SELECT MAX(loan_date) FROM loans l WHERE l.student_id = s.student_id) AS last_loan_date
    FROM students s
    """,
)
sql(
    "a11_loans_by_status",
    "SELECT loan_status, COUNT(*) AS loan_count FROM loans GROUP BY loan_status",
)
sql(
    "a12_loans_by_month",
    """
    SELECT CAST(date_trunc('month', loan_date) AS TIMESTAMP) AS month, COUNT(*) AS loans_created,
           COUNT(*) FILTER (loan_status = 'returned') AS loans_returned,
           COUNT(*) FILTER (loan_status = 'active') AS loans_active,
           COUNT(*) FILTER (loan_status = 'overdue') AS loans_overdue
    FROM loans GROUP BY 1
    """,
)
sql(
    "a13_monthly_report",
    """
    SELECT strftime(loan_date, '%Y-%m') AS month, COUNT(*) AS total_loans,
           COUNT(*) FILTER (loan_status = 'returned') AS returned,
           COUNT(*) FILTER (loan_status = 'active') AS active,
           COUNT(*) FILTER (loan_status = 'overdue') AS overdue
    FROM loans GROUP BY 1
    """,
)
sql(
    "a14_student_history",
    """
    SELECT student_number, concat_ws(' ', first_name, last_name) AS student_name,
           (SELECT COUNT(*) FROM loans l WHERE l.student_id = s.student_id) AS total_loans,
           (SELECT COUNT(*) FROM loans l WHERE l.student_id = s.student_id
              AND loan_status = 'active') AS active_loans,
           (SELECT COUNT(*) FROM loans l WHERE l.student_id = s.student_id AND loan_status = 'returned'
              AND actual_return_date > estimated_return_date) AS late_returns,
           (SELECT MAX(loan_date) FROM loans l WHERE l.student_id = s.student_id) AS last_loan_date
    FROM students s
    """,
)
sql(
    "a15_popular_books",
    """
    SELECT book_id, title, author,
           (SELECT COUNT(*) FROM loans l WHERE l.book_id = b.book_id) AS loan_count,
           (SELECT MAX(loan_date) FROM loans l WHERE l.book_id = b.book_id) AS last_loaned
    FROM books b WHERE loan_count > 0
    ORDER BY loan_count DESC, book_id LIMIT 10
    """,
)
sql(
    "a16_students_with_several_active",
    """
    SELECT s.student_number, s.first_name || ' ' || s.last_name AS student_name,
           h.active_loans, h.page, h.books_on_loan
    FROM (
      SELECT student_id, any_value(active_loans) AS active_loans, page,
             string_agg(title, ', ' ORDER BY title, loan_id) AS books_on_loan
      FROM (
        SELECT a.*, CAST((row_number() OVER (PARTITION BY student_id ORDER BY loan_id) - 1) // 10000
                         AS INTEGER) AS page
        FROM (
          SELECT l.student_id, l.loan_id, b.title,
                 COUNT(*) OVER (PARTITION BY l.student_id) AS active_loans
          FROM loans l JOIN books b ON l.book_id = b.book_id WHERE l.loan_status = 'active') a
        WHERE active_loans > 1)
      GROUP BY student_id, page) h
    JOIN students s ON h.student_id = s.student_id
    """,
)
ORACLES["a16_several_active_paged"] = ORACLES["a16_students_with_several_active"].replace(
    "// 10000", "// 2"
)
sql(
    "a17_average_duration",
    """
    SELECT round(AVG(datediff('day', loan_date, actual_return_date)), 2) AS avg_loan_days,
           COUNT(*) AS returned_loans
    FROM loans WHERE actual_return_date IS NOT NULL
    """,
)
sql(
    "a18_section_popularity",
    """
    SELECT section, main_topic, (
      SELECT COUNT(*) FROM loans WHERE book_id IN (
        SELECT b.book_id FROM books b JOIN shelves s ON b.shelf_id = s.shelf_id
        WHERE s.section = p.section AND s.main_topic = p.main_topic)) AS total_loans
    FROM (SELECT DISTINCT section, main_topic FROM shelves) p WHERE total_loans > 0
    """,
)
sql(
    "a19_duplicate_isbns",
    "SELECT isbn, COUNT(*) AS duplicate_count FROM books WHERE isbn IS NOT NULL "
    "GROUP BY isbn HAVING COUNT(*) > 1",
)
COUNTED_SHELVES = """(
      SELECT *, (SELECT COUNT(*) FROM books b WHERE b.shelf_id = s.shelf_id
                   AND b.book_type = 'physical') AS n FROM shelves s) counted"""
CONSISTENCY = f"""
    SELECT shelf_id, location_code, current_book_count AS recorded_count,
           n AS actual_count, CASE WHEN n = current_book_count THEN 'OK' ELSE 'MISMATCH' END AS status
    FROM {COUNTED_SHELVES}
"""
sql("a20_shelf_consistency", CONSISTENCY)
sql("a21_shelf_mismatches", CONSISTENCY + "WHERE n <> current_book_count")
sql(
    "a22_health",
    """
    SELECT (SELECT COUNT(*) FROM students) AS total_students,
           (SELECT COUNT(*) FROM books WHERE status = 'available') AS available_books,
           COUNT(*) FILTER (loan_status = 'active') AS active_loans,
           COUNT(*) FILTER (loan_status = 'overdue') AS overdue_loans,
           round(100.0::DOUBLE * COUNT(*) FILTER (loan_status = 'overdue') / COUNT(*), 2)
             AS overdue_percentage,
           (SELECT round(100.0::DOUBLE * SUM(current_book_count) / SUM(total_capacity), 2)
            FROM shelves) AS utilization_rate
    FROM loans
    """,
)
sql(
    "u1_table_overview",
    """
    SELECT * FROM (VALUES
      ('students', (SELECT COUNT(*) FROM students)), ('shelves', (SELECT COUNT(*) FROM shelves)),
      ('books', (SELECT COUNT(*) FROM books)), ('loans', (SELECT COUNT(*) FROM loans))
    ) AS overview(table_name, row_count)
    """,
)
sql(
    "u2_orphan_checks",
    """
    SELECT * FROM (VALUES
      ('Orphaned Books (invalid shelf_id)',
       (SELECT COUNT(*) FROM books WHERE shelf_id NOT IN (SELECT shelf_id FROM shelves))),
      ('Orphaned Loans (invalid student_id)',
       (SELECT COUNT(*) FROM loans ANTI JOIN students USING (student_id))),
      ('Orphaned Loans (invalid book_id)',
       (SELECT COUNT(*) FROM loans ANTI JOIN books USING (book_id)))
    ) AS checks(check_type, count)
    """,
)
sql(
    "u2_malformed_email_count",
    "SELECT 'Invalid email formats' AS check_type, COUNT(*) AS count FROM students "
    "WHERE email NOT LIKE '%@%.%'",
)
sql(
    "u3_usage_summary",
    """
    SELECT metric, value FROM (UNPIVOT (
      SELECT CAST(p.n AS VARCHAR) AS "Total Students", CAST(p.active AS VARCHAR) AS "Active Students",
             CAST(b.n AS VARCHAR) AS "Total Books", CAST(b.available AS VARCHAR) AS "Available Books",
             CAST(b.loaned AS VARCHAR) AS "Books on Loan", CAST(s.n AS VARCHAR) AS "Total Shelves",
             CAST(l.active AS VARCHAR) AS "Active Loans", CAST(l.overdue AS VARCHAR) AS "Overdue Loans"
      FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (status = 'active') AS active FROM students) p,
           (SELECT COUNT(*) AS n, COUNT(*) FILTER (status = 'available') AS available,
                   COUNT(*) FILTER (status = 'loaned') AS loaned FROM books) b,
           (SELECT COUNT(*) AS n FROM shelves) s,
           (SELECT COUNT(*) FILTER (loan_status = 'active') AS active,
                   COUNT(*) FILTER (loan_status = 'overdue') AS overdue FROM loans) l
    ) ON COLUMNS(*) INTO NAME metric VALUE value)
    """,
)

# Scalar functions

sql(
    "s3_names_and_nulls",
    """
    SELECT student_id, first_name || '/' || phone AS strict,
           concat(first_name, '/', phone) AS skipping,
           CAST(length(trim(program)) AS INTEGER) AS program_length,
           phone IS DISTINCT FROM '+1-555-0002' AS phone_differs
    FROM students
    """,
)
sql(
    "s11_dates",
    """
    SELECT loan_id, CAST(date_trunc('month', loan_date) AS TIMESTAMP) AS month_start,
           strftime(loan_date, '%Y-%m') AS month_label,
           CAST(year(loan_date) AS INTEGER) AS year, loan_date + 365 AS latest_due
    FROM loans
    """,
)
sql(
    "s15_rows_as_json",
    """
    SELECT book_id, CAST(to_json({'book_id': book_id, 'isbn': isbn, 'title': title,
                                  'pages': pages, 'shelf_id': shelf_id}) AS VARCHAR) AS json
    FROM books
    """,
)
sql(
    "s19_lenient_parsing",
    """
    SELECT loan_id, CASE WHEN loan_id % 4 IN (0, 1) THEN loan_date END AS parsed_date,
           CASE WHEN loan_id % 3 <> 0 THEN renewal_count END AS parsed_count
    FROM loans
    """,
)
# RE2 has no look-ahead: each shape the pattern looks for is tested by itself.
PRINTED_ISBN = r"""regexp_matches(rest, '^(97[89][- ]?)?[0-9]{1,5}[- ]?[0-9]+[- ]?[0-9]+[- ]?[0-9X]$')
             AND (regexp_matches(rest, '^[0-9X]{10}$')
                  OR regexp_matches(rest, '^97[89][0-9]{10}$')
                  OR (regexp_matches(rest, '^([0-9]+[- ]){3}')
                      AND regexp_matches(rest, '^[- 0-9X]{13}$'))
                  OR (regexp_matches(rest, '^([0-9]+[- ]){4}')
                      AND regexp_matches(rest, '^[- 0-9]{17}$')))"""
sql(
    "s21_isbn_and_email_formats",
    rf"""
    SELECT book_id, regexp_replace(isbn, '[-\s]', '', 'g') AS bare_isbn,
           regexp_matches(regexp_replace(isbn, '[-\s]', '', 'g'),
                          '^([0-9]{{9}}[0-9X]|97[89][0-9]{{9}}[0-9X])$') AS intake_isbn,
           {PRINTED_ISBN} AS printed_isbn,
           regexp_matches(isbn, '^(97[89])?[0-9]{{9}}[0-9X]$') AS strict_isbn
    FROM (SELECT book_id, isbn, regexp_replace(isbn, '^(ISBN(-1[03])?:? )?', '') AS rest FROM books)
    """,
)
sql(
    "s23_email_validity",
    r"""
    SELECT student_id, regexp_matches(upper(email),
           '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$', 'i') AS valid_email
    FROM students
    """,
)
sql(
    "s22_due_dates",
    """
    SELECT l.loan_id, l.loan_date + CASE WHEN b.book_type = 'digital' THEN 7 ELSE 14 END AS due
    FROM loans l JOIN books b USING (book_id)
    """,
)

sql(
    "s22_due_date_function",
    """
    SELECT l.loan_id, l.loan_date + CASE WHEN b.book_type = 'digital' THEN 7 ELSE 14 END AS due,
           l.loan_date + 14 AS usual_due
    FROM loans l JOIN books b USING (book_id)
    """,
)
sql(
    "s23_validity_functions",
    rf"""
    SELECT 'email' AS kind, student_id AS id,
           regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}$') AS valid
    FROM students
    UNION ALL SELECT 'isbn', book_id, {PRINTED_ISBN} FROM (
      SELECT book_id, regexp_replace(isbn, '^(ISBN(-1[03])?:? )?', '') AS rest FROM books)
    """,
)
sql(
    "f11_capacity_function",
    """
    SELECT b.book_id, s.current_book_count < s.total_capacity AS has_capacity
    FROM books b JOIN shelves s ON b.shelf_id = s.shelf_id
    """,
)
sql(
    "a20_consistency_function",
    f"""
    SELECT shelf_id, location_code, n AS expected_count, current_book_count AS actual_count,
           CASE WHEN n = current_book_count THEN 'OK' ELSE 'MISMATCH' END AS status
    FROM {COUNTED_SHELVES}
    """,
)

# Data quality

sql("dq_students_strict", counted(student_checks(2002), "students"))
sql("dq_shelves_strict", counted(SHELF_CHECKS, "shelves"))
sql("dq_books_strict", counted(BOOK_CHECKS, "books"))
sql("dq_loans_strict", counted(LOAN_CHECKS, "loans"))


def absent(*columns: str) -> list[tuple[str, str]]:
    return [(f"{c}_required", f"{c} IS NULL OR CAST({c} AS VARCHAR) = ''") for c in columns]


sql(
    "dq_students_intake",
    counted(
        [
            *absent("student_number", "first_name", "last_name", "email"),
            ("digits", "NOT regexp_matches(student_number, '^[0-9]+$')"),
            ("length", "length(COALESCE(student_number, '')) NOT BETWEEN 4 AND 20"),
            ("email", "email <> '' AND NOT contains(email, '@')"),
            ("status", "status NOT IN ('active', 'inactive', 'graduated')"),
            ("year_range", "enrollment_year NOT BETWEEN 1900 AND 2030"),
            ("year_integer", "false"),
        ],
        "students",
    ),
)
sql(
    "dq_shelves_intake",
    counted(
        [
            *absent("location_code", "section", "main_topic"),
            ("total_capacity_required", "COALESCE(total_capacity, 0) = 0"),
            ("location", "NOT regexp_matches(location_code, '^[A-Z][0-9]{1,2}$')"),
            ("section", r"regexp_matches(section, '^\s+$')"),
            ("topic", r"regexp_matches(main_topic, '^\s+$')"),
            ("capacity_positive", "total_capacity <= 0"),
            ("capacity_integer", "false"),
            ("count_negative", "current_book_count < 0"),
            ("count_exceeds", "current_book_count > total_capacity"),
            ("count_integer", "false"),
            ("material", "material NOT IN ('Wood', 'Metal', 'Plastic', 'Glass', 'Composite')"),
        ],
        "shelves",
    ),
)
sql(
    "dq_books_intake",
    counted(
        [
            ("title_required", r"title IS NULL OR regexp_matches(title, '^\s*$')"),
            ("author_required", r"author IS NULL OR regexp_matches(author, '^\s*$')"),
            (
                "isbn",
                r"NOT regexp_matches(regexp_replace(isbn, '[-\s]', '', 'g'), "
                "'^([0-9]{9}[0-9X]|97[89][0-9]{9}[0-9X])$')",
            ),
            ("year_range", "publication_year NOT BETWEEN 1000 AND 2025"),
            ("year_integer", "false"),
            ("pages_positive", "pages <= 0"),
            ("pages_integer", "false"),
            ("type", "book_type NOT IN ('physical', 'digital')"),
            ("status", "status NOT IN ('available', 'loaned', 'maintenance', 'lost')"),
            ("physical", "book_type = 'physical' AND COALESCE(shelf_id, 0) = 0"),
            ("digital", "book_type = 'digital' AND COALESCE(shelf_id, 0) <> 0"),
            ("acquisition", "false"),
        ],
        "books",
    ),
)
sql(
    "dq_loans_intake",
    counted(
        [
            *absent("book_id", "student_id"),
            ("future", f"loan_date > {AS_OF}"),
            ("loan_date", "false"),
            ("due_order", "estimated_return_date <= loan_date"),
            ("period", "datediff('day', loan_date, estimated_return_date) > 365"),
            ("due_date", "false"),
            ("actual_order", "actual_return_date < loan_date"),
            ("actual_date", "false"),
            ("status", "loan_status NOT IN ('active', 'returned', 'overdue', 'lost')"),
            ("returned", "loan_status = 'returned' AND actual_return_date IS NULL"),
            ("active", "loan_status = 'active' AND actual_return_date IS NOT NULL"),
            ("renewals_negative", "renewal_count < 0"),
            ("renewals_integer", "false"),
        ],
        "loans",
    ),
)
sql(
    "dq_books_rejected",
    f"""
    SELECT book_id, CAST(to_json(violations) AS VARCHAR) AS violations
    FROM (SELECT book_id, {all_broken(BOOK_CHECKS)} AS violations FROM books)
    WHERE len(violations) > 0
    """,
)
sql("dq_books_accepted", f"SELECT * FROM books WHERE {first_broken(BOOK_CHECKS)} IS NULL")
sql(
    "dq26_repeated_isbn_rows",
    "SELECT book_id, isbn FROM books WHERE isbn IN "
    "(SELECT isbn FROM books GROUP BY isbn HAVING COUNT(isbn) > 1)",
)
SEVERAL_OPEN = f"""
    SELECT book_id, COUNT(*) AS n FROM loans
    WHERE loan_status IN {OPEN} AND book_id IS NOT NULL GROUP BY book_id HAVING COUNT(*) > 1
"""
sql("dq27_several_open_loans", SEVERAL_OPEN)


def repeats(table: str, column: str) -> str:
    return (
        f"SELECT '{table}.{column}_repeated' AS rule, "
        f"CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n FROM (SELECT COUNT({column}) AS n "
        f"FROM {table} GROUP BY {column} HAVING COUNT({column}) > 1)"
    )


def unknown(table: str, column: str, parent: str, label: str) -> str:
    return (
        f"SELECT '{table}.{label}_unknown' AS rule, COUNT(*) AS n FROM {table} "
        f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {column} FROM {parent})"
    )


sql(
    "dq28_set_checks",
    "\nUNION ALL ".join(
        [
            repeats("students", "student_number"),
            repeats("students", "email"),
            repeats("shelves", "location_code"),
            repeats("books", "isbn"),
            "SELECT 'loans.book_with_several_open_loans' AS rule, "
            f"CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n FROM ({SEVERAL_OPEN})",
            unknown("books", "shelf_id", "shelves", "shelf"),
            unknown("loans", "book_id", "books", "book"),
            unknown("loans", "student_id", "students", "student"),
        ]
    ),
)

# Circulation


def admission(asked: str) -> str:
    """Loans under the ``asked`` condition as requests on a collection without open loans.

    Decided in rounds: every round looks at the state the one before it left.
    """
    return f"""
requests AS (
  SELECT l.loan_id AS seq, l.book_id, l.student_id, l.loan_date, l.estimated_return_date,
         CASE WHEN b.status = 'loaned' THEN 'available' ELSE b.status END AS book_status,
         s.status AS student_status,
         CASE WHEN l.loan_date > {AS_OF} THEN 'loan_date_in_future'
              WHEN l.estimated_return_date <= l.loan_date THEN 'due_not_after_loan'
              WHEN l.estimated_return_date > l.loan_date + 365 THEN 'loan_period_too_long'
         END AS broken
  FROM loans l LEFT JOIN books b ON l.book_id = b.book_id
  LEFT JOIN students s ON l.student_id = s.student_id
  WHERE {asked}
),
rounds AS (
  SELECT 0 AS round, seq, book_id, student_id, CAST(NULL AS BOOLEAN) AS accepted
  FROM requests
  WHERE book_status = 'available' AND student_status = 'active' AND broken IS NULL
  UNION ALL
  SELECT round + 1, seq, book_id, student_id,
         CASE WHEN accepted IS NOT NULL THEN accepted
              WHEN taken OR held >= 5 THEN false
              WHEN seq = first_seq AND held + before < 5 THEN true END
  FROM (
    SELECT *, MIN(seq) FILTER (accepted IS NULL) OVER (PARTITION BY book_id) AS first_seq,
           COUNT(*) FILTER (accepted) OVER (PARTITION BY book_id) > 0 AS taken,
           COUNT(*) FILTER (accepted) OVER (PARTITION BY student_id) AS held,
           COUNT(*) FILTER (accepted IS NULL) OVER (PARTITION BY student_id ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
           COUNT(*) FILTER (accepted IS NULL) OVER () AS undecided
    FROM rounds)
  WHERE undecided > 0
),
granted AS (
  SELECT seq, book_id, student_id FROM rounds
  WHERE accepted AND round = (SELECT MAX(round) FROM rounds)
),
admission AS (
  SELECT r.*, CASE WHEN r.book_status IS NULL THEN 'book_not_found'
                   WHEN r.book_status <> 'available' OR g.seq < r.seq THEN 'book_unavailable'
                   WHEN r.student_status IS NULL THEN 'student_not_found'
                   WHEN r.student_status <> 'active' THEN 'student_inactive'
                   WHEN h.earlier >= 5 THEN 'loan_limit'
                   ELSE r.broken END AS reason
  FROM requests r LEFT JOIN granted g ON r.book_id = g.book_id
  LEFT JOIN (SELECT q.seq, COUNT(*) AS earlier FROM requests q
             JOIN granted e ON q.student_id = e.student_id AND e.seq < q.seq GROUP BY q.seq) h
    ON r.seq = h.seq
)"""


ADMISSION = admission(f"l.loan_status IN {OPEN}")
sql(
    "l1_admit_loans",
    """
    SELECT seq, book_id, student_id, loan_date, estimated_return_date,
           reason IS NULL AS accepted, reason
    FROM admission
    """,
    ADMISSION,
)
sql(
    "l1_admitted_loans",
    f"""
    SELECT seq, (SELECT MAX(loan_id) FROM loans WHERE loan_status NOT IN {OPEN})
             + row_number() OVER (ORDER BY seq) AS loan_id,
           book_id, student_id, 'active' AS loan_status
    FROM admission WHERE reason IS NULL
    """,
    ADMISSION,
)

CLOSING = f"""
closing AS (
  SELECT r.loan_id, MIN(r.seq) AS at, arg_min(r.return_date, r.seq) AS returned
  FROM returns r JOIN loans l USING (loan_id)
  WHERE l.loan_status IN {OPEN} AND r.return_date >= l.loan_date GROUP BY r.loan_id
)"""
batch_sql(
    "l2_returns_result",
    f"""
    SELECT seq, loan_id, return_date, reason IS NULL AS accepted, reason FROM (
      SELECT r.seq, r.loan_id, r.return_date,
             CASE WHEN l.loan_id IS NULL THEN 'loan_not_found'
                  WHEN l.loan_status NOT IN {OPEN} OR c.at < r.seq THEN 'loan_not_open'
                  WHEN r.return_date < l.loan_date THEN 'return_before_loan' END AS reason
      FROM returns r LEFT JOIN loans l ON r.loan_id = l.loan_id
      LEFT JOIN closing c ON r.loan_id = c.loan_id)
    """,
    CLOSING,
)
batch_sql(
    "l2_loans_after_returns",
    f"""
    SELECT l.* REPLACE (
      CASE WHEN c.at IS NULL THEN l.loan_status ELSE 'returned' END AS loan_status,
      COALESCE(c.returned, l.actual_return_date) AS actual_return_date,
      CASE WHEN c.at IS NULL THEN l.updated_at ELSE {MOMENT} END AS updated_at)
    FROM loans l LEFT JOIN closing c ON l.loan_id = c.loan_id
    """,
    CLOSING,
)
RENEWED = """
judged AS (
  SELECT r.seq, r.loan_id, r.new_due,
         CASE WHEN l.loan_id IS NULL THEN 'loan_not_found'
              WHEN l.loan_status <> 'active' THEN 'loan_not_active'
              WHEN r.new_due <= l.loan_date THEN 'due_not_after_loan'
              WHEN r.new_due > l.loan_date + 365 THEN 'loan_period_too_long' END AS reason
  FROM renewals r LEFT JOIN loans l ON r.loan_id = l.loan_id
),
renewed AS (
  SELECT loan_id, CAST(COUNT(*) AS INTEGER) AS times, arg_max(new_due, seq) AS due
  FROM judged WHERE reason IS NULL GROUP BY loan_id
)"""
batch_sql(
    "l3_renewals_result",
    "SELECT seq, loan_id, new_due, reason IS NULL AS accepted, reason FROM judged",
    RENEWED,
)
batch_sql(
    "l3_loans_after_renewals",
    f"""
    SELECT l.* REPLACE (
      COALESCE(n.due, l.estimated_return_date) AS estimated_return_date,
      CAST(l.renewal_count + COALESCE(n.times, 0) AS INTEGER) AS renewal_count,
      CASE WHEN n.times IS NULL THEN l.updated_at ELSE {MOMENT} END AS updated_at)
    FROM loans l LEFT JOIN renewed n ON l.loan_id = n.loan_id
    """,
    RENEWED,
)
JUDGED_STATUSES = """
checked_statuses AS (
  SELECT w.seq, w.loan_id, w.status, l.book_id,
         CASE WHEN l.loan_id IS NULL THEN 'not_found'
              WHEN w.status = 'misplaced' THEN 'status_unknown'
              WHEN w.status = 'returned' AND l.actual_return_date IS NULL
              THEN 'returned_without_date'
              WHEN w.status = 'active' AND l.actual_return_date IS NOT NULL
              THEN 'active_with_return_date' END AS reason
  FROM loan_statuses w LEFT JOIN loans l ON w.loan_id = l.loan_id
),
status_steps AS (
  SELECT *, status IN ('active', 'overdue') AS opens,
         row_number() OVER (PARTITION BY book_id ORDER BY seq) AS step
  FROM checked_statuses WHERE reason IS NULL
),
status_walk(book_id, step, held, seq, good) AS (
  SELECT book_id, 0::BIGINT, list(loan_id) FILTER (loan_status IN ('active', 'overdue')), NULL::BIGINT, true
  FROM loans GROUP BY book_id
  UNION ALL
  SELECT w.book_id, s.step,
         CASE WHEN s.opens AND (w.held IS NULL OR w.held = [] OR w.held = [s.loan_id]) THEN [s.loan_id]
              WHEN s.opens THEN w.held ELSE list_filter(w.held, lambda x: x <> s.loan_id) END,
         s.seq, NOT s.opens OR w.held IS NULL OR w.held = [] OR w.held = [s.loan_id]
  FROM status_walk w JOIN status_steps s ON w.book_id = s.book_id AND s.step = w.step + 1
),
judged_statuses AS (
  SELECT c.seq, c.loan_id, c.status,
         COALESCE(c.reason, CASE WHEN NOT w.good THEN 'book_on_loan' END) AS reason
  FROM checked_statuses c LEFT JOIN status_walk w ON c.seq = w.seq
)"""
batch_sql(
    "l4_loans_after_status",
    f"""
    SELECT l.* REPLACE (
      COALESCE(w.status, l.loan_status) AS loan_status,
      CASE WHEN w.status IS NULL THEN l.updated_at ELSE {MOMENT} END AS updated_at)
    FROM loans l LEFT JOIN (
      SELECT loan_id, arg_max(status, seq) AS status FROM judged_statuses
      WHERE reason IS NULL GROUP BY loan_id) w ON l.loan_id = w.loan_id
    """,
    JUDGED_STATUSES,
)
batch_sql(
    "l4_loan_status_result",
    "SELECT seq, loan_id, status, reason IS NULL AS accepted, reason FROM judged_statuses",
    JUDGED_STATUSES,
)
batch_sql(
    "l4_books_after_status",
    f"""
    SELECT b.* REPLACE (
      COALESCE(w.status, b.status) AS status,
      CASE WHEN w.status IS NULL THEN b.updated_at ELSE {MOMENT} END AS updated_at)
    FROM books b LEFT JOIN (
      SELECT book_id, arg_max(status, seq) AS status FROM book_statuses
      WHERE status <> 'misplaced' GROUP BY book_id) w ON b.book_id = w.book_id
    """,
)
batch_sql(
    "l4_book_status_result",
    """
    SELECT seq, book_id, status, reason IS NULL AS accepted, reason FROM (
      SELECT s.*, CASE WHEN b.book_id IS NULL THEN 'not_found'
                       WHEN s.status = 'misplaced' THEN 'status_unknown' END AS reason
      FROM book_statuses s LEFT JOIN (SELECT book_id FROM books) b ON s.book_id = b.book_id)
    """,
)
TURNS = (
    f"loan_status = 'active' AND actual_return_date IS NULL AND estimated_return_date < {AS_OF}"
)
sql(
    "l5_mark_overdue",
    f"""
    SELECT * REPLACE (
      CASE WHEN {TURNS} THEN 'overdue' ELSE loan_status END AS loan_status,
      CASE WHEN {TURNS} THEN {MOMENT} ELSE updated_at END AS updated_at) FROM loans
    """,
)
sql("l5_overdue_count", f"SELECT COUNT(*) AS updated_count FROM loans WHERE {TURNS}")
batch_sql(
    "l6_book_status_after_returns",
    f"""
    SELECT b.* REPLACE (
      CASE WHEN f.book_id IS NULL THEN b.status ELSE 'available' END AS status,
      CASE WHEN f.book_id IS NULL THEN b.updated_at ELSE {MOMENT} END AS updated_at)
    FROM books b LEFT JOIN (
      SELECT DISTINCT l.book_id FROM closing c JOIN loans l USING (loan_id)) f
      ON b.book_id = f.book_id
    """,
    CLOSING,
)
sql(
    "l6_book_status_from_loans",
    f"""
    SELECT book_id, CASE WHEN book_id IN (SELECT book_id FROM loans WHERE loan_status IN {OPEN})
                         THEN 'loaned' ELSE status END AS status
    FROM books
    """,
)

# Shelving

sql(
    "p1_place_books",
    f"""
    SELECT seq, shelf_id, reason IS NULL AS accepted, reason FROM (
      SELECT seq, shelf_id,
             CASE WHEN needs AND free IS NULL THEN 'shelf_not_found'
                  WHEN needs AND before >= free THEN 'shelf_full'
                  ELSE broken END AS reason
      FROM (
        SELECT p.seq, p.shelf_id, p.broken, p.needs,
               s.total_capacity - s.current_book_count AS free,
               COALESCE(SUM(CASE WHEN broken IS NULL THEN 1 ELSE 0 END) OVER (
                 PARTITION BY p.shelf_id ORDER BY p.seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT book_id AS seq, shelf_id, {first_broken(BOOK_CHECKS)} AS broken,
                     book_type = 'physical' AND shelf_id IS NOT NULL AS needs FROM books) p
        LEFT JOIN shelves s ON p.shelf_id = s.shelf_id))
    """,
)
CHECKED_MOVES = """
checked AS (
  SELECT m.*, b.shelf_id AS old_shelf, s.total_capacity - s.current_book_count AS free,
         CASE WHEN b.book_id IS NULL THEN 'book_not_found'
              WHEN b.book_type <> 'physical' THEN 'book_not_physical'
              WHEN m.shelf_id IS NULL THEN 'shelf_required'
              WHEN s.shelf_id IS NULL THEN 'shelf_not_found' END AS unsound
  FROM moves m LEFT JOIN books b ON m.book_id = b.book_id
  LEFT JOIN shelves s ON m.shelf_id = s.shelf_id
)"""
WALKED = """
line AS (
  SELECT row_number() OVER (ORDER BY seq) AS n, seq, book_id, shelf_id, old_shelf FROM checked WHERE unsound IS NULL
),
-- Row by row: the free places of every shelf, and where the books moved so far are now.
walk(n, seq, room, places, came_from, ok) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT),
         (SELECT map_from_entries(list((CAST(shelf_id AS BIGINT), CAST(total_capacity - current_book_count AS BIGINT)))) FROM shelves),
         CAST(MAP {} AS MAP(BIGINT, BIGINT)), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN)
  UNION ALL
  SELECT n, seq,
         CASE WHEN NOT ok OR spot IS NOT DISTINCT FROM shelf_id THEN room
              WHEN room[spot] IS NULL THEN map_concat(room, MAP {shelf_id: room[shelf_id] - 1})
              ELSE map_concat(room, MAP {shelf_id: room[shelf_id] - 1, spot: room[spot] + 1}) END,
         CASE WHEN ok THEN map_concat(places, MAP {book_id: shelf_id}) ELSE places END, spot, ok
  FROM (
    SELECT *, spot IS NOT DISTINCT FROM shelf_id OR room[shelf_id] > 0 AS ok
    FROM (SELECT l.n, l.seq, CAST(l.book_id AS BIGINT) AS book_id, CAST(l.shelf_id AS BIGINT) AS shelf_id, room, places,
                 COALESCE(places[l.book_id], CAST(l.old_shelf AS BIGINT)) AS spot
          FROM walk w JOIN line l ON l.n = w.n + 1))
),
moved AS (
  SELECT c.seq, c.book_id, c.shelf_id, w.came_from AS old_shelf,
         CASE WHEN c.unsound IS NOT NULL THEN c.unsound WHEN NOT w.ok THEN 'shelf_full' END AS reason
  FROM checked c LEFT JOIN walk w ON c.seq = w.seq
)"""
MOVED = CHECKED_MOVES + "," + WALKED
batch_sql(
    "p2_moves_result",
    "SELECT seq, book_id, shelf_id, reason IS NULL AS accepted, reason FROM moved",
    MOVED,
)
batch_sql(
    "p2_shelves_after_moves",
    """
    SELECT s.* REPLACE (CAST(s.current_book_count
      + (SELECT COUNT(*) FROM moved m WHERE m.reason IS NULL AND m.shelf_id = s.shelf_id)
      - (SELECT COUNT(*) FROM moved m WHERE m.reason IS NULL AND m.old_shelf = s.shelf_id)
      AS INTEGER) AS current_book_count)
    FROM shelves s
    """,
    MOVED,
)
DELTAS = """
deltas AS (
  SELECT shelf_id, CAST(COALESCE(a.n, 0) - COALESCE(b.n, 0) AS BIGINT) AS delta
  FROM (SELECT shelf_id, COUNT(*) AS n FROM reshelved
        WHERE book_type = 'physical' AND shelf_id IS NOT NULL GROUP BY shelf_id) a
  FULL JOIN (SELECT shelf_id, n FROM shelf_sizes) b USING (shelf_id)
  WHERE COALESCE(a.n, 0) <> COALESCE(b.n, 0)
)"""
batch_sql("p3_shelf_deltas", "SELECT * FROM deltas", DELTAS)
batch_sql(
    "p3_apply_shelf_deltas",
    """
    SELECT shelf_id, delta, CASE WHEN reason IS NULL THEN new_count END AS new_count,
           reason IS NULL AS accepted, reason
    FROM (
      SELECT d.*, s.current_book_count + d.delta AS new_count,
             CASE WHEN s.shelf_id IS NULL THEN 'shelf_not_found'
                  WHEN s.current_book_count + d.delta < 0 THEN 'count_negative'
                  WHEN s.current_book_count + d.delta > s.total_capacity THEN 'capacity_exceeded'
             END AS reason
      FROM deltas d LEFT JOIN shelves s ON d.shelf_id = s.shelf_id)
    """,
    DELTAS,
)
sql(
    "p4_fix_capacity_counts",
    f"""
    SELECT s.* REPLACE (CAST((SELECT COUNT(*) FROM books b WHERE b.shelf_id = s.shelf_id
        AND b.book_type = 'physical') AS INTEGER) AS current_book_count, {MOMENT} AS updated_at)
    FROM shelves s
    """,
)

# Changes and audit

PATCHED = f"""
steps AS (
  SELECT p.*, row_number() OVER (PARTITION BY student_id ORDER BY seq) AS n FROM patches p
),
-- Patch by patch: what each student's program and phone are after the nth one.
walk(student_id, n, seq, program, phone, reason) AS (
  SELECT student_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), program, phone, CAST(NULL AS VARCHAR) FROM students
  UNION ALL
  SELECT student_id, n, seq, CASE WHEN reason IS NULL THEN program ELSE was_program END,
         CASE WHEN reason IS NULL THEN phone ELSE was_phone END, reason
  FROM (
    SELECT *, {first_broken(student_checks(2025))} AS reason
    FROM (SELECT s.* REPLACE (p.program AS program, CASE WHEN p.clears_phone THEN NULL ELSE w.phone END AS phone),
                 p.n, p.seq, w.program AS was_program, w.phone AS was_phone
          FROM walk w JOIN steps p ON p.student_id = w.student_id AND p.n = w.n + 1
          JOIN students s ON s.student_id = w.student_id))
)"""
batch_sql(
    "w1_students_after_patches",
    f"""
    SELECT s.* REPLACE (w.program AS program, w.phone AS phone,
                        CASE WHEN w.changed THEN {MOMENT} ELSE s.updated_at END AS updated_at)
    FROM students s JOIN (
      SELECT *, bool_or(n > 0 AND reason IS NULL) OVER (PARTITION BY student_id) AS changed,
             row_number() OVER (PARTITION BY student_id ORDER BY n DESC) AS back
      FROM walk) w ON s.student_id = w.student_id AND w.back = 1
    """,
    PATCHED,
)
batch_sql(
    "w1_patch_result",
    """
    SELECT seq, student_id, reason IS NULL AS updated, reason FROM (
      SELECT p.seq, p.student_id, CASE WHEN w.seq IS NULL THEN 'not_found' ELSE w.reason END AS reason
      FROM patches p LEFT JOIN walk w ON p.seq = w.seq)
    """,
    PATCHED,
)


def value_walk(table: str, key: str, column: str, checks: list) -> str:
    """Patch by patch over ``asked``: who has each asked value, and what the rows patched so far have."""
    return f"""
checked AS (
  SELECT a.seq, a.{key}, a.{column}, s.was, CASE WHEN s.was IS NULL THEN 'not_found' ELSE s.broken END AS unsound
  FROM asked a LEFT JOIN (
    SELECT *, {first_broken(checks)} AS broken
    FROM (SELECT t.* REPLACE (a.{column} AS {column}), a.seq, t.{column} AS was
          FROM {table} t JOIN asked a ON t.{key} = a.{key})) s ON a.seq = s.seq
),
line AS (
  SELECT row_number() OVER (ORDER BY seq) AS n, seq, CAST({key} AS BIGINT) AS k, {column} AS v, was
  FROM checked WHERE unsound IS NULL
),
walk(n, seq, holders, has, ok) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT),
         (SELECT map_from_entries(list((v, k))) FROM (
            SELECT DISTINCT l.v, CAST(t.{key} AS BIGINT) AS k FROM line l LEFT JOIN {table} t ON t.{column} = l.v)),
         CAST(MAP {{}} AS MAP(BIGINT, VARCHAR)), CAST(NULL AS BOOLEAN)
  UNION ALL
  SELECT n, seq,
         CASE WHEN NOT ok OR now = v THEN holders
              WHEN list_contains(map_keys(holders), now)
              THEN map_concat(holders, MAP {{v: k, now: CAST(NULL AS BIGINT)}})
              ELSE map_concat(holders, MAP {{v: k}}) END,
         CASE WHEN ok THEN map_concat(has, MAP {{k: v}}) ELSE has END, ok
  FROM (
    SELECT *, COALESCE(holders[v], k) = k AS ok
    FROM (SELECT l.n, l.seq, l.k, l.v, holders, has, COALESCE(has[l.k], l.was) AS now
          FROM walk w JOIN line l ON l.n = w.n + 1))
),
judged AS (
  SELECT c.*, CASE WHEN unsound IS NOT NULL THEN unsound WHEN NOT w.ok THEN '{column}_taken' END AS reason
  FROM checked c LEFT JOIN walk w ON c.seq = w.seq
)"""


EMAILED = """
asked AS (
  SELECT event_id AS seq, event_id * 7 % ((SELECT COUNT(*) FROM customer) + 20) AS student_id,
         CASE WHEN event_id % 2 = 0
              THEN 'customer.' || lpad(CAST(event_id * 11 % 60 AS VARCHAR), 9, '0') || '@example.org'
              ELSE 'new.' || (event_id % 40) || '@example.org' END AS email
  FROM events
),""" + value_walk("students", "student_id", "email", student_checks(2025))
batch_sql(
    "w1_email_patch_result",
    "SELECT seq, student_id, reason IS NULL AS updated, reason FROM judged",
    EMAILED,
)
batch_sql(
    "w1_emails_after_patches",
    """
    SELECT s.student_id, COALESCE(j.email, s.email) AS email FROM students s
    LEFT JOIN (SELECT student_id, max_by(email, seq) AS email FROM judged
               WHERE reason IS NULL GROUP BY student_id) j ON s.student_id = j.student_id
    """,
    EMAILED,
)
batch_sql(
    "w1_shelf_code_result",
    "SELECT seq, shelf_id, reason IS NULL AS updated, reason FROM judged",
    """
asked AS (
  SELECT event_id AS seq, event_id * 3 % ((SELECT COUNT(*) FROM supplier) + 3) AS shelf_id,
         chr(CAST(65 + event_id % 3 AS INTEGER)) || (event_id % 10) AS location_code
  FROM events
),""" + value_walk("shelves", "shelf_id", "location_code", SHELF_CHECKS),
)
RESHELVED = f"""
asked AS (
  SELECT event_id AS seq, event_id * 3 % ((SELECT COUNT(*) FROM part) + 20) AS book_id,
         event_id * 7 % ((SELECT COUNT(*) FROM supplier) + 5) AS shelf_id
  FROM events
),
checked AS (
  SELECT a.*, b.old_shelf, CASE WHEN b.seq IS NULL THEN 'not_found' WHEN b.broken IS NOT NULL THEN b.broken
         WHEN s.shelf_id IS NULL THEN 'shelf_not_found' END AS unsound
  FROM asked a LEFT JOIN (
    SELECT *, {first_broken(BOOK_CHECKS)} AS broken
    FROM (SELECT t.* REPLACE (a.shelf_id AS shelf_id), a.seq, t.shelf_id AS old_shelf
          FROM books t JOIN asked a ON t.book_id = a.book_id)) b ON a.seq = b.seq
  LEFT JOIN shelves s ON a.shelf_id = s.shelf_id
),""" + WALKED
batch_sql(
    "w1_book_shelf_result",
    "SELECT seq, book_id, reason IS NULL AS updated, reason FROM moved",
    RESHELVED,
)
batch_sql(
    "w1_shelves_after_book_patches",
    """
    SELECT s.shelf_id, CAST(s.current_book_count
      + (SELECT COUNT(*) FROM moved m WHERE m.reason IS NULL AND m.shelf_id = s.shelf_id)
      - (SELECT COUNT(*) FROM moved m WHERE m.reason IS NULL AND m.old_shelf = s.shelf_id)
      AS INTEGER) AS current_book_count
    FROM shelves s
    """,
    RESHELVED,
)
GONE = "(SELECT student_id FROM students WHERE status = 'inactive')"
sql("w2_loans_after_student_delete", f"SELECT * FROM loans WHERE student_id NOT IN {GONE}")
sql(
    "w2_books_after_student_delete",
    f"""
    SELECT book_id, CASE WHEN book_id IN (
        SELECT book_id FROM loans WHERE student_id IN {GONE} AND loan_status IN {OPEN}
          AND book_id IS NOT NULL) THEN 'available' ELSE status END AS status
    FROM books
    """,
)
sql(
    "w2_shelves_after_book_delete",
    """
    SELECT s.* REPLACE (CAST(s.current_book_count - (
        SELECT COUNT(*) FROM books b WHERE b.shelf_id = s.shelf_id AND b.status = 'lost'
          AND b.book_type = 'physical') AS INTEGER) AS current_book_count)
    FROM shelves s
    """,
)
sql(
    "w2_shelf_delete_result",
    """
    SELECT shelf_id, reason IS NULL AS accepted, reason FROM (
      SELECT k.shelf_id,
             CASE WHEN s.shelf_id IS NULL THEN 'shelf_not_found'
                  WHEN s.current_book_count > 0 THEN 'shelf_not_empty'
                  WHEN z.n > 0 THEN 'shelf_holds_books' END AS reason
      FROM (SELECT s_suppkey + CASE WHEN s_suppkey = 0 THEN -1 ELSE 0 END AS shelf_id
            FROM supplier) k
      LEFT JOIN shelves s ON k.shelf_id = s.shelf_id
      LEFT JOIN shelf_sizes z ON k.shelf_id = z.shelf_id)
    """,
)


def loan_json(status: str, updated: str) -> str:
    stamp = "%Y-%m-%dT%H:%M:%S.%g"
    return f"""CAST(to_json({{'loan_id': loan_id, 'book_id': book_id, 'student_id': student_id,
        'loan_date': loan_date, 'estimated_return_date': estimated_return_date,
        'actual_return_date': actual_return_date, 'loan_status': {status},
        'renewal_count': renewal_count, 'notes': notes,
        'created_at': strftime(created_at, '{stamp}'),
        'updated_at': strftime({updated}, '{stamp}')}}) AS VARCHAR)"""


sql(
    "cdc1_audit_overdue",
    f"""
    SELECT 'loans' AS table_name, 'UPDATE' AS operation, loan_id AS row_key,
           {loan_json("loan_status", "updated_at")} AS old_values,
           {loan_json("'overdue'", MOMENT)} AS new_values,
           CAST(NULL AS VARCHAR) AS user_id, {MOMENT} AS timestamp
    FROM loans WHERE {TURNS}
    """,
)
OPERATIONS = """
operations AS (
  SELECT b.book_id AS row_key,
         CASE WHEN r.book_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation
  FROM books b LEFT JOIN reshelved r ON b.book_id = r.book_id
  WHERE r.book_id IS NULL OR b.shelf_id IS DISTINCT FROM r.shelf_id
     OR b.book_type IS DISTINCT FROM r.book_type
)"""
batch_sql("cdc1_audit_books", "SELECT row_key, operation FROM operations", OPERATIONS)
batch_sql(
    "cdc1_audit_log_ids",
    """
    SELECT row_number() OVER (ORDER BY row_key) AS log_id, 'books' AS table_name, operation
    FROM operations
    """,
    OPERATIONS,
)
sql(
    "cdc2_overdue_audit",
    f"""
    SELECT 'loans' AS table_name, 'BATCH_UPDATE' AS operation, CAST(NULL AS BIGINT) AS row_key,
           CAST(NULL AS VARCHAR) AS old_values,
           CAST(to_json({{'updated_count': COUNT(*), 'operation': 'mark_overdue'}}) AS VARCHAR)
             AS new_values,
           CAST(NULL AS VARCHAR) AS user_id, {MOMENT} AS timestamp
    FROM loans WHERE {TURNS}
    """,
)

# Streams

# Each loan is decided on what the accepted loans before it left behind. A loan's own events follow it
# before the next loan comes, so by then a returned one has given back its book and its place, and a
# lost one its place. Undecided loans before it that would keep something leave a loan undecided for
# another round. ``ONE_BY_ONE`` says the same row by row; a test compares the two.
LENT = """
lent AS (
  SELECT 0 AS round, r.seq, r.book_id, r.student_id, l.loan_status <> 'returned' AS keeps_book,
         l.loan_status NOT IN ('returned', 'lost') AS keeps_place, CAST(NULL AS BOOLEAN) AS accepted
  FROM requests r JOIN loans l ON l.loan_id = r.seq
  WHERE r.book_status = 'available' AND r.student_status = 'active' AND r.broken IS NULL
  UNION ALL
  SELECT round + 1, seq, book_id, student_id, keeps_book, keeps_place,
         CASE WHEN accepted IS NOT NULL THEN accepted
              WHEN taken > 0 OR held >= 5 THEN false
              WHEN unsure = 0 AND held + waiting < 5 THEN true END
  FROM (
    SELECT *, COUNT(*) FILTER (accepted AND keeps_book) OVER by_book AS taken,
           COUNT(*) FILTER (accepted IS NULL AND keeps_book) OVER by_book AS unsure,
           COUNT(*) FILTER (accepted AND keeps_place) OVER by_student AS held,
           COUNT(*) FILTER (accepted IS NULL AND keeps_place) OVER by_student AS waiting,
           COUNT(*) FILTER (accepted IS NULL) OVER () AS undecided
    FROM lent
    WINDOW by_book AS (PARTITION BY book_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           by_student AS (PARTITION BY student_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE undecided > 0
)"""
ONE_BY_ONE = """
numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM requests),
decided(n, seq, book_id, student_id, keeps_book, keeps_place, accepted) USING KEY (n) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false, false, false
  UNION
  SELECT n, r.seq, r.book_id, r.student_id, fine AND loan_status <> 'returned',
         fine AND loan_status NOT IN ('returned', 'lost'), fine
  FROM (SELECT *, COALESCE(book_status = 'available' AND student_status = 'active' AND broken IS NULL
                           AND taken = 0 AND held < 5, false) AS fine
        FROM (SELECT q.n, q.seq, q.book_id, q.student_id, q.book_status, q.student_status, q.broken,
                     COUNT(*) FILTER (d.keeps_book AND d.book_id = q.book_id) AS taken,
                     COUNT(*) FILTER (d.keeps_place AND d.student_id = q.student_id) AS held
              FROM numbered q JOIN decided p ON q.n = p.n + 1 CROSS JOIN recurring.decided d GROUP BY ALL)) r
  JOIN loans l ON l.loan_id = r.seq
)"""
REQUESTS = admission("true").split("rounds AS (")[0].rstrip().rstrip(",")
sql(
    "st1_loan_events",
    """
    SELECT l.loan_id, l.book_id, l.student_id, l.actual_return_date,
           CASE WHEN l.loan_status IN ('returned', 'lost') THEN l.loan_status ELSE 'active' END
             AS loan_status,
           CASE WHEN l.renewal_count > 0 THEN 1 ELSE 0 END AS renewal_count,
           l.estimated_return_date + CASE WHEN l.renewal_count > 0 THEN 7 ELSE 0 END
             AS estimated_return_date
    FROM loans l JOIN lent a ON l.loan_id = a.seq
    WHERE a.accepted AND a.round = (SELECT MAX(round) FROM lent)
    """,
    REQUESTS,
    LENT,
)
sql(
    "st2_shelf_counts",
    """
    SELECT shelf_id, CAST(COUNT(*) FILTER (book_id % 5 <> 0) AS BIGINT) AS book_count
    FROM books WHERE book_type = 'physical' AND shelf_id IS NOT NULL GROUP BY shelf_id
    """,
)
