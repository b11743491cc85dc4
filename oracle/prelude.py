"""The collection and its views as common table expressions over the star tables."""

AS_OF = "DATE '2001-08-02'"
MOMENT = "TIMESTAMP '2001-08-02 12:00:00'"

TABLES = """
students AS (
  SELECT c_custkey AS student_id,
         concat('20', substr(c_name, 10)) AS student_number,
         'Customer' AS first_name,
         substr(c_name, 10) AS last_name,
         concat('customer.', substr(c_name, 10),
                CASE WHEN c_custkey % 50 = 0 THEN '_at_example' ELSE '@example.org' END) AS email,
         CASE WHEN c_custkey % 3 = 0 THEN NULL
              WHEN c_custkey % 25 = 1 THEN concat('ext ', c_custkey)
              ELSE concat('+1-555-', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) END AS phone,
         c_mktsegment AS program,
         CAST(2015 + c_custkey % 10 AS INTEGER) AS enrollment_year,
         CASE WHEN c_acctbal < 0 THEN 'inactive' WHEN c_acctbal > 9000 THEN 'graduated'
              ELSE 'active' END AS status,
         TIMESTAMP '2001-01-01 00:00:00' AS created_at,
         TIMESTAMP '2001-01-01 00:00:00' AS updated_at
  FROM customer
),
book_keys AS (
  SELECT *, CASE WHEN p_partkey % 40 = 3 THEN p_partkey - 1 ELSE p_partkey END AS isbn_of
  FROM part
),
book_digits AS (
  SELECT *, lpad(CAST(isbn_of AS VARCHAR), 9, '0') AS digits,
         CASE WHEN isbn_of % 11 = 10 THEN 'X' ELSE CAST(isbn_of % 11 AS VARCHAR) END AS mark
  FROM book_keys
),
books AS (
  SELECT p_partkey AS book_id,
         CASE WHEN p_partkey % 5 = 4 THEN NULL
              WHEN p_partkey % 60 = 7 THEN '978-' || digits || '-' || mark
              ELSE '978' || digits || mark END AS isbn,
         p_name AS title, p_brand AS author, p_type AS publisher,
         CAST(1950 + p_size AS INTEGER) AS publication_year,
         concat(1 + p_partkey % 5, ' ed.') AS edition,
         CASE p_partkey % 4 WHEN 0 THEN 'Spanish' WHEN 1 THEN 'English' WHEN 2 THEN 'French' END
           AS language,
         CAST(CASE WHEN p_partkey % 200 = 0 THEN 0 ELSE 50 + p_partkey % 950 END AS INTEGER)
           AS pages,
         CASE WHEN p_partkey % 10 = 0 THEN 'digital' ELSE 'physical' END AS book_type,
         CASE WHEN p_partkey % 10 = 0 THEN NULL
              ELSE p_partkey % (SELECT COUNT(*) FROM supplier) END AS shelf_id,
         CASE WHEN p_partkey % 97 = 0 THEN 'lost' WHEN p_partkey % 31 = 0 THEN 'maintenance'
              WHEN p_partkey % 3 = 0 THEN 'loaned' ELSE 'available' END AS status,
         DATE '1995-01-01' + CAST(p_partkey % 3000 AS INTEGER) AS acquisition_date,
         TIMESTAMP '2001-01-01 00:00:00' AS created_at,
         TIMESTAMP '2001-01-01 00:00:00' AS updated_at
  FROM book_digits
),
shelf_sizes AS (
  SELECT shelf_id, COUNT(*) AS n FROM books
  WHERE book_type = 'physical' AND shelf_id IS NOT NULL GROUP BY shelf_id
),
shelf_facts AS (
  SELECT s_suppkey AS shelf_id, s_name AS location_code, n_name AS section, r_name AS main_topic,
         CASE s_suppkey % 6 WHEN 0 THEN 'Wood' WHEN 1 THEN 'Metal' WHEN 2 THEN 'Plastic'
              WHEN 3 THEN 'Cardboard' END AS material,
         COALESCE(z.n, 0) + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS recorded
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN shelf_sizes z ON s_suppkey = z.shelf_id
),
shelves AS (
  SELECT shelf_id, location_code, section, main_topic, material,
         CAST(greatest(1, recorded + 5 * (shelf_id % 8)) AS INTEGER) AS total_capacity,
         CAST(recorded AS INTEGER) AS current_book_count,
         TIMESTAMP '2001-01-01 00:00:00' AS created_at,
         TIMESTAMP '2001-01-01 00:00:00' AS updated_at
  FROM shelf_facts
),
first_lines AS (
  SELECT l_orderkey, MIN(l_partkey) AS book_id FROM lineitem GROUP BY l_orderkey
),
loans AS (
  SELECT o_orderkey AS loan_id, book_id, o_custkey AS student_id,
         CAST(o_orderdate AS DATE) AS loan_date,
         CAST(o_orderdate AS DATE) + CASE WHEN book_id % 10 = 0 THEN 7 ELSE 14 END
           AS estimated_return_date,
         CASE WHEN o_orderstatus = 'F'
              THEN CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 30 AS INTEGER) END
           AS actual_return_date,
         CASE WHEN o_orderstatus = 'F' THEN 'returned' WHEN o_orderstatus = 'P' THEN 'active'
              WHEN o_orderkey % 20 = 0 THEN 'lost' ELSE 'overdue' END AS loan_status,
         CAST(o_orderkey % 4 AS INTEGER) AS renewal_count,
         CAST(NULL AS VARCHAR) AS notes,
         TIMESTAMP '2001-01-01 00:00:00' AS created_at,
         TIMESTAMP '2001-01-01 00:00:00' AS updated_at
  FROM orders LEFT JOIN first_lines ON o_orderkey = l_orderkey
)"""

VIEWS = f"""
shelf_utilization AS (
  SELECT shelf_id, location_code, section, main_topic, material, total_capacity,
         current_book_count,
         round(current_book_count * 100.0::DOUBLE / total_capacity, 2) AS utilization_percentage,
         total_capacity - current_book_count AS available_space,
         CASE WHEN current_book_count = 0 THEN 'Empty'
              WHEN current_book_count = total_capacity THEN 'Full'
              WHEN current_book_count * 10 > total_capacity * 8 THEN 'Nearly Full'
              WHEN current_book_count * 10 > total_capacity * 5 THEN 'Half Full'
              ELSE 'Available' END AS status,
         created_at, updated_at
  FROM shelves
),
book_inventory AS (
  SELECT b.book_id, b.isbn, b.title, b.author, b.publisher, b.publication_year, b.edition,
         b.language, b.pages, b.book_type, b.status, b.acquisition_date, b.shelf_id,
         s.location_code, s.section, s.main_topic AS shelf_topic, s.material AS shelf_material,
         CASE WHEN b.book_type = 'digital' THEN 'Digital Collection'
              WHEN b.shelf_id IS NULL THEN 'Unassigned'
              ELSE concat(s.section, ' - ', s.location_code) END AS location,
         CASE b.status WHEN 'available' THEN 'Available' WHEN 'loaned' THEN 'On Loan'
              WHEN 'maintenance' THEN 'Under Maintenance' WHEN 'lost' THEN 'Lost' END
           AS availability_status,
         b.created_at, b.updated_at
  FROM books b LEFT JOIN shelves s USING (shelf_id)
),
paged_books AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY shelf_id ORDER BY book_id) - 1) // 10000 AS INTEGER) AS page
  FROM books WHERE book_type = 'physical' AND shelf_id IS NOT NULL
),
books_by_shelf AS (
  SELECT s.shelf_id, s.location_code, s.section, s.main_topic, s.total_capacity,
         s.current_book_count, COALESCE(z.n, 0) AS actual_book_count,
         COALESCE(g.page, 0) AS page, g.books
  FROM shelves s LEFT JOIN shelf_sizes z USING (shelf_id)
  LEFT JOIN (
    SELECT shelf_id, page,
           CAST(to_json(list({{'book_id': book_id, 'title': title, 'author': author,
                               'status': status}} ORDER BY book_id)) AS VARCHAR) AS books
    FROM paged_books GROUP BY shelf_id, page) g USING (shelf_id)
),
active_loans AS (
  SELECT l.loan_id, l.loan_date, l.estimated_return_date, l.actual_return_date, l.loan_status,
         l.renewal_count, l.notes, l.book_id, b.title AS book_title, b.author AS book_author,
         b.isbn, b.book_type, l.student_id, s.student_number, s.first_name, s.last_name, s.email,
         s.program,
         CAST(CASE WHEN l.loan_status = 'overdue' OR l.estimated_return_date < {AS_OF}
              THEN datediff('day', l.estimated_return_date, {AS_OF}) ELSE 0 END AS INTEGER)
           AS days_overdue,
         CAST(datediff('day', {AS_OF}, l.estimated_return_date) AS INTEGER) AS days_until_due,
         l.created_at, l.updated_at
  FROM loans l JOIN books b USING (book_id) JOIN students s USING (student_id)
  WHERE l.loan_status IN ('active', 'overdue')
),
overdue_loans AS (
  SELECT * FROM active_loans WHERE loan_status = 'overdue' OR estimated_return_date < {AS_OF}
),
loan_history AS (
  SELECT l.loan_id, l.loan_date, l.estimated_return_date, l.actual_return_date, l.loan_status,
         l.renewal_count,
         CAST(datediff('day', l.loan_date, COALESCE(l.actual_return_date, {AS_OF})) AS INTEGER)
           AS loan_duration,
         CAST(CASE WHEN l.actual_return_date > l.estimated_return_date
              THEN datediff('day', l.estimated_return_date, l.actual_return_date) ELSE 0 END
              AS INTEGER) AS days_late,
         l.book_id, b.title AS book_title, b.author AS book_author, b.isbn,
         l.student_id, s.student_number, s.first_name, s.last_name, s.email,
         l.created_at, l.updated_at
  FROM loans l JOIN books b USING (book_id) JOIN students s USING (student_id)
)"""

# Requests of the jobs, derived as in the Spark queries.
BATCHES = """
some_loan AS (
  SELECT event_id AS seq, event_id,
         (event_id * 31 + user_id) % ((SELECT COUNT(*) FROM orders) + 50) AS loan_id
  FROM events
),
returns AS (
  SELECT seq, loan_id,
         CASE WHEN event_id % 10 = 0 THEN DATE '2001-08-02'
              ELSE DATE '2001-01-01' + CAST(event_id % 300 AS INTEGER) END AS return_date
  FROM some_loan
),
renewals AS (
  SELECT seq, loan_id, DATE '2001-03-01' + CAST(event_id % 250 AS INTEGER) AS new_due
  FROM some_loan
),
loan_statuses AS (
  SELECT seq, loan_id,
         CASE event_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'overdue' WHEN 2 THEN 'lost'
              WHEN 3 THEN 'returned' ELSE 'misplaced' END AS status
  FROM some_loan
),
book_statuses AS (
  SELECT event_id AS seq, event_id * 3 % ((SELECT COUNT(*) FROM part) + 20) AS book_id,
         CASE event_id % 5 WHEN 0 THEN 'available' WHEN 1 THEN 'maintenance' WHEN 2 THEN 'lost'
              WHEN 3 THEN 'loaned' ELSE 'misplaced' END AS status
  FROM events
),
moves AS (
  SELECT p_partkey AS seq,
         p_partkey - CASE WHEN p_partkey % 9 = 8 THEN 1 ELSE 0 END AS book_id,
         (p_partkey * 7 + 3) % ((SELECT COUNT(*) FROM supplier) + 1) AS shelf_id
  FROM part
),
reshelved AS (
  SELECT * REPLACE (
    CASE WHEN status = 'maintenance' THEN NULL
         WHEN status = 'loaned' THEN (shelf_id + 1) % (SELECT COUNT(*) FROM supplier)
         ELSE shelf_id END AS shelf_id,
    CASE WHEN status = 'maintenance' THEN 'digital' ELSE book_type END AS book_type)
  FROM books WHERE status <> 'lost'
),
patches AS (
  SELECT event_id AS seq, event_id * 7 % ((SELECT COUNT(*) FROM customer) + 20) AS student_id,
         upper(event_type) AS program, event_id % 3 = 0 AS clears_phone
  FROM events
)"""


def statement(body: str, *more: str) -> str:
    """A full statement: the tables, the views, further expressions, then the body."""
    return "WITH RECURSIVE " + ",".join([TABLES, VIEWS, *more]) + "\n" + body.strip()
