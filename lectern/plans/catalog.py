"""Every view, listing, report, check and job under a name, over the star schema's collection.

Each query takes the session and the folder of the star tables and returns a DataFrame of plain
columns: decimals as doubles, nested values as JSON text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import formats, text
from lectern.functions.dates import due_date, lenient_date, month_label, month_start
from lectern.functions.documents import row_json, value_json
from lectern.operators import changes, circulation, ingest, lookup, patches, quality, shelving
from lectern.plans import listings, reports, sql_functions, views
from lectern.schemas import AUDIT_LOG
from lectern.session import pin, scratch_path
from lectern.sources import star, star_batches
from lectern.sources.collection import Collection
from lectern.sources.loader import read_table
from lectern.sources.star_batches import StarBatches
from lectern.streaming.ledger import Ledger
from lectern.streaming.loan_events import run_loan_events
from lectern.streaming.shelf_counts import current_counts, run_shelf_counts

AS_OF = star.AS_OF
MOMENT = datetime(2001, 8, 2, 12, 0, 0)
# The star schema's enrollment years lie after its loans.
ENROLLED_BY = date(2024, 12, 10)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and nested columns as JSON text."""
    shown = {}
    for f in df.schema:
        if isinstance(f.dataType, T.DecimalType):
            shown[f.name] = F.col(f.name).cast("double")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            shown[f.name] = value_json(F.col(f.name))
    return df.withColumns(shown) if shown else df


def over_tables(name: str, build: Callable[[Collection], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(build(star.read_star(spark, sf_dir)))


def over_batches(name: str, build: Callable[[Collection, StarBatches], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(
        build(star.read_star(spark, sf_dir), StarBatches(spark, sf_dir))
    )


# Sources, sinks

over_tables("src1_students", lambda t: listings.students(t))
over_tables("src1_shelves", lambda t: listings.shelves(t))
over_tables("src1_books", lambda t: t.books)
over_tables("src1_loans", lambda t: t.loans)


def _loaded_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz"
    loaded = read_table(
        spark, f"{sf_dir}/orders.parquet", T.StructType.fromDDL(schema), fmt="parquet"
    )
    return loaded.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.max("o_orderdate").alias("last_order")
    )


QUERIES["src2_load_by_format"] = _loaded_by_format


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.publish(spark, star.read_star(spark, sf_dir), AS_OF)
    return spark.sql(
        """
        SELECT o.program, COUNT(*) AS overdue, MAX(o.days_overdue) AS worst,
               COUNT(DISTINCT i.section) AS sections
        FROM overdue_loans o JOIN book_inventory i ON o.book_id = i.book_id
        GROUP BY o.program
        """
    )


QUERIES["snk3_published_views"] = _published

over_tables(
    "snk1_ingest_students",
    lambda t: ingest.ingest(
        t.with_tables(students=t.students.where("false")),
        t.students.withColumn("seq", F.col("student_id")),
        "students",
        ENROLLED_BY,
    ).accepted.select("seq", "student_id", "student_number", "status"),
)
over_tables(
    "snk1_ingest_shelves",
    lambda t: ingest.ingest(t, star_batches.new_shelves(t), "shelves", AS_OF).result,
)
over_tables(
    "snk1_ingest_books",
    lambda t: ingest.ingest(
        star_batches.emptied(t), t.books.withColumn("seq", F.col("book_id")), "books", AS_OF
    ).result,
)

# Views

over_tables("v1_shelf_utilization", views.shelf_utilization)
over_tables("v2_book_inventory", views.book_inventory)
over_tables("v3_available_books", views.available_books)
over_tables("v4_books_by_shelf", views.books_by_shelf)
over_tables("v4_books_by_shelf_paged", lambda t: views.books_by_shelf(t, page_size=7))
over_tables("v5_active_loans", lambda t: views.active_loans(t, AS_OF))
over_tables("v6_overdue_loans", lambda t: views.overdue_loans(t, AS_OF))
over_tables("v7_loan_history", lambda t: views.loan_history(t, AS_OF))

# Lookups and listings

over_tables(
    "f1_student_by_id",
    lambda t: lookup.by_key(t.students, t.loans.where("loan_status = 'lost'"), "student_id"),
)
over_batches(
    "f1_student_by_number",
    lambda t, b: lookup.by_key(t.students, b.student_numbers(), "student_number"),
)
over_batches(
    "f1_student_by_email", lambda t, b: lookup.by_key(t.students, b.emails(), "email")
)
over_tables(
    "f1_book_by_isbn", lambda t: lookup.by_key(t.books, reports.duplicate_isbns(t), "isbn")
)
over_batches(
    "f1_shelf_by_location_code",
    lambda t, b: lookup.by_key(t.shelves, b.location_codes(), "location_code"),
)
over_tables(
    "f2_book_by_id", lambda t: lookup.book_by_id(t, t.loans.where("loan_status = 'active'"))
)
over_tables(
    "f3_loan_by_id", lambda t: lookup.loan_by_id(t, t.loans.where("loan_status = 'lost'"))
)
over_tables("f4_students_active", lambda t: listings.students(t, status="active"))
over_tables("f4_shelves_by_section", lambda t: listings.shelves(t, section="NATION_7"))
over_tables("f4_books_by_status", lambda t: listings.books_by_status(t, "maintenance"))
over_tables("f4_books_on_shelf", lambda t: listings.books_on_shelf(t, listings.full_shelves(t)))
over_tables(
    "f4_physical_books_on_shelf",
    lambda t: listings.books_on_shelf(t, listings.full_shelves(t), physical_only=True),
)
over_tables("f5_available_books", lambda t: listings.available_books(t))
over_tables("f5_available_with_shelf", lambda t: listings.books_by_status(t, "available"))
over_tables("f6_search_books", lambda t: listings.search_books(t, "econ"))
over_tables("f6_search_books_terms", lambda t: listings.search_books(t, ["RED", "w_dget"], ("title",)))
over_tables("f7_students_by_name", lambda t: listings.students_by_name(t, "CUSTOMER 0000001"))
over_tables("f8_shelves_by_topic", lambda t: listings.shelves_by_topic(t, "asia"))
over_tables("f8_students_by_program", lambda t: listings.students_by_program(t, "build"))
over_tables(
    "f9_inventory_filtered",
    lambda t: listings.inventory(
        t, status="available", book_type="physical", author="brand#1", title="e"
    ),
)
over_tables(
    "f9_inventory_on_shelves",
    lambda t: listings.inventory(t, status="loaned", shelf_id=listings.full_shelves(t)),
)
over_tables("f10_shelves_with_space", lambda t: listings.shelves_with_space(t, 10))
over_batches("f11_shelf_has_capacity", lambda t, b: lookup.shelf_room(t, b.shelf_requests()))
over_tables(
    "f12_utilization_of_shelves",
    lambda t: listings.shelf_utilization(t, reports.shelf_mismatches(t)),
)
over_tables("f12_most_utilized", lambda t: listings.most_utilized_shelves(t))
over_tables("f12_empty_shelves", listings.empty_shelves)
over_tables("f12_full_shelves", listings.full_shelves)
over_tables(
    "f13_books_of_shelves", lambda t: listings.books_by_shelf(t, listings.full_shelves(t))
)
over_tables("f14_active_loans", lambda t: listings.active_loans(t, AS_OF))
over_tables(
    "f14_open_loans_with_parties",
    lambda t: lookup.loans_with_parties(t, t.loans.where(views.is_open())),
)
over_tables(
    "f14_active_loans_of_students",
    lambda t: listings.active_loans(t, AS_OF, listings.malformed_emails(t)),
)
over_tables(
    "f14_open_loans_of_students",
    lambda t: listings.student_loans(t, t.students.where("status = 'inactive'"), open_only=True),
)
over_tables("f15_overdue_by_due_date", lambda t: listings.overdue_loans(t, AS_OF, worst_first=False))
over_tables("f15_overdue_worst_first", lambda t: listings.overdue_loans(t, AS_OF))
over_tables("f16_loan_history", lambda t: listings.loan_history(t, AS_OF))
over_tables(
    "f16_history_of_students",
    lambda t: listings.loan_history(t, AS_OF, student_id=listings.malformed_emails(t)),
)
over_tables(
    "f16_history_of_books",
    lambda t: listings.loan_history(t, AS_OF, book_id=t.books.where("status = 'lost'")),
)
over_tables(
    "f16_loans_of_students",
    lambda t: listings.student_loans(t, t.students.where("status = 'graduated'")),
)
over_tables(
    "f16_loans_of_books", lambda t: listings.book_loans(t, t.books.where("status = 'lost'"))
)
over_tables("f17_books_with_location", lambda t: listings.books_with_location(t))
over_tables("f18_loans_with_details", lambda t: listings.loans_with_details(t, AS_OF))
over_tables("f19_active_loan_flags", lambda t: listings.active_loan_flags(t, AS_OF))
over_tables(
    "f20_null_filters",
    lambda t: t.books.where(F.col("isbn").isNull() & F.col("shelf_id").isNotNull()).select(
        "book_id", "title", "shelf_id"
    ),
)
over_tables("f21_malformed_emails", listings.malformed_emails)

# Joins of their own

over_tables("j7_never_loaned", lambda t: listings.never_loaned(t))
over_batches(
    "j10_missing_parties", lambda t, b: lookup.missing_parties(t, b.loan_requests_by_event())
)

# Reports

over_tables("a1_students_by_program", reports.students_by_program)
over_tables("a1_students_by_year", reports.students_by_year)
over_tables("a2_books_by_status", reports.books_by_status)
over_tables("a2_books_by_year", reports.books_by_year)
over_tables("a2_books_by_language", reports.books_by_language)
over_tables("a3_books_per_shelf", reports.books_per_shelf)
over_tables("a4_shelves_by_section", reports.shelves_by_section)
over_tables("a5_capacity_report", reports.capacity_report)
over_tables("a6_capacity_stats", reports.capacity_stats)
over_tables("a7_inventory_stats", reports.inventory_stats)
over_tables("a8_book_statistics", reports.book_statistics)
over_tables("a9_loan_statistics", reports.loan_statistics)
over_tables("a10_student_loan_summary", reports.student_loan_summary)
over_tables("a11_loans_by_status", reports.loans_by_status)
over_tables("a12_loans_by_month", reports.loans_by_month)
over_tables("a13_monthly_report", reports.monthly_report)
over_tables("a14_student_history", reports.student_history)
over_tables("a15_popular_books", reports.popular_books)
over_tables("a16_students_with_several_active", reports.students_with_several_active)
over_tables(
    "a16_several_active_paged", lambda t: reports.students_with_several_active(t, page_size=2)
)
over_tables("a17_average_duration", reports.average_duration)
over_tables("a18_section_popularity", reports.section_popularity)
over_tables("a19_duplicate_isbns", reports.duplicate_isbns)
over_tables("a20_shelf_consistency", reports.shelf_consistency)
over_tables("a21_shelf_mismatches", reports.shelf_mismatches)
over_tables("a22_health", reports.health)
over_tables("u1_table_overview", reports.table_overview)
over_tables("u2_orphan_checks", reports.orphan_checks)
over_tables("u2_malformed_email_count", reports.malformed_emails)
over_tables("u3_usage_summary", reports.usage_summary)

# Scalar functions

over_tables(
    "s3_names_and_nulls",
    lambda t: t.students.select(
        "student_id",
        F.concat(F.col("first_name"), F.lit("/"), F.col("phone")).alias("strict"),
        text.joined("first_name", F.lit("/"), "phone").alias("skipping"),
        F.length(F.trim("program")).alias("program_length"),
        (~F.col("phone").eqNullSafe(F.lit("+1-555-0002"))).alias("phone_differs"),
    ),
)
over_tables(
    "s11_dates",
    lambda t: t.loans.select(
        "loan_id",
        month_start("loan_date").alias("month_start"),
        month_label("loan_date").alias("month_label"),
        F.year("loan_date").alias("year"),
        F.date_add("loan_date", 365).alias("latest_due"),
    ),
)
over_tables(
    "s15_rows_as_json",
    lambda t: t.books.select(
        "book_id", row_json(["book_id", "isbn", "title", "pages", "shelf_id"]).alias("json")
    ),
)


def _lenient(t: Collection) -> DataFrame:
    """Dates and numbers as typed by hand: unpadded days, impossible months, words."""
    day = F.col("loan_date")
    typed = (
        F.when(F.col("loan_id") % 4 == 0, F.date_format(day, "yyyy-M-d"))
        .when(F.col("loan_id") % 4 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("loan_id") % 4 == 2, F.date_format(day, "yyyy-'13'-dd"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )
    count = F.when(F.col("loan_id") % 3 == 0, F.lit("many")).otherwise(
        F.concat(F.lit(" "), F.col("renewal_count").cast("string"))
    )
    return t.loans.select(
        "loan_id",
        lenient_date(typed).alias("parsed_date"),
        text.lenient_int(count).alias("parsed_count"),
    )


over_tables("s19_lenient_parsing", _lenient)
over_tables(
    "s21_isbn_and_email_formats",
    lambda t: t.books.select(
        "book_id",
        formats.bare_isbn(F.col("isbn")).alias("bare_isbn"),
        formats.is_intake_isbn(F.col("isbn")).alias("intake_isbn"),
        formats.is_printed_isbn(F.col("isbn")).alias("printed_isbn"),
        F.col("isbn").rlike(formats.ISBN).alias("strict_isbn"),
    ),
)
over_tables(
    "s23_email_validity",
    lambda t: t.students.select(
        "student_id", formats.is_valid_email(F.upper("email")).alias("valid_email")
    ),
)
over_tables(
    "s22_due_dates",
    lambda t: t.loans.join(t.books.select("book_id", "book_type"), "book_id").select(
        "loan_id", due_date(F.col("loan_date"), F.col("book_type")).alias("due")
    ),
)


def from_sql(name: str, statement: str) -> None:
    """A query in SQL over the published tables and functions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for table, df in star.read_star(spark, sf_dir).as_dict().items():
            df.createOrReplaceTempView(table)
        sql_functions.publish_functions(spark)
        return spark.sql(statement)

    QUERIES[name] = run


from_sql(
    "s22_due_date_function",
    """
    SELECT l.loan_id, calculate_estimated_return_date(l.loan_date, b.book_type) AS due,
           calculate_estimated_return_date(l.loan_date) AS usual_due
    FROM loans l JOIN books b ON l.book_id = b.book_id
    """,
)
from_sql(
    "s23_validity_functions",
    """
    SELECT 'email' AS kind, student_id AS id, is_valid_email(email) AS valid FROM students
    UNION ALL SELECT 'isbn', book_id, is_valid_isbn(isbn) FROM books
    """,
)
from_sql(
    "f11_capacity_function",
    """
    SELECT book_id, check_shelf_capacity(shelf_id) AS has_capacity
    FROM books WHERE shelf_id IS NOT NULL
    """,
)
from_sql("a20_consistency_function", "SELECT * FROM validate_shelf_capacity_consistency()")

# Data quality

for _table in ("students", "shelves", "books", "loans"):
    over_tables(
        f"dq_{_table}_strict",
        lambda t, table=_table: quality.summary(
            t.as_dict()[table], quality.strict_rules(table, AS_OF)
        ),
    )
    over_tables(
        f"dq_{_table}_intake",
        lambda t, table=_table: quality.summary(
            as_text(t.as_dict()[table]), quality.intake_rules(table, AS_OF)
        ),
    )


def as_text(df: DataFrame) -> DataFrame:
    """Rows as they would arrive at intake: every column as text."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


over_tables(
    "dq_books_rejected",
    lambda t: quality.split(t.books, quality.strict_rules("books", AS_OF))[1].select(
        "book_id", "violations"
    ),
)
over_tables(
    "dq_books_accepted",
    lambda t: quality.split(t.books, quality.strict_rules("books", AS_OF))[0],
)
over_tables(
    "dq26_repeated_isbn_rows",
    lambda t: quality.repeated_rows(t.books, "isbn").select("book_id", "isbn"),
)
over_tables("dq27_several_open_loans", lambda t: quality.several_open_loans(t.loans))
over_tables("dq28_set_checks", quality.set_checks)

# Circulation


def _admitted(t: Collection) -> circulation.Admission:
    base, requests = star_batches.replayed(t)
    return circulation.admit_loans(base, requests, AS_OF)


over_tables("l1_admit_loans", lambda t: _admitted(t).result)
over_tables(
    "l1_admitted_loans",
    lambda t: _admitted(t).loans.select("seq", "loan_id", "book_id", "student_id", "loan_status"),
)
over_batches(
    "l2_returns_result", lambda t, b: circulation.apply_returns(t.loans, b.returns(), AS_OF)[1]
)
over_batches(
    "l2_loans_after_returns",
    lambda t, b: circulation.apply_returns(t.loans, b.returns(), AS_OF, MOMENT)[0],
)
over_batches("l3_renewals_result", lambda t, b: circulation.renew_loans(t.loans, b.renewals())[1])
over_batches(
    "l3_loans_after_renewals",
    lambda t, b: circulation.renew_loans(t.loans, b.renewals(), MOMENT)[0],
)
over_batches(
    "l4_loans_after_status",
    lambda t, b: circulation.set_loan_status(t.loans, b.loan_statuses(), MOMENT)[0],
)
over_batches(
    "l4_loan_status_result",
    lambda t, b: circulation.set_loan_status(t.loans, b.loan_statuses())[1],
)
over_batches(
    "l4_books_after_status",
    lambda t, b: circulation.set_book_status(t.books, b.book_statuses(), MOMENT)[0],
)
over_batches(
    "l4_book_status_result",
    lambda t, b: circulation.set_book_status(t.books, b.book_statuses())[1],
)
over_tables("l5_mark_overdue", lambda t: circulation.mark_overdue(t.loans, AS_OF, MOMENT))
over_tables("l5_overdue_count", lambda t: circulation.overdue_count(t.loans, AS_OF))


def _books_after_returns(t: Collection, b: StarBatches) -> DataFrame:
    _, result = circulation.apply_returns(t.loans, b.returns(), AS_OF)
    moved = circulation.return_changes(t.loans, result)
    return circulation.derive_book_status(t.books, moved, MOMENT)


over_batches("l6_book_status_after_returns", _books_after_returns)
over_tables(
    "l6_book_status_from_loans",
    lambda t: circulation.derive_book_status(
        t.books, circulation.new_loan_changes(t.loans)
    ).select("book_id", "status"),
)

# Shelving

over_batches(
    "p1_place_books",
    lambda t, b: shelving.place_books(t, b.placements(t), AS_OF).select(
        "seq", "shelf_id", "accepted", "reason"
    ),
)
over_batches("p2_moves_result", lambda t, b: shelving.move_books(t, b.moves())[1])
over_batches("p2_shelves_after_moves", lambda t, b: shelving.move_books(t, b.moves())[0].shelves)
over_batches("p3_shelf_deltas", lambda t, b: shelving.shelf_deltas(t.books, b.reshelved(t)))
over_batches(
    "p3_apply_shelf_deltas",
    lambda t, b: shelving.apply_shelf_deltas(
        t.shelves, shelving.shelf_deltas(t.books, b.reshelved(t))
    )[1],
)
over_tables("p4_fix_capacity_counts", lambda t: shelving.fix_capacity_counts(t, MOMENT))

# Changes and audit

over_batches(
    "w1_students_after_patches",
    lambda t, b: patches.apply_patches(t, b.student_patches(), "students", ENROLLED_BY, MOMENT)[0].students,
)
over_batches(
    "w1_patch_result",
    lambda t, b: patches.apply_patches(t, b.student_patches(), "students", ENROLLED_BY)[1],
)
over_batches(
    "w1_email_patch_result",
    lambda t, b: patches.apply_patches(t, b.email_patches(), "students", ENROLLED_BY)[1],
)
over_batches(
    "w1_emails_after_patches",
    lambda t, b: patches.apply_patches(t, b.email_patches(), "students", ENROLLED_BY)[0].students.select(
        "student_id", "email"
    ),
)
over_batches(
    "w1_shelf_code_result",
    lambda t, b: patches.apply_patches(t, b.code_patches(), "shelves", AS_OF)[1],
)
over_batches(
    "w1_book_shelf_result",
    lambda t, b: patches.apply_patches(t, b.shelf_patches(), "books", AS_OF)[1],
)
over_batches(
    "w1_shelves_after_book_patches",
    lambda t, b: patches.apply_patches(t, b.shelf_patches(), "books", AS_OF)[0].shelves.select(
        "shelf_id", "current_book_count"
    ),
)
over_tables(
    "w2_loans_after_student_delete",
    lambda t: changes.delete_students(t, t.students.where("status = 'inactive'")).loans,
)
over_tables(
    "w2_books_after_student_delete",
    lambda t: changes.delete_students(t, t.students.where("status = 'inactive'")).books.select(
        "book_id", "status"
    ),
)
over_tables(
    "w2_shelves_after_book_delete",
    lambda t: changes.delete_books(t, t.books.where("status = 'lost'")).shelves,
)
over_batches("w2_shelf_delete_result", lambda t, b: changes.delete_shelves(t, b.shelf_keys())[1])
over_tables(
    "cdc1_audit_overdue",
    lambda t: changes.audit_pairs(
        circulation.overdue_pairs(t.loans, AS_OF, MOMENT), "loans", MOMENT
    ),
)
over_batches(
    "cdc1_audit_books",
    lambda t, b: changes.audit_diff(t.books, b.reshelved(t), "books", MOMENT).select(
        "row_key", "operation"
    ),
)
over_batches(
    "cdc1_audit_log_ids",
    lambda t, b: changes.append_audit(
        t.books.sparkSession.createDataFrame([], AUDIT_LOG),
        changes.audit_diff(t.books, b.reshelved(t), "books", MOMENT),
    ).select("log_id", "table_name", "operation"),
)
over_tables("cdc2_overdue_audit", lambda t: circulation.overdue_audit(t.loans, AS_OF, MOMENT))


# Streams


def _loan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star.read_star(spark, sf_dir)
    root = scratch_path(spark, "loan-stream")
    events = pin(star_batches.loan_events(tables))
    # Four parts, one micro-batch each; the cuts fall inside the lives of loans. A large part has several files.
    n, last = events.agg(F.count("*"), F.max("seq")).first()
    last, files = last or 0, -(-n // 4_000_000) or 1
    cuts = [last * i // 4 // 4 * 4 + 1 for i in range(1, 4)]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = events.where(F.lit(True) if low is None else F.col("seq") > low)
        part = part.where(F.lit(True) if high is None else F.col("seq") <= high)
        part = part.repartition(files) if files > 1 else part.coalesce(1)
        part.write.mode("append").parquet(f"{root}/events")
    base, _ = star_batches.replayed(tables)
    ledger = Ledger.start(f"{root}/ledger", base.with_tables(loans=base.loans.where("false")))
    run_loan_events(spark, f"{root}/events", ledger, AS_OF, MOMENT, files_per_batch=files).awaitTermination()
    return ledger.current().loans.select(
        "loan_id",
        "book_id",
        "student_id",
        "actual_return_date",
        "loan_status",
        "renewal_count",
        "estimated_return_date",
    )


QUERIES["st1_loan_events"] = _loan_stream


def _shelf_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "shelf-stream")
    deltas = star_batches.shelf_delta_events(star.read_star(spark, sf_dir))
    deltas.write.parquet(f"{root}/deltas")
    run_shelf_counts(spark, f"{root}/deltas", f"{root}/counts").awaitTermination()
    return current_counts(spark, f"{root}/counts")


QUERIES["st2_shelf_counts"] = _shelf_stream
