from datetime import date

from pyspark.sql import functions as F

from conftest import AS_OF, frame, rows
from lectern import schemas as S
from lectern.operators import lookup
from lectern.plans import listings, reports, views


def test_shelf_utilization(seed):
    found = rows(
        views.shelf_utilization(seed).withColumn("p", F.col("utilization_percentage").cast("double")),
        "location_code", "current_book_count", "p", "status",
    )
    assert found == [
        ("A1", 5, 10.0, "Available"),
        ("A2", 3, 6.67, "Available"),
        ("B1", 2, 5.0, "Available"),
        ("B2", 2, 5.71, "Available"),
        ("C1", 2, 3.33, "Available"),
    ]


def test_bands_are_strict_at_the_thresholds(spark, seed):
    shelves = frame(
        spark, S.SHELVES,
        [{"shelf_id": c, "total_capacity": 10, "current_book_count": c} for c in range(11)],
    )
    bands = dict(rows(views.shelf_utilization(seed.with_tables(shelves=shelves)), "shelf_id", "status"))
    assert bands == {
        0: "Empty", 1: "Available", 2: "Available", 3: "Available", 4: "Available", 5: "Available",
        6: "Half Full", 7: "Half Full", 8: "Half Full", 9: "Nearly Full", 10: "Full",
    }


def test_capacity_reports(seed):
    (report,) = reports.capacity_report(seed).collect()
    (stats,) = reports.capacity_stats(seed).collect()
    for found in (report, stats):
        assert (found.total_shelves, found.total_capacity, found.total_books) == (5, 230, 14)
        assert (found.total_available_space, float(found.avg_utilization)) == (216, 6.14)
        assert (found.full_shelves, found.empty_shelves) == (0, 0)


def test_sections(seed):
    found = [
        (r.section, r.shelf_count, r.total_capacity, r.total_books, float(r.avg_utilization))
        for r in reports.shelves_by_section(seed).collect()
    ]
    assert found == [
        ("Section A", 2, 95, 8, 8.33), ("Section B", 2, 75, 4, 5.36), ("Section C", 1, 60, 2, 3.33)
    ]


def test_inventory_locations(spark, seed):
    extra = frame(
        spark, S.BOOKS,
        [
            {"book_id": 90, "title": "d", "author": "a", "book_type": "digital", "status": "lost"},
            {"book_id": 91, "title": "u", "author": "a", "book_type": "physical", "status": "maintenance"},
        ],
    )
    inventory = views.book_inventory(seed.with_tables(books=seed.books.unionByName(extra)))
    found = dict((r[0], r[1:]) for r in rows(inventory, "book_id", "location", "availability_status"))
    assert found[1] == ("Section A - A1", "Available")
    assert found[90] == ("Digital Collection", "Lost")
    assert found[91] == ("Unassigned", "Under Maintenance")


def test_books_by_shelf_keeps_empty_shelves(spark, seed):
    empty = frame(spark, S.SHELVES, [{"shelf_id": 9, "location_code": "Z9", "total_capacity": 3}])
    tables = seed.with_tables(shelves=seed.shelves.unionByName(empty))
    found = {r.location_code: r for r in views.books_by_shelf(tables).collect()}
    assert found["Z9"].books is None and found["Z9"].actual_book_count == 0
    assert [b.book_id for b in found["A1"].books] == [1, 2, 3, 4, 5]


def test_large_shelf_is_paged_and_whole(seed):
    found = [r for r in views.books_by_shelf(seed, page_size=2).collect() if r.location_code == "A1"]
    assert len(found) > 1 and {r.actual_book_count for r in found} == {5}
    assert len({r.page for r in found}) == len(found)
    assert sorted(b.book_id for r in found for b in r.books) == [1, 2, 3, 4, 5]


def test_active_and_overdue(seed):
    active = rows(views.active_loans(seed, AS_OF), "loan_id", "days_overdue", "days_until_due")
    assert active == [(2, 6, -6), (4, 0, 5), (5, 16, -16)]
    assert rows(views.overdue_loans(seed, AS_OF), "loan_id") == [(2,), (5,)]


def test_overdue_mark_ahead_of_due_date_is_negative(seed):
    early = date(2024, 11, 20)
    found = dict(rows(views.active_loans(seed, early), "loan_id", "days_overdue"))
    assert found[5] == -4 and found[4] == 0


def test_history(seed):
    found = rows(views.loan_history(seed, AS_OF), "loan_id", "loan_duration", "days_late")
    assert found == [(1, 13, 0), (2, 20, 0), (3, 16, 2), (4, 9, 0), (5, 30, 0)]
    ordered = [r.loan_id for r in listings.loan_history(seed, AS_OF).collect()]
    assert ordered == [4, 2, 3, 5, 1]
    assert rows(listings.loan_history(seed, AS_OF, student_id=1), "loan_id") == [(1,), (2,)]
    assert rows(listings.loan_history(seed, AS_OF, book_id=3), "loan_id") == [(3,)]


def test_averages_and_months(seed):
    (mean,) = reports.average_duration(seed).collect()
    assert (float(mean.avg_loan_days), mean.returned_loans) == (14.5, 2)
    assert [tuple(r) for r in reports.monthly_report(seed).collect()] == [
        ("2024-12", 1, 0, 1, 0), ("2024-11", 4, 2, 1, 1)
    ]
    assert [tuple(r)[1:] for r in reports.loans_by_month(seed).collect()] == [
        (1, 0, 1, 0), (4, 2, 1, 1)
    ]


def test_popularity_and_never_loaned(seed):
    assert rows(reports.section_popularity(seed)) == [("Section A", "Computer Science", 5)]
    assert rows(listings.never_loaned(seed), "book_id") == [(i,) for i in range(6, 15)]
    assert [r.book_id for r in reports.popular_books(seed, 3).collect()] == [1, 2, 3]


def test_loans_without_a_book_count_only_where_no_book_is_needed(spark, seed):
    stray = frame(
        spark, S.LOANS,
        [{"loan_id": 50, "student_id": 1, "loan_date": AS_OF, "loan_status": "active"},
         {"loan_id": 51, "student_id": 77, "book_id": 1, "loan_date": AS_OF, "loan_status": "active"}],
    )
    tables = seed.with_tables(loans=seed.loans.unionByName(stray))
    checks = {r.check_type: r["count"] for r in reports.orphan_checks(tables).collect()}
    assert checks == {
        "Orphaned Books (invalid shelf_id)": 0,
        "Orphaned Loans (invalid student_id)": 1,
        "Orphaned Loans (invalid book_id)": 1,
    }
    assert dict(rows(reports.student_history(tables), "student_number", "total_loans"))["2024001"] == 3
    assert rows(reports.students_with_several_active(tables), "student_number") == []


def test_several_active_lists_titles_in_order(spark, seed):
    more = frame(
        spark, S.LOANS,
        [{"loan_id": 60 + i, "student_id": 1, "book_id": b, "loan_date": AS_OF, "loan_status": "active"}
         for i, b in enumerate((9, 7))],
    )
    tables = seed.with_tables(loans=seed.loans.unionByName(more))
    (found,) = reports.students_with_several_active(tables).collect()
    assert (found.active_loans, found.page) == (3, 0)
    assert found.books_on_loan == "Title 02, Title 07, Title 09"
    pages = reports.students_with_several_active(tables, page_size=1).collect()
    assert sorted(t for p in pages for t in p.books_on_loan.split(", ")) == [
        "Title 02", "Title 07", "Title 09"
    ]
    assert {p.active_loans for p in pages} == {3}


def test_summaries_have_zero_rows(seed):
    found = dict((r[0], r[1:5]) for r in rows(reports.student_loan_summary(seed)))
    assert found == {1: (2, 1, 0, 0), 2: (1, 0, 0, 1), 3: (1, 1, 0, 0), 4: (1, 1, 1, 0), 5: (0, 0, 0, 0)}


def test_empty_collection(seed):
    none = seed.with_tables(**{n: d.where("false") for n, d in seed.as_dict().items()})
    (stats,) = reports.book_statistics(none).collect()
    assert (stats.total_books, stats.lost_books, stats.avg_publication_year) == (0, 0, None)
    (health,) = reports.health(none).collect()
    assert (health.total_students, health.overdue_percentage) == (0, None)
    assert reports.average_duration(none).collect()[0].returned_loans == 0
    assert {r.value for r in reports.usage_summary(none).collect()} == {"0"}


def test_search_and_filters(seed):
    assert rows(listings.search_books(seed, "TITLE 03"), "book_id") == [(3,)]
    assert rows(listings.search_books(seed, "title _3", ("title",)), "book_id") == [(3,), (13,)]
    assert rows(listings.search_books(seed, "9780000000040"), "book_id") == [(4,)]
    assert rows(listings.inventory(seed, author="author 1", shelf_id=1), "book_id") == [(1,), (5,)]
    assert listings.inventory(seed, status="", title=None).count() == 14
    assert rows(listings.students_by_name(seed, "first2 last2"), "student_id") == [(2,)]
    assert rows(listings.shelves_with_space(seed, 45), "location_code") == [("A1",), ("C1",)]
    assert [r.location_code for r in listings.shelves_with_space(seed).collect()] == [
        "C1", "A1", "A2", "B1", "B2"
    ]


def test_lookups_answer_a_batch_of_keys(spark, seed):
    keys = spark.createDataFrame([(2,), (2,), (99,)], "book_id long")
    assert rows(lookup.book_by_id(seed, keys), "book_id", "location_code") == [(2, "A1")]
    asked = spark.createDataFrame([(1, 1), (2, 99)], "seq long, shelf_id long")
    assert rows(lookup.shelf_room(seed, asked), "seq", "has_capacity", "reason") == [
        (1, True, None), (2, None, "shelf_not_found")
    ]


def test_published_views_answer_sql(spark, seed):
    names = views.publish(spark, seed, AS_OF)
    assert len(names) == 11
    assert spark.sql("SELECT count(*) AS n FROM overdue_loans").collect()[0].n == 2
