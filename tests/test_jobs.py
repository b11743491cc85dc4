import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, day, frame, rows
from lectern import schemas as S
from lectern.operators import changes, circulation, ingest, patches, quality, shelving
from lectern.operators.admission import grant
from lectern.operators.exclusive import granted_openings
from lectern.operators.running import number_rows, running_total
from lectern.plans.views import physical_books
from lectern.sources.collection import Collection

MOMENT = datetime(2024, 12, 10, 8, 0, 0)


def test_running_total_of_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else f"k{i % 40}", i, rng.randint(0, 3)) for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, seq long, w int").repartition(7)
    found = dict(rows(running_total(df, ["k"], "seq", F.col("w"), "t"), "seq", "t"))
    sums, expected = {}, {}
    for k, seq, w in sorted(data, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + w
        expected[seq] = sums[k]
    assert found == expected


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("seq")).repartition(5)
    found = rows(number_rows(df, "seq", "n"), "seq", "n")
    assert found == [(i, i + 1) for i in range(1000)]


def sequential_grant(requests, room):
    taken, used, granted = set(), {}, set()
    for seq, a, b, pool in sorted(requests):
        keys = {("a", a) if a is not None else None, ("b", b) if b is not None else None} - {None}
        if keys & taken or (pool is not None and used.get(pool, 0) >= room[pool]):
            continue
        taken |= keys
        used[pool] = used.get(pool, 0) + 1
        granted.add(seq)
    return granted


@pytest.mark.parametrize("seed_no", range(2))
@pytest.mark.parametrize("most_room,run", [(None, 7), (5, 20), (5, 100_000)])
def test_grant_equals_one_by_one(spark, seed_no, most_room, run):
    rng = random.Random(seed_no)
    room = {p: rng.randint(0, 5) for p in range(6)}

    def maybe(n, hot):
        if rng.random() < 0.15:
            return None
        return 0 if rng.random() < hot else rng.randrange(n)

    data = [(i, maybe(60, 0.1), maybe(60, 0.1), maybe(6, 0.33)) for i in range(150)]
    df = spark.createDataFrame(
        [(*r, room.get(r[3])) for r in data], "seq long, a int, b int, pool int, room int"
    )
    found = grant(df, ["a", "b"], "pool", "room", most_room, run)
    assert {r.seq for r in found.collect()} == sequential_grant(data, room)


def test_grant_of_a_long_chain(spark):
    """Each of 10,000 requests shares a key with the one before it, so each waits for all before."""
    df = spark.range(10_000).select(
        F.col("id").alias("seq"), F.expr("(id + 1) div 2").alias("a"), F.expr("id div 2").alias("b")
    )
    assert rows(grant(df, ["a", "b"], run=1_000), "seq") == [(i,) for i in range(0, 10_000, 2)]


def sequential_admission(tables, requests, as_of, max_open=5):
    """The one-by-one loop: each request sees what the ones before it did."""
    books = {r.book_id: r for r in tables.books.collect()}
    status = {k: b.status for k, b in books.items()}
    people = {r.student_id: r.status for r in tables.students.collect()}
    held, out = {}, set()
    for l in tables.loans.collect():
        if l.loan_status in ("active", "overdue"):
            held[l.student_id] = held.get(l.student_id, 0) + 1
            out.add(l.book_id)
    decisions = {}
    for r in sorted(requests, key=lambda r: r["seq"]):
        book, student = r.get("book_id"), r.get("student_id")
        opened = r.get("loan_date") or as_of
        due = r.get("estimated_return_date")
        if due is None and book in books:
            due = opened + timedelta(days=7 if books[book].book_type == "digital" else 14)
        if book not in books:
            reason = "book_not_found"
        elif status[book] != "available":
            reason = "book_unavailable"
        elif student not in people:
            reason = "student_not_found"
        elif people[student] != "active":
            reason = "student_inactive"
        elif held.get(student, 0) >= max_open:
            reason = "loan_limit"
        elif book in out:
            reason = "book_on_loan"
        elif opened > as_of:
            reason = "loan_date_in_future"
        elif due <= opened:
            reason = "due_not_after_loan"
        elif due > opened + timedelta(days=365):
            reason = "loan_period_too_long"
        else:
            reason = None
            status[book] = "loaned"
            out.add(book)
            held[student] = held.get(student, 0) + 1
        decisions[r["seq"]] = (reason, due)
    return decisions, status


def random_library(spark, rng, books=60, students=15, loans=30):
    def pick(n, hot):
        return 1 if rng.random() < hot else rng.randint(1, n)

    made_books = [
        {"book_id": i, "title": "t", "author": "a",
         "book_type": "digital" if i % 7 == 0 else "physical",
         "shelf_id": None if i % 7 == 0 else 1,
         "status": rng.choices(["available", "lost", "maintenance"], [8, 1, 1])[0]}
        for i in range(1, books + 1)
    ]
    made_students = [
        {"student_id": i, "status": rng.choices(["active", "inactive"], [6, 1])[0]}
        for i in range(1, students + 1)
    ]
    made_loans = [
        {"loan_id": i, "book_id": rng.randint(1, books), "student_id": pick(students, 0.1),
         "loan_date": day("2024-11-01"), "estimated_return_date": day("2024-11-15"),
         "loan_status": rng.choice(["active", "overdue", "returned", "lost"]), "renewal_count": 0}
        for i in range(1, loans + 1)
    ]
    requests = []
    for i in range(120):
        r = {"seq": i * 3, "book_id": pick(books + 3, 0.2), "student_id": pick(students + 2, 0.33)}
        roll = rng.random()
        if roll < 0.5:
            r["loan_date"] = AS_OF - timedelta(days=rng.randint(-1, 20))
        if roll < 0.3:
            r["estimated_return_date"] = AS_OF + timedelta(days=rng.choice([-30, 5, 20, 400]))
        requests.append(r)
    tables = Collection(
        students=frame(spark, S.STUDENTS, made_students),
        shelves=frame(spark, S.SHELVES, [{"shelf_id": 1, "total_capacity": 99, "current_book_count": 0}]),
        books=frame(spark, S.BOOKS, made_books),
        loans=frame(spark, S.LOANS, made_loans),
    )
    return tables, requests


@pytest.mark.parametrize("seed_no", range(5))
def test_admission_equals_one_by_one(spark, seed_no):
    tables, requests = random_library(spark, random.Random(seed_no))
    expected, status = sequential_admission(tables, requests, AS_OF)
    shuffled = frame(spark, S.LOAN_REQUESTS, requests).repartition(5)
    made = circulation.admit_loans(tables, shuffled, AS_OF, moment=MOMENT)
    result = made.result.collect()
    assert {r.seq: r.reason for r in result} == {s: reason for s, (reason, _) in expected.items()}
    assert all(r.estimated_return_date == expected[r.seq][1] for r in result if r.accepted)
    accepted = sorted(s for s, (reason, _) in expected.items() if reason is None)
    assert accepted
    loans = rows(made.loans, "loan_id", "seq")
    assert loans == [(31 + i, s) for i, s in enumerate(accepted)]
    assert made.tables.loans.count() == 30 + len(accepted)
    assert dict(rows(made.tables.books, "book_id", "status")) == status
    opened = made.tables.loans.join(made.loans.select("loan_id"), "loan_id", "left_semi")
    assert quality.several_open_loans(opened).count() == 0


def test_admission_limits(spark, seed):
    """Two requests for one book; a student at four open loans asking for three more."""
    four = frame(
        spark, S.LOANS,
        [{"loan_id": 20 + i, "book_id": 6 + i, "student_id": 5, "loan_date": AS_OF,
          "loan_status": "active"} for i in range(4)],
    )
    tables = seed.with_tables(loans=seed.loans.unionByName(four))
    asked = [(1, 11, 1), (2, 11, 2), (3, 12, 5), (4, 13, 5), (5, 14, 5)]
    requests = frame(
        spark, S.LOAN_REQUESTS, [dict(zip(("seq", "book_id", "student_id"), r)) for r in asked]
    )
    found = dict(rows(circulation.admit_loans(tables, requests, AS_OF).result, "seq", "reason"))
    assert found == {1: None, 2: "book_unavailable", 3: None, 4: "loan_limit", 5: "loan_limit"}
    flat = circulation.admit_loans(tables, requests, AS_OF, flat_due_date=True).loans
    assert {r.estimated_return_date for r in flat.collect()} == {AS_OF + timedelta(days=14)}


def test_returns_first_valid_one_closes(spark, seed):
    asked = [
        (1, 2, day("2024-11-01")), (2, 2, day("2024-12-05")), (3, 2, day("2024-12-06")),
        (4, 1, None), (5, 99, None), (6, 5, None),
    ]
    returns = spark.createDataFrame(asked, S.RETURNS)
    loans, result = circulation.apply_returns(seed.loans, returns, AS_OF, MOMENT)
    assert dict(rows(result, "seq", "reason")) == {
        1: "return_before_loan", 2: None, 3: "loan_not_open", 4: "loan_not_open",
        5: "loan_not_found", 6: None,
    }
    found = {r.loan_id: (r.loan_status, r.actual_return_date, r.updated_at) for r in loans.collect()}
    assert found[2] == ("returned", day("2024-12-05"), MOMENT)
    assert found[5] == ("returned", AS_OF, MOMENT)
    assert found[4] == ("active", None, None)


def test_renewals_count_each_time(spark, seed):
    asked = [
        (1, 4, day("2024-12-20")), (2, 4, day("2024-12-27")), (3, 5, day("2024-12-27")),
        (4, 4, day("2024-11-30")), (5, 4, day("2025-12-02")), (6, 77, AS_OF),
    ]
    loans, result = circulation.renew_loans(seed.loans, spark.createDataFrame(asked, S.RENEWALS))
    assert dict(rows(result, "seq", "reason")) == {
        1: None, 2: None, 3: "loan_not_active", 4: "due_not_after_loan",
        5: "loan_period_too_long", 6: "loan_not_found",
    }
    (four,) = loans.where("loan_id = 4").collect()
    assert (four.estimated_return_date, four.renewal_count) == (day("2024-12-27"), 2)


def test_overdue_marking_and_its_audit_row(seed):
    assert circulation.overdue_count(seed.loans, AS_OF).collect()[0].updated_count == 1
    after = circulation.mark_overdue(seed.loans, AS_OF, MOMENT)
    assert dict(rows(after, "loan_id", "loan_status"))[2] == "overdue"
    assert circulation.overdue_count(after, AS_OF).collect()[0].updated_count == 0
    (row,) = circulation.overdue_audit(seed.loans, AS_OF, MOMENT).collect()
    assert row.new_values == '{"updated_count":1,"operation":"mark_overdue"}'


def test_book_status_from_the_seed_loans(seed):
    opened = circulation.loan_changes(seed.loans.where("false"), seed.loans)
    books = circulation.derive_book_status(seed.books, opened)
    assert rows(books.where("status = 'loaned'"), "book_id") == [(2,), (4,), (5,)]


def test_book_status_transitions(spark, seed):
    schema = "seq long, book_id long, old_status string, new_status string"
    steps = [
        (1, 1, None, "returned"), (1, 2, "active", "returned"), (1, 3, "returned", "overdue"),
        (1, 4, "active", "lost"), (1, 5, "lost", "returned"), (1, 6, "overdue", None),
        (1, 7, "active", "overdue"), (1, 8, None, "active"), (2, 8, "active", "returned"),
        (1, 9, "returned", None),
    ]
    base = seed.books.withColumn("status", F.lit("maintenance"))
    found = dict(rows(circulation.derive_book_status(base, spark.createDataFrame(steps, schema)),
                      "book_id", "status"))
    assert [found[i] for i in range(1, 10)] == [
        "maintenance", "available", "loaned", "lost", "available", "available", "maintenance",
        "available", "maintenance",
    ]


def test_status_setting(spark, seed):
    asked = spark.createDataFrame(
        [(1, 1, "lost"), (2, 1, "maintenance"), (3, 2, "eaten"), (4, 99, "lost")],
        "seq long, book_id long, status string",
    )
    books, result = circulation.set_book_status(seed.books, asked)
    assert dict(rows(books, "book_id", "status"))[1] == "maintenance"
    assert dict(rows(result, "seq", "reason")) == {1: None, 2: None, 3: "status_unknown", 4: "not_found"}
    asked = spark.createDataFrame(
        [(1, 2, "lost"), (2, 2, "returned"), (3, 1, "active"), (4, 1, "lost")],
        "seq long, loan_id long, status string",
    )
    loans, result = circulation.set_loan_status(seed.loans, asked)
    assert dict(rows(result, "seq", "reason")) == {
        1: None, 2: "returned_without_date", 3: "active_with_return_date", 4: None
    }
    found = dict(rows(loans, "loan_id", "loan_status"))
    assert (found[1], found[2], found[4]) == ("lost", "lost", "active")


def test_patches_keep_unique_values_and_references(spark, seed):
    asked = spark.createDataFrame(
        [(1, 2, "reader1@example.org"), (2, 3, "fresh@example.org"), (3, 4, "fresh@example.org"),
         (4, 5, "reader5@example.org"), (5, 77, "x@example.org"), (6, 1, "bad"), (7, 3, "other@example.org"),
         (8, 4, "fresh@example.org"), (9, 4, "bad")],
        "seq long, student_id long, email string",
    )
    after, result = patches.apply_patches(seed, asked, "students", AS_OF)
    found = dict(rows(result, "seq", "reason"))
    assert found.pop(6) == found.pop(9) == "email_format"
    assert found == {1: "email_taken", 2: None, 3: "email_taken", 4: None, 5: "not_found", 7: None, 8: None}
    emails = dict(rows(after.students, "student_id", "email"))
    assert len(set(emails.values())) == 5 and (emails[3], emails[4]) == ("other@example.org", "fresh@example.org")
    moved = spark.createDataFrame([(1, 1, 2), (2, 2, 999999)], "seq long, book_id long, shelf_id long")
    after, result = patches.apply_patches(seed, moved, "books", AS_OF)
    assert dict(rows(result, "book_id", "reason")) == {1: None, 2: "shelf_not_found"}
    before = dict(rows(seed.shelves, "shelf_id", "current_book_count"))
    counts = dict(rows(after.shelves, "shelf_id", "current_book_count"))
    was = dict(rows(seed.books, "book_id", "shelf_id"))[1]
    assert {k: counts[k] - before[k] for k in counts if counts[k] != before[k]} == {was: -1, 2: 1}
    nothing = spark.createDataFrame([(1, 1, "x")], "seq long, book_id long, created_at string")
    assert rows(patches.apply_patches(seed, nothing, "books", AS_OF)[1], "reason") == [("nothing_set",)]
    none, result = patches.apply_patches(seed, asked.limit(0), "students", AS_OF)
    assert result.count() == 0 and rows(none.students) == rows(seed.students)


def patched_books(books, room, batch):
    """Reasons, books and shelf counts after patches of isbn, kind and shelf, one after another."""
    books, room, reasons = {k: dict(v) for k, v in books.items()}, dict(room), {}
    for seq, book, new in batch:
        if book not in books:
            reasons[seq] = "not_found"
            continue
        old = books[book]
        row = {**old, **new}
        spots = [r["shelf_id"] if r["book_type"] == "physical" else None for r in (old, row)]
        reason = None
        if not new:
            reason = "nothing_set"
        elif row["book_type"] == "physical" and row["shelf_id"] is None:
            reason = "physical_without_shelf"
        elif row["book_type"] == "digital" and row["shelf_id"] is not None:
            reason = "digital_with_shelf"
        elif new.get("shelf_id") is not None and new["shelf_id"] not in room:
            reason = "shelf_not_found"
        elif row["isbn"] is not None and any(b["isbn"] == row["isbn"] for k, b in books.items() if k != book):
            reason = "isbn_taken"
        elif spots[1] is not None and spots[0] != spots[1] and room[spots[1]] <= 0:
            reason = "shelf_full"
        reasons[seq] = reason
        if reason is None:
            books[book] = row
            for spot, step in zip(spots, (1, -1), strict=True):
                if spot is not None:
                    room[spot] += step
    return reasons, books, room


@pytest.mark.parametrize("run", [7, 100_000])
def test_patches_equal_the_loop(spark, run):
    rng = random.Random(run)
    codes = [None, *(f"978000000000{i}" for i in range(5))]
    books = {
        i: {"isbn": codes[i] if i < 6 else None, "book_type": "digital" if i % 3 == 0 else "physical",
            "shelf_id": None if i % 3 == 0 else 1 + i % 3}
        for i in range(1, 13)
    }
    full = {s: sum(b["shelf_id"] == s for b in books.values()) for s in (1, 2, 3)}
    spare = {1: 0, 2: 1, 3: 2}
    shelves = frame(spark, S.SHELVES, [
        {"shelf_id": s, "location_code": f"A{s}", "total_capacity": full[s] + spare[s], "current_book_count": full[s]} for s in full])
    table = frame(spark, S.BOOKS, [{"book_id": k, "title": "t", "author": "a", "status": "available", **v} for k, v in books.items()])
    empty = {n: frame(spark, t, []) for n, t in (("students", S.STUDENTS), ("loans", S.LOANS))}
    tables = Collection(books=table, shelves=shelves, **empty)
    batch = []
    for seq in range(1, 61):
        new = {}
        if rng.random() < 0.4:
            new["isbn"] = rng.choice(codes)
        if rng.random() < 0.3:
            new["book_type"] = rng.choice(["physical", "digital"])
        if rng.random() < 0.6:
            new["shelf_id"] = rng.choice([None, 1, 2, 3, 9]) if rng.random() < 0.5 else rng.choice([1, 2, 3])
        batch.append((seq, 1 if rng.random() < 0.3 else rng.randint(1, 13), new))
    reasons, expected, room = patched_books(books, spare, batch)
    asked = spark.createDataFrame(
        [(s, b, n.get("isbn"), n.get("book_type"), n.get("shelf_id"), list(n)) for s, b, n in batch],
        "seq long, book_id long, isbn string, book_type string, shelf_id long, set_fields array<string>",
    )
    after, result = patches.apply_patches(tables, asked, "books", AS_OF, run=run)
    assert dict(rows(result, "seq", "reason")) == reasons
    found = {r.book_id: {"isbn": r.isbn, "book_type": r.book_type, "shelf_id": r.shelf_id} for r in after.books.collect()}
    assert found == expected
    counts = dict(rows(after.shelves, "shelf_id", "current_book_count"))
    assert {s: full[s] + spare[s] - counts[s] for s in counts} == room


def test_openings_equal_the_loop(spark):
    rng = random.Random(12)
    events = [(i, 1 if rng.random() < 0.4 else rng.randint(2, 12), rng.random() < 0.6) for i in range(400)]
    events = [(seq, key, key * 100 + rng.randint(0, 3), opens) for seq, key, opens in events]
    holders = [(1, 100), (2, 200), (3, 300), (3, 301), (4, 499), (5, 502)]
    state, expected = {}, []
    for key, item in holders:
        state.setdefault(key, set()).add(item)
    for seq, key, item, opens in events:
        held = state.setdefault(key, set())
        if not opens:
            held.discard(item)
        elif not held - {item}:
            held.add(item)
            expected.append(seq)
    found = granted_openings(
        spark.createDataFrame(events, "seq long, key long, item long, opens boolean"),
        spark.createDataFrame(holders, "key long, item long"),
    )
    assert [r[0] for r in rows(found)] == expected


def test_one_open_loan_per_book_on_updates(spark, seed):
    lost = frame(
        spark, S.LOANS,
        [{"loan_id": 70, "book_id": 2, "student_id": 5, "loan_date": day("2024-10-01"),
          "loan_status": "lost"}],
    )
    loans = seed.loans.unionByName(lost)
    book = loans.where("loan_status = 'active'").first()
    loans = loans.withColumn(
        "book_id", F.when(F.col("loan_id") == 70, book.book_id).otherwise(F.col("book_id"))
    )
    asked = spark.createDataFrame(
        [(1, 70, "active"), (2, book.loan_id, "lost"), (3, 70, "active"), (4, book.loan_id, "overdue")],
        "seq long, loan_id long, status string",
    )
    after, result = circulation.set_loan_status(loans, asked)
    assert dict(rows(result, "seq", "reason")) == {1: "book_on_loan", 2: None, 3: None, 4: "book_on_loan"}
    assert dict(rows(after, "loan_id", "loan_status"))[70] == "active"


def shelf_case(spark, rng, n=200):
    shelves = [
        {"shelf_id": i, "location_code": f"A{i}", "section": "s", "main_topic": "t",
         "total_capacity": 60 if i == 1 else 12, "current_book_count": rng.randint(0, 12)}
        for i in range(1, 7)
    ]
    placements = []
    for i in range(n):
        kind = rng.choices(["physical", "digital"], [9, 1])[0]
        shelf = 1 if rng.random() < 0.4 else rng.randint(1, 8)
        placements.append(
            {"book_id": None, "title": rng.choices(["t", " "], [9, 1])[0], "author": "a",
             "book_type": kind, "shelf_id": shelf if kind == "physical" else None,
             "isbn": rng.choice([None, f"978{rng.randint(0, 120):09d}0"]), "seq": i}
        )
    tables = Collection(
        students=frame(spark, S.STUDENTS, []), shelves=frame(spark, S.SHELVES, shelves),
        books=frame(spark, S.BOOKS, [
            {"book_id": 5, "isbn": "9780000000030", "title": "t", "author": "a",
             "book_type": "digital", "status": "available"}]),
        loans=frame(spark, S.LOANS, []),
    )
    names = [f.name for f in S.BOOKS]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.BOOKS) + ", seq long"
    df = spark.createDataFrame([tuple(p.get(n) for n in [*names, "seq"]) for p in placements], ddl)
    return tables, shelves, placements, df.repartition(5)


def sequential_placing(shelves, placements, taken=None):
    """One by one; with ``taken`` given, ISBNs have to be new as well."""
    room = {s["shelf_id"]: s["total_capacity"] - s["current_book_count"] for s in shelves}
    decisions = {}
    for p in placements:
        shelf = p["shelf_id"]
        if shelf is not None and shelf not in room:
            reason = "shelf_not_found"
        elif shelf is not None and room[shelf] <= 0:
            reason = "shelf_full"
        elif not p["title"].strip():
            reason = "title_blank"
        elif taken is not None and p["isbn"] in taken:
            reason = "isbn_taken"
        else:
            reason = None
            if shelf is not None:
                room[shelf] -= 1
            if taken is not None and p["isbn"]:
                taken.add(p["isbn"])
        decisions[p["seq"]] = reason
    return decisions


@pytest.mark.parametrize("seed_no", range(3))
def test_placing_equals_one_by_one(spark, seed_no):
    tables, shelves, placements, df = shelf_case(spark, random.Random(seed_no))
    found = dict(rows(shelving.place_books(tables, df, AS_OF), "seq", "reason"))
    assert found == sequential_placing(shelves, placements)


@pytest.mark.parametrize("seed_no", range(3))
def test_ingest_equals_one_by_one(spark, seed_no):
    tables, shelves, placements, df = shelf_case(spark, random.Random(seed_no))
    made = ingest.ingest(tables, df, "books", AS_OF, MOMENT)
    expected = sequential_placing(shelves, placements, {"9780000000030"})
    found = dict(rows(made.result, "seq", "reason"))
    accepted = sorted(s for s, r in expected.items() if r is None)
    assert sorted(s for s, r in found.items() if r is None) == accepted
    # A refused row may have several faults; the one named must be among those the loop could meet.
    assert {found[s] for s in found} <= {None, "shelf_not_found", "shelf_full", "title_blank", "isbn_taken"}
    assert rows(made.accepted, "seq", "book_id") == [(s, 6 + i) for i, s in enumerate(accepted)]
    assert {r.language for r in made.accepted.collect()} == {"Spanish"}
    counts = dict(rows(made.tables.shelves, "shelf_id", "current_book_count"))
    placed = dict(rows(physical_books(made.accepted).groupBy("shelf_id").count()))
    for s in shelves:
        assert counts[s["shelf_id"]] == s["current_book_count"] + placed.get(s["shelf_id"], 0)
        assert counts[s["shelf_id"]] <= s["total_capacity"]


def test_ingest_students(spark, seed):
    new = spark.createDataFrame(
        [(1, "2025001", "A", "B", "x@example.org"), (2, "2025001", "C", "D", "y@example.org"),
         (3, "2025002", "E", "F", "y@example.org"), (4, "2024001", "G", "H", "z@example.org"),
         (5, "2025005", "I", "J", "not an address")],
        "seq long, student_number string, first_name string, last_name string, email string",
    )
    made = ingest.ingest(seed, new, "students", AS_OF, MOMENT)
    assert dict(rows(made.result, "seq", "reason")) == {
        1: None, 2: "student_number_taken", 3: None, 4: "student_number_taken", 5: "email_format"
    }
    assert rows(made.accepted, "student_id", "status", "created_at") == [
        (6, "active", MOMENT), (7, "active", MOMENT)
    ]


def test_moves(spark, seed):
    tight = seed.shelves.withColumn(
        "total_capacity", F.when(F.col("shelf_id") == 2, 4).otherwise(F.col("total_capacity")))
    tables = seed.with_tables(shelves=tight)
    asked = [(1, 1, 2), (2, 2, 2), (3, 1, 3), (4, 3, 1), (5, 99, 1), (6, 4, 77), (7, 5, None), (8, 6, 1)]
    after, result = shelving.move_books(tables, spark.createDataFrame(asked, S.MOVES), MOMENT)
    assert dict(rows(result, "seq", "reason")) == {
        1: None, 2: "shelf_full", 3: None, 4: None, 5: "book_not_found",
        6: "shelf_not_found", 7: "shelf_required", 8: None,
    }
    assert dict(rows(after.shelves, "shelf_id", "current_book_count")) == {1: 5, 2: 2, 3: 3, 4: 2, 5: 2}
    assert rows(after.shelves, "shelf_id", "current_book_count") == rows(
        shelving.fix_capacity_counts(after), "shelf_id", "current_book_count")


@pytest.mark.parametrize("seed_no,hot,n_shelves,run", [(2, 0.3, 3, 3), (5, 0.0, 4, 6), (2, 0.3, 3, 200_000)])
def test_moves_equal_one_by_one(spark, seed_no, hot, n_shelves, run):
    rng = random.Random(seed_no)
    shelf_of = {b: rng.choice([None, *range(n_shelves)]) for b in range(14)}
    free = {s: rng.choice([0, 0, 1, 2]) for s in range(n_shelves)}
    count = {s: list(shelf_of.values()).count(s) for s in free}
    books = [{"book_id": b, "book_type": "physical", "shelf_id": s} for b, s in shelf_of.items()]
    shelves = [{"shelf_id": s, "total_capacity": count[s] + free[s], "current_book_count": count[s]} for s in free]
    empty = Collection(frame(spark, S.STUDENTS, []), frame(spark, S.SHELVES, shelves), frame(spark, S.BOOKS, books), frame(spark, S.LOANS, []))
    asked = [(i, 3 if rng.random() < hot else rng.randrange(14), rng.randrange(n_shelves)) for i in range(24)]
    after, result = shelving.move_books(empty, spark.createDataFrame(rng.sample(asked, 24), S.MOVES), MOMENT, run)
    reasons = {}
    for seq, book, shelf in asked:
        if shelf_of[book] != shelf and not free[shelf]:
            reasons[seq] = "shelf_full"
            continue
        reasons[seq] = None
        if shelf_of[book] != shelf:
            free[shelf] -= 1
            if shelf_of[book] is not None:
                free[shelf_of[book]] += 1
        shelf_of[book] = shelf
    assert dict(rows(result, "seq", "reason")) == reasons and None in reasons.values() and "shelf_full" in reasons.values()
    assert dict(rows(after.books, "book_id", "shelf_id")) == shelf_of
    room = {r.shelf_id: r.total_capacity - r.current_book_count for r in after.shelves.collect()}
    assert room == free


def test_shelf_deltas_agree_with_a_recount(spark, seed):
    after = (
        seed.books.where("book_id <> 3")
        .withColumn("shelf_id", F.when(F.col("book_id") == 6, 5).when(F.col("book_id") == 9, None)
                    .otherwise(F.col("shelf_id")))
        .withColumn("book_type", F.when(F.col("book_id") == 9, "digital").otherwise(F.col("book_type")))
    )
    deltas = shelving.shelf_deltas(seed.books, after)
    assert dict(rows(deltas)) == {1: -1, 2: -1, 3: -1, 5: 1}
    shelves, result = shelving.apply_shelf_deltas(seed.shelves, deltas)
    assert {r.accepted for r in result.collect()} == {True}
    recount = shelving.fix_capacity_counts(seed.with_tables(books=after))
    assert rows(shelves, "shelf_id", "current_book_count") == rows(recount, "shelf_id", "current_book_count")
    bad = spark.createDataFrame([(1, -9), (2, 99), (77, 1)], "shelf_id long, delta long")
    assert dict(rows(shelving.apply_shelf_deltas(seed.shelves, bad)[1], "shelf_id", "reason")) == {
        1: "count_negative", 2: "capacity_exceeded", 77: "shelf_not_found"
    }


def test_patches(spark, seed):
    asked = spark.createDataFrame(
        [(1, 1, "X", None, ["program"]), (2, 1, "Y", None, ["program"]), (3, 1, "Z", None, ["phone"]),
         (4, 2, None, None, ["program"]), (5, 3, "Q", "1234567", []), (6, 99, "Q", None, ["program"]),
         (7, 4, "P", None, ["program"]), (8, 4, "Q", "call me", ["program", "phone"])],
        "seq long, student_id long, program string, phone string, set_fields array<string>",
    )
    after, result = patches.apply_patches(seed, asked, "students", AS_OF, MOMENT)
    found = {r.student_id: (r.program, r.phone, r.updated_at) for r in after.students.collect()}
    assert found[1] == ("Y", None, MOMENT) and found[2] == (None, None, MOMENT)
    assert found[3] == ("Programme B", None, None) and (found[4][0], found[4][2]) == ("P", MOMENT)
    assert len(found) == 5
    assert rows(result, "seq", "updated", "reason") == [
        (1, True, None), (2, True, None), (3, True, None), (4, True, None), (5, False, "nothing_set"),
        (6, False, "not_found"), (7, True, None), (8, False, "phone_format"),
    ]


def test_deletes(spark, seed):
    keys = spark.createDataFrame([(1,), (4,)], "student_id long")
    loaned = seed.with_tables(books=circulation.derive_book_status(
        seed.books, circulation.loan_changes(seed.loans.where("false"), seed.loans)))
    after = changes.delete_students(loaned, keys, MOMENT)
    assert rows(after.loans, "loan_id") == [(3,), (4,)]
    assert rows(after.books.where("status = 'loaned'"), "book_id") == [(4,)]
    books = spark.createDataFrame([(1,), (6,)], "book_id long")
    after = changes.delete_books(seed, books)
    assert rows(after.loans, "loan_id") == [(2,), (3,), (4,), (5,)]
    assert dict(rows(after.shelves, "shelf_id", "current_book_count")) == {1: 4, 2: 2, 3: 2, 4: 2, 5: 2}
    empty = frame(spark, S.SHELVES, [
        {"shelf_id": 8, "location_code": "Y1", "total_capacity": 3, "current_book_count": 0}])
    more = seed.with_tables(shelves=seed.shelves.unionByName(empty))
    asked = spark.createDataFrame([(1,), (8,), (9,)], "shelf_id long")
    after, result = changes.delete_shelves(more, asked)
    assert dict(rows(result, "shelf_id", "reason")) == {1: "shelf_not_empty", 8: None, 9: "shelf_not_found"}
    assert after.shelves.count() == 5


def test_audit_replay(seed):
    after = (
        circulation.mark_overdue(seed.loans, AS_OF, MOMENT)
        .where("loan_id <> 1")
        .unionByName(seed.loans.where("loan_id = 3").withColumn("loan_id", F.lit(77).cast("long")))
    )
    audit = changes.audit_diff(seed.loans, after, "loans", MOMENT)
    assert rows(audit, "row_key", "operation") == [(1, "DELETE"), (2, "UPDATE"), (77, "INSERT")]
    assert rows(changes.replay_audit(seed.loans, audit, "loans")) == rows(after)
    assert changes.audit_diff(seed.loans, seed.loans, "loans", MOMENT).count() == 0
    log = changes.append_audit(seed.loans.sparkSession.createDataFrame([], S.AUDIT_LOG), audit)
    assert rows(log, "log_id", "operation") == [(1, "DELETE"), (2, "UPDATE"), (3, "INSERT")]


def test_a_long_batch_of_patches_is_judged_once(spark, monkeypatch):
    """Codes go from shelf to shelf, so each patch waits for those before it; some shelves break a rule until mended."""
    shelves = [
        {"shelf_id": s, "location_code": f"A{s}", "section": "" if s % 3 == 0 else "s", "main_topic": "t", "total_capacity": 5,
         "current_book_count": 0}
        for s in range(1, 10)
    ]
    empty = {n: frame(spark, t, []) for n, t in (("students", S.STUDENTS), ("loans", S.LOANS), ("books", S.BOOKS))}
    tables = Collection(shelves=frame(spark, S.SHELVES, shelves), **empty)
    rng = random.Random(5)
    batch = [
        (seq, rng.randint(1, 10), f"A{rng.randint(1, 11)}", rng.choice(["s", "s", "", None]), rng.random() < 0.4)
        for seq in range(1, 81)
    ]
    asked = spark.createDataFrame(
        [(q, s, code, part, ["location_code", "section"] if sets else ["location_code"]) for q, s, code, part, sets in batch],
        "seq long, shelf_id long, location_code string, section string, set_fields array<string>",
    )
    state, expected = {r["shelf_id"]: (r["location_code"], r["section"]) for r in shelves}, {}
    for seq, shelf, code, part, sets in batch:
        if shelf not in state:
            expected[seq] = "not_found"
            continue
        part = part if sets else state[shelf][1]
        taken = any(c == code for s, (c, _) in state.items() if s != shelf)
        expected[seq] = "section_missing" if part is None else "section_blank" if part == "" else "location_code_taken" if taken else None
        if expected[seq] is None:
            state[shelf] = (code, part)
    judged, calls = patches._judged, []
    monkeypatch.setattr(patches, "_judged", lambda *a: calls.append(1) or judged(*a))
    after, result = patches.apply_patches(tables, asked, "shelves", AS_OF, run=2)
    assert dict(rows(result, "seq", "reason")) == expected
    assert {r.shelf_id: (r.location_code, r.section) for r in after.shelves.collect()} == state
    assert len(calls) == 1


def test_a_long_batch_without_values_is_judged_once(spark, seed, monkeypatch):
    student = seed.students.first().student_id
    bad = seed.students.withColumn("phone", F.when(F.col("student_id") == student, "ext").otherwise(F.col("phone")))
    steps = [(1, "p1", None, False), (2, "p2", None, True), (3, "p3", None, False), (4, "p4", "ext", True), (5, "p5", None, False)]
    asked = spark.createDataFrame(
        [(q, student, p, phone, ["program", "phone"] if sets else ["program"]) for q, p, phone, sets in steps],
        "seq long, student_id long, program string, phone string, set_fields array<string>",
    )
    judged, calls = patches._judged, []
    monkeypatch.setattr(patches, "_judged", lambda *a: calls.append(1) or judged(*a))
    after, result = patches.apply_patches(seed.with_tables(students=bad), asked, "students", AS_OF, run=1)
    assert dict(rows(result, "seq", "reason")) == {1: "phone_format", 2: None, 3: None, 4: "phone_format", 5: None}
    assert after.students.where(F.col("student_id") == student).first().program == "p5"
    assert len(calls) == 1


def test_a_long_batch_of_moves_is_bounded_once(spark, monkeypatch):
    """Two shelves, one place: every move waits for the one before it."""
    books = [{"book_id": b, "title": "t", "author": "a", "book_type": "physical", "shelf_id": 1 + b % 2, "status": "available"} for b in range(4)]
    shelves = [{"shelf_id": s, "location_code": f"A{s}", "total_capacity": 2 + (s == 2), "current_book_count": 2} for s in (1, 2)]
    empty = {n: frame(spark, t, []) for n, t in (("students", S.STUDENTS), ("loans", S.LOANS))}
    tables = Collection(books=frame(spark, S.BOOKS, books), shelves=frame(spark, S.SHELVES, shelves), **empty)
    place, room, asked, expected = {b["book_id"]: b["shelf_id"] for b in books}, {1: 0, 2: 1}, [], {}
    rng = random.Random(3)
    for seq in range(1, 41):
        book, shelf = rng.randint(0, 3), rng.randint(1, 2)
        asked.append((seq, book, shelf))
        expected[seq] = place[book] == shelf or room[shelf] > 0
        if expected[seq] and place[book] != shelf:
            room[place[book]], room[shelf], place[book] = room[place[book]] + 1, room[shelf] - 1, shelf
    bounds, calls = shelving._bounds, []
    monkeypatch.setattr(shelving, "_bounds", lambda *a: calls.append(1) or bounds(*a))
    after, result = shelving.move_books(tables, spark.createDataFrame(asked, S.MOVES), MOMENT, 9)
    assert dict(rows(result, "seq", "accepted")) == expected
    assert dict(rows(after.books, "book_id", "shelf_id")) == place
    assert len(calls) == 1
