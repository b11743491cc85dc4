"""Loan events against a row-by-row loop, however the stream is cut."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, SMALL, day, frame, rows
from lectern import schemas as S
from lectern.operators.intervals import NEVER, grant_intervals
from lectern.sources.collection import Collection
from lectern.streaming.loan_events import _lives, apply_events
from oracle import statements
from oracle.prelude import statement
from tools.compare import connect

MOMENT = datetime(2024, 12, 10, 8, 0, 0)
OPEN = ("active", "overdue")


class OneByOne:
    """Every event against the state the one before it left."""

    def __init__(self, books, students, loans):
        self.books = {b["book_id"]: b["status"] for b in books}
        self.kinds = {b["book_id"]: b["book_type"] for b in books}
        self.students = {s["student_id"]: s["status"] for s in students}
        self.loans = {l["loan_id"]: dict(l) for l in loans}
        self.reasons = {}

    def lend(self, e):
        book, student = e["book_id"], e["student_id"]
        mine = [l for l in self.loans.values() if l["loan_status"] in OPEN]
        due = e["new_due"] or e["event_date"] + timedelta(days=7 if self.kinds.get(book) == "digital" else 14)
        if e["loan_id"] in self.loans:
            return "loan_exists"
        if book not in self.books:
            return "book_not_found"
        if self.books[book] != "available":
            return "book_unavailable"
        if student not in self.students:
            return "student_not_found"
        if self.students[student] != "active":
            return "student_inactive"
        if sum(l["student_id"] == student for l in mine) >= 5:
            return "loan_limit"
        if any(l["book_id"] == book for l in mine):
            return "book_on_loan"
        if e["event_date"] > AS_OF:
            return "loan_date_in_future"
        if due <= e["event_date"]:
            return "due_not_after_loan"
        if due > e["event_date"] + timedelta(days=365):
            return "loan_period_too_long"
        self.loans[e["loan_id"]] = {
            "loan_id": e["loan_id"], "book_id": book, "student_id": student, "loan_date": e["event_date"],
            "estimated_return_date": due, "actual_return_date": None, "loan_status": "active", "renewal_count": 0,
        }
        self.books[book] = "loaned"

    def step(self, e):
        if e["event"] == "loan":
            return self.lend(e)
        loan = self.loans.get(e["loan_id"])
        if loan is None:
            return "loan_not_found"
        if e["event"] == "return":
            if loan["loan_status"] not in OPEN:
                return "loan_not_open"
            if e["event_date"] < loan["loan_date"]:
                return "return_before_loan"
            loan.update(loan_status="returned", actual_return_date=e["event_date"])
            self.books[loan["book_id"]] = "available"
        elif e["event"] == "renew":
            if loan["loan_status"] != "active":
                return "loan_not_active"
            if e["new_due"] is None or e["new_due"] <= loan["loan_date"]:
                return "due_not_after_loan"
            if e["new_due"] > loan["loan_date"] + timedelta(days=365):
                return "loan_period_too_long"
            loan.update(estimated_return_date=e["new_due"], renewal_count=loan["renewal_count"] + 1)
        elif e["event"] == "lost":
            if loan["loan_status"] != "lost":
                self.books[loan["book_id"]] = "lost"
            loan["loan_status"] = "lost"
        else:
            return "event_unknown"

    def run(self, events):
        for e in sorted(events, key=lambda e: e["seq"]):
            self.reasons[e["seq"]] = self.step(e)


def made_up(seed, n, n_books, n_students, hot):
    rng = random.Random(seed)
    books = [
        {"book_id": i, "book_type": rng.choice(["physical", "digital"]), "status": "available", "title": f"T{i}"} for i in range(n_books)
    ]
    students = [{"student_id": i, "status": "active" if i % 7 else "inactive"} for i in range(1, n_students)]
    loans = []
    for i in range(n_books // 2):
        status = rng.choice(["active", "overdue", "returned", "returned", "lost"])
        loans.append({
            "loan_id": i, "book_id": i, "student_id": rng.randrange(1, n_students), "loan_date": day("2024-11-01"),
            "estimated_return_date": day("2024-11-15"), "loan_status": status, "renewal_count": 0,
            "actual_return_date": day("2024-11-09") if status == "returned" else None,
        })
        books[i]["status"] = {"returned": "available", "lost": "lost"}.get(status, "loaned")
    events, known = [], list(range(n_books // 2))
    for seq in range(n):
        kind = rng.choices(["loan", "return", "renew", "lost", "odd"], [10, 9, 2, 1.2, 0.1])[0]
        if kind == "loan":
            loan = rng.choice(known) if rng.random() < 0.1 else 1000 + seq
            known.append(loan)
        else:
            loan = rng.choice(known[-12:]) if rng.random() < 0.8 else rng.choice([*known, 99999])
        events.append({
            "seq": seq, "event": kind, "loan_id": loan,
            "book_id": 1 if rng.random() < hot else rng.randrange(n_books + 1),
            "student_id": 3 if rng.random() < hot else rng.randrange(n_students + 1),
            "event_date": AS_OF - timedelta(days=rng.choice([0, 1, 2, 3, 3, -1])),
            "new_due": rng.choice([None, None, AS_OF + timedelta(days=rng.choice([3, 20, 500, -9]))]),
        })
    return books, students, loans, events


@pytest.mark.parametrize("seed,books,students,hot", [(1, 6, 5, 0.3), (3, 3, 12, 0.0)])
def test_any_cut_equals_one_by_one(spark, seed, books, students, hot):
    books, students, loans, events = made_up(seed, 50, books, students, hot)
    loop = OneByOne(books, students, loans)
    loop.run(events)
    # One task decides all requests of a part in order, or two at a time between rounds.
    for parts, run in ((1, 2), (3, 100_000)) if seed == 1 else ((1, 100_000),):
        state = Collection(
            students=frame(spark, S.STUDENTS, students), shelves=frame(spark, S.SHELVES, []),
            books=frame(spark, S.BOOKS, books), loans=frame(spark, S.LOANS, loans),
        )
        reasons, size = {}, -(-len(events) // parts)
        for start in range(0, len(events), size):
            part = events[start : start + size]
            out = apply_events(state, frame(spark, S.LOAN_EVENTS, random.Random(seed).sample(part, len(part))), AS_OF, MOMENT, run)
            told = rows(out.result, "seq", "reason")
            assert len(told) == len(part) == len(dict(told))
            reasons.update(told)
            new_loans, new_books = (df.collect() for df in (out.loans, out.books))
            ids, kept = {r.loan_id for r in new_loans}, {r.book_id for r in new_books}
            state = state.with_tables(
                loans=spark.createDataFrame([r for r in state.loans.collect() if r.loan_id not in ids] + new_loans, state.loans.schema),
                books=spark.createDataFrame([r for r in state.books.collect() if r.book_id not in kept] + new_books, state.books.schema),
            )
        assert {s: (reasons[s], r) for s, r in loop.reasons.items() if reasons[s] != r} == {}
        columns = ("loan_id", "book_id", "student_id", "loan_status", "actual_return_date", "estimated_return_date", "renewal_count")
        assert rows(state.loans, *columns) == sorted(
            (tuple(l.get(c) for c in columns) for l in loop.loans.values()), key=lambda r: r[0]
        )
        assert dict(rows(state.books, "book_id", "status")) == loop.books


@pytest.mark.parametrize("run", [1, 100])
def test_every_request_of_a_pool_takes_its_place(spark, run):
    """The first two of five requests cannot find the pool full, yet they fill it."""
    asked = [(i, i, i, 7, 2, i > 2) for i in range(1, 6)]
    requests = spark.createDataFrame(asked, "seq long, key long, unique long, pool long, room long, tight boolean")
    states = requests.select("key", F.lit(-NEVER).alias("at"), F.lit(True).alias("free"))
    back = F.when(F.col("seq") == 1, 3).otherwise(NEVER).cast("long")
    lent = F.array(F.struct(F.col("seq").alias("at"), F.lit(False).alias("free")))
    granted = grant_intervals(
        requests, states, lambda some: some.withColumns({"ends": back, "held_until": back, "states": lent}), run
    )
    # The first gives its place back at 3, behind the third request.
    assert rows(granted, "seq") == [(1,), (2,), (4,)]


def test_requests_without_keys_are_refused(spark, seed):
    events = [
        {"seq": 1, "event": "loan", "loan_id": None, "book_id": 1, "student_id": 1, "event_date": AS_OF},
        {"seq": 2, "event": "loan", "loan_id": 70, "book_id": None, "student_id": 1, "event_date": AS_OF},
        {"seq": 3, "event": "loan", "loan_id": 71, "book_id": 1, "student_id": None, "event_date": AS_OF},
        {"seq": 4, "event": "return", "loan_id": None, "event_date": AS_OF},
    ]
    out = apply_events(seed, frame(spark, S.LOAN_EVENTS, events), AS_OF, MOMENT)
    assert dict(rows(out.result, "seq", "reason")) == {
        1: "loan_id_missing", 2: "book_not_found", 3: "student_not_found", 4: "loan_not_found",
    }


def test_statement_in_rounds_equals_the_one_row_by_row():
    """The statement the stream is compared with decides in rounds, since that is fast enough for large tables."""
    connection = connect(SMALL)
    last = "round = (SELECT MAX(round) FROM lent)"
    rounds = statement(f"SELECT seq FROM lent WHERE accepted AND {last} ORDER BY seq", statements.REQUESTS, statements.LENT)
    one_by_one = statement("SELECT seq FROM decided WHERE accepted ORDER BY seq", statements.REQUESTS, statements.ONE_BY_ONE)
    found = connection.execute(rounds).fetchall()
    assert found == connection.execute(one_by_one).fetchall() and len(found) > 100


def test_requests_are_asked_about_once_however_many_runs(spark):
    """Chains of requests that wait for each other take no pass over what is open per link."""
    rng, asked, calls = random.Random(6), [], []
    for seq in range(1, 121):
        ends = rng.choice([NEVER, *[seq + rng.randrange(1, 20) for _ in range(9)]])
        asked.append((seq, rng.randrange(12), rng.choice([seq + 500, rng.randrange(30)]), rng.randrange(6), 2, True, ends))
    columns = "seq long, key long, unique long, pool long, room long, tight boolean, _end long"
    requests = spark.createDataFrame(asked, columns)
    known = [(k, -NEVER, k > 0) for k in range(12)] + [(0, 40, True), (1, 60, False), (1, 90, True)]
    states = spark.createDataFrame(known, "key long, at long, free boolean")

    def lives(some):
        calls.append(some)
        end, never = F.col("_end"), F.col("_end") == NEVER
        change = lambda at, free: F.struct(at.alias("at"), F.lit(free).alias("free"))
        held = F.array(change(F.col("seq"), False))
        back = F.array(change(F.col("seq"), False), change(end, True))
        return some.withColumns({"ends": end, "held_until": end, "states": F.when(never, held).otherwise(back)})

    taken, until, marks, held, expected = set(), {}, {}, {}, []
    for k, at, free in known:
        marks.setdefault(k, []).append((at, free))
    for seq, key, unique, pool, room, _, ends in asked:
        _, free = max((m for m in marks[key] if m[0] < seq), default=(0, False))
        places = [e for e in held.get(pool, ()) if e >= seq]
        if not free or unique in taken or until.get(key, -1) >= seq or len(places) >= room:
            continue
        expected.append((seq,))
        taken.add(unique)
        until[key] = ends
        marks[key] = [m for m in marks[key] if m[0] >= seq] + [(seq, False), *([(ends, True)] if ends < NEVER else [])]
        held[pool] = [*places, ends]
    assert len(expected) > 10
    for run in (7, 1000):
        calls.clear()
        assert rows(grant_intervals(requests, states, lives, run), "seq") == expected
        assert len(calls) == 1


def test_lives_of_a_loan_asked_for_often(spark):
    """A thousand requests and returns of one loan id are no million pairs; the first valid return and loss count."""
    rng = random.Random(8)
    asked = [(i * 3, 7 if i < 400 else rng.randrange(20, 30), day("2024-11-01") + timedelta(days=rng.randrange(30))) for i in range(500)]
    told = [
        (i * 3 + 1 + i % 2, rng.choice(["return"] * 9 + ["lost", "renew"]), rng.choice([7, rng.randrange(20, 30), None]),
         rng.choice([None, day("2024-11-01") + timedelta(days=rng.randrange(30))])) for i in range(480)
    ]
    requests = spark.createDataFrame(asked, "seq long, unique long, loan_date date")
    events = spark.createDataFrame(told, "seq long, event string, loan_id long, event_date date")
    expected = []
    for seq, unique, lent in asked:
        mine = [e for e in told if e[2] == unique and e[0] > seq]
        lost = min((e[0] for e in mine if e[1] == "lost"), default=NEVER)
        back = min((e[0] for e in mine if e[1] == "return" and e[3] is not None and e[3] >= lent), default=NEVER)
        back = back if back < lost else NEVER
        states = [(seq, False), *([(back, True)] if back < NEVER else []), *([(lost, False)] if lost < NEVER else [])]
        expected.append((seq, min(back, lost), back, states))
    found = _lives(requests, events)
    assert [(*r[:3], [tuple(s) for s in r.states]) for r in found.select("seq", "ends", "held_until", "states").sort("seq").collect()] == expected
    assert "Join" not in found._jdf.queryExecution().toString()
