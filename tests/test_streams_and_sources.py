import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, SMALL, day, frame, rows
from lectern import schemas as S
from lectern.session import scratch_path
from lectern.sources import star, star_batches
from lectern.sources.loader import read_collection, read_table, write_collection
from lectern.streaming.ledger import Ledger
from lectern.streaming.loan_events import apply_events, fold_events, run_loan_events
from lectern.streaming.shelf_counts import current_counts, run_shelf_counts, running_counts

MOMENT = datetime(2024, 12, 10, 8, 0, 0)


def fold_one_by_one(loans, events):
    state = {l["loan_id"]: dict(l) for l in loans}
    decisions = {}
    for e in sorted(events, key=lambda e: e["seq"]):
        loan, reason = state.get(e["loan_id"]), None
        if loan is None:
            reason = "loan_not_found"
        elif e["event"] == "return":
            if loan["loan_status"] not in ("active", "overdue"):
                reason = "loan_not_open"
            elif e["event_date"] < loan["loan_date"]:
                reason = "return_before_loan"
            else:
                loan.update(loan_status="returned", actual_return_date=e["event_date"])
        elif e["event"] == "renew":
            if loan["loan_status"] != "active":
                reason = "loan_not_active"
            elif e["new_due"] <= loan["loan_date"]:
                reason = "due_not_after_loan"
            elif e["new_due"] > loan["loan_date"] + timedelta(days=365):
                reason = "loan_period_too_long"
            else:
                loan["estimated_return_date"] = e["new_due"]
                loan["renewal_count"] += 1
        else:
            loan["loan_status"] = "lost"
        decisions[e["seq"]] = reason
    return state, decisions


@pytest.mark.parametrize("seed_no", range(4))
def test_folding_equals_one_by_one(spark, seed_no):
    rng = random.Random(seed_no)
    loans = [
        {"loan_id": i, "book_id": i, "student_id": 1, "loan_date": day("2024-11-01"),
         "estimated_return_date": day("2024-11-15"), "actual_return_date": None,
         "loan_status": rng.choice(["active", "active", "overdue", "returned", "lost"]),
         "renewal_count": 0}
        for i in range(30)
    ]
    events = [
        {"seq": i, "event": rng.choices(["return", "renew", "lost"], [3, 5, 1])[0],
         "loan_id": 0 if rng.random() < 0.33 else rng.randint(0, 31),
         "event_date": day("2024-11-01") + timedelta(days=rng.randint(-5, 30)),
         "new_due": day("2024-11-01") + timedelta(days=rng.choice([-3, 10, 30, 400]))}
        for i in range(200)
    ]
    after, result, _ = fold_events(frame(spark, S.LOANS, loans), frame(spark, S.LOAN_EVENTS, events))
    state, decisions = fold_one_by_one(loans, events)
    assert dict(rows(result, "seq", "reason")) == decisions
    columns = ("loan_status", "actual_return_date", "estimated_return_date", "renewal_count")
    for r in after.collect():
        assert tuple(r[c] for c in columns) == tuple(state[r.loan_id][c] for c in columns)


EVENTS = [
    [(1, "return", 2, 2, 1, "2024-12-08", None), (2, "loan", 50, 2, 2, "2024-12-09", None),
     (3, "loan", 51, 2, 3, "2024-12-09", None), (4, "renew", 50, 2, 2, "2024-12-09", "2024-12-30")],
    [(5, "lost", 4, 4, 3, "2024-12-09", None), (6, "return", 50, 2, 2, "2024-12-10", None),
     (7, "return", 50, 2, 2, "2024-12-10", None), (8, "loan", 50, 7, 2, "2024-12-10", None)],
    [(9, "loan", 52, 2, 5, "2024-12-10", None), (10, "renew", 404, 1, 1, "2024-12-10", "2024-12-30")],
]
OUTCOMES = {
    1: None, 2: None, 3: "book_unavailable", 4: None, 5: None, 6: None, 7: "loan_not_open",
    8: "loan_exists", 9: None, 10: "loan_not_found",
}


def event_frames(spark):
    def made(e):
        return (*e[:5], day(e[5]), day(e[6]) if e[6] else None)

    return [spark.createDataFrame([made(e) for e in part], S.LOAN_EVENTS) for part in EVENTS]


def on_loan(seed):
    return seed.with_tables(books=seed.books.withColumn(
        "status", F.when(F.col("book_id").isin(2, 4, 5), "loaned").otherwise(F.col("status"))))


def test_stream_equals_batches_and_survives_a_restart(spark, seed):
    root = scratch_path(spark, "stream-test")
    tables = on_loan(seed)
    ledger = Ledger.start(f"{root}/ledger", tables)
    frames = event_frames(spark)
    for df in frames[:2]:
        df.coalesce(1).write.mode("append").parquet(f"{root}/events")
        run_loan_events(spark, f"{root}/events", ledger, AS_OF, MOMENT).awaitTermination()
    # A new query on the same ledger continues where the last one stopped.
    frames[2].coalesce(1).write.mode("append").parquet(f"{root}/events")
    run_loan_events(spark, f"{root}/events", Ledger(spark, ledger.root), AS_OF, MOMENT).awaitTermination()
    schema = "seq long, event string, loan_id long, accepted boolean, reason string"
    results = spark.read.schema(schema).parquet(f"{ledger.root}/results")
    assert dict(rows(results, "seq", "reason")) == OUTCOMES

    state = tables
    for df in frames:
        outcome = apply_events(state, df, AS_OF, MOMENT)
        ids = outcome.loans.select("loan_id")
        state = state.with_tables(
            loans=state.loans.join(ids, "loan_id", "left_anti").select(*state.loans.columns)
            .unionByName(outcome.loans),
            books=state.books.join(outcome.books.select("book_id"), "book_id", "left_anti")
            .select(*state.books.columns).unionByName(outcome.books),
        )
    current = ledger.current()
    assert rows(current.loans) == rows(state.loans)
    assert rows(current.books, "book_id", "status") == rows(state.books, "book_id", "status")
    found = {r.loan_id: (r.loan_status, r.renewal_count) for r in current.loans.collect()}
    assert found[2] == ("returned", 0) and found[4] == ("lost", 0)
    assert found[50] == ("returned", 1) and found[52] == ("active", 0)
    books = dict(rows(current.books, "book_id", "status"))
    assert (books[2], books[4]) == ("loaned", "lost")

    # A batch that runs again leaves the same state.
    again = apply_events(ledger.current(before_batch=1), frames[1], AS_OF, MOMENT)
    ledger.write(again.loans, "loans", 1)
    ledger.write(again.books, "books", 1)
    assert rows(ledger.current().loans) == rows(state.loans)
    operations = spark.read.parquet(f"{ledger.root}/audit").groupBy("table_name", "operation").count()
    assert dict(((r[0], r[1]), r[2]) for r in operations.collect())[("loans", "INSERT")] == 2
    compact = Ledger.start(f"{root}/compacted", ledger.current())
    assert rows(compact.current().loans) == rows(state.loans)


def test_shelf_count_stream(spark, seed):
    root = scratch_path(spark, "counts-test")
    deltas = star_batches.shelf_delta_events(star.read_star(spark, SMALL))
    deltas.repartition(4).write.parquet(f"{root}/deltas")
    run_shelf_counts(spark, f"{root}/deltas", f"{root}/out", files_per_batch=1).awaitTermination()
    assert rows(current_counts(spark, f"{root}/out"), "shelf_id", "book_count") == rows(
        running_counts(deltas), "shelf_id", "book_count")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_collection_round_trip(spark, seed, fmt):
    root = scratch_path(spark, f"tables-{fmt}")
    write_collection(seed, root, fmt, partition_by={} if fmt != "parquet" else None)
    again = read_collection(spark, root, fmt)
    for table, df in seed.as_dict().items():
        columns = [c for c in df.columns if c not in ("created_at", "updated_at")]
        assert rows(again.as_dict()[table], *columns) == rows(df, *columns)


def test_partitioned_loans_are_pruned(spark, seed):
    root = scratch_path(spark, "pruned")
    write_collection(seed, root)
    loans = read_collection(spark, root).loans.where("loan_status IN ('active', 'overdue')")
    plan = loans._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [loan_status" in plan
    with pytest.raises(Exception, match="(?i)already exists"):
        write_collection(seed, root)


def test_schema_is_not_inferred(spark):
    schema = star.SOURCES["orders"]
    df = read_table(spark, f"{SMALL}/orders.parquet", fmt="parquet")
    assert df.count() == spark.read.schema(schema).parquet(f"{SMALL}/orders.parquet").count() == 1500
