"""Empty batches, hot keys and null keys."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, SMALL, frame, rows
from lectern import schemas as S
from lectern.operators import changes, circulation, ingest, shelving
from lectern.operators.admission import grant
from lectern.operators.lookup import by_key, missing_parties
from lectern.operators.paging import gather
from lectern.plans.catalog import QUERIES
from lectern.session import apart
from lectern.sources.collection import Collection
from lectern.streaming.loan_events import apply_events

MOMENT = datetime(2024, 12, 10, 8, 0, 0)


def test_empty_batches_change_nothing(spark, seed):
    none = circulation.admit_loans(seed, frame(spark, S.LOAN_REQUESTS, []), AS_OF)
    assert none.result.count() == 0 and rows(none.tables.loans) == rows(seed.loans)
    loans, result = circulation.apply_returns(seed.loans, frame(spark, S.RETURNS, []), AS_OF)
    assert result.count() == 0 and rows(loans) == rows(seed.loans)
    loans, result = circulation.renew_loans(seed.loans, frame(spark, S.RENEWALS, []))
    assert result.count() == 0 and rows(loans) == rows(seed.loans)
    after, result = shelving.move_books(seed, frame(spark, S.MOVES, []))
    assert result.count() == 0 and rows(after.books) == rows(seed.books)
    empty = seed.books.where("false").withColumn("seq", F.lit(1).cast("long"))
    assert shelving.place_books(seed, empty, AS_OF).count() == 0
    made = ingest.ingest(seed, empty, "books", AS_OF)
    assert rows(made.tables.books) == rows(seed.books)
    assert rows(made.tables.shelves) == rows(seed.shelves)
    outcome = apply_events(seed, frame(spark, S.LOAN_EVENTS, []), AS_OF, MOMENT)
    assert (outcome.result.count(), outcome.loans.count(), outcome.audit.count()) == (0, 0, 0)


def test_repeated_delete_keys(spark, seed):
    keys = spark.createDataFrame([(1,), (1,), (None,)], "student_id long")
    after = changes.delete_students(seed, keys)
    assert after.students.count() == 4 and after.books.count() == 14


def test_grant_without_pool_or_keys(spark):
    df = spark.createDataFrame([(1, None), (2, 7), (3, 7), (4, None)], "seq long, k int")
    assert rows(grant(df, ["k"]), "seq") == [(1,), (2,), (4,)]
    pooled = spark.createDataFrame([(i, 0, 2) for i in range(5)] + [(9, None, None)],
                                   "seq long, p int, room int")
    assert rows(grant(pooled, pool="p", room="room"), "seq") == [(0,), (1,), (9,)]


def test_hot_request_keys(spark, seed):
    """A third of the requests name one student, a third one book."""
    asked = spark.range(6000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(1 + F.col("id") % 14).alias("book_id"),
        F.when(F.col("id") % 3 == 1, 5).otherwise(1 + F.col("id") % 5).alias("student_id"),
        F.lit(None).cast("date").alias("loan_date"),
        F.lit(None).cast("date").alias("estimated_return_date"),
    )
    made = circulation.admit_loans(seed, asked, AS_OF)
    per_book = made.loans.groupBy("book_id").count()
    per_student = made.tables.loans.where("loan_status IN ('active', 'overdue')").groupBy("student_id").count()
    assert made.result.count() == 6000
    assert per_book.where("count > 1").count() == 0
    assert per_student.where("count > 5").count() == 0
    # Every book without a loan went out: the students have room for all of them.
    assert made.loans.count() == 11


@pytest.mark.parametrize("case", ["semi join", "left join", "delete", "requests"])
def test_skewed_joins_can_be_split(spark, case):
    """With no broadcast, a key that holds a third of the rows is split in the plan that ran."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        hot = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))
        rows_ = spark.range(0, 300_000, 1, 8).select(
            "id", hot.alias("book_id"), hot.alias("student_id"), F.lit("active").alias("loan_status")
        )
        keys = spark.range(0, 300_000, 7, 4).select(F.col("id").alias("book_id"), F.col("id").alias("student_id"))
        keys = keys.union(keys.limit(1).select(F.lit(1), F.lit(1)))
        if case == "semi join":
            found = by_key(rows_, keys, "book_id")
        elif case == "left join":
            found = rows_.join(apart(keys.groupBy("book_id").agg(F.count("*").alias("n"))), "book_id", "left")
        elif case == "delete":
            found = rows_.join(apart(keys.select("student_id").distinct()), "student_id", "left_anti")
        else:
            tables = Collection(books=keys.select("book_id"), students=keys.select("student_id"), loans=None, shelves=None)
            found = missing_parties(tables, rows_.drop("loan_status"))
        found.write.format("noop").mode("overwrite").save()
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_group_is_spread_over_tasks(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id"
    )
    found = gather(df, "k", "id", F.col("id"), "ids", page_size=100)
    hot = found.where("k = 1").orderBy("page").collect()
    assert [r.page for r in hot] == list(range(14)) and {len(r.ids) for r in hot[:-1]} == {100}
    assert [i for r in hot for i in r.ids] == sorted({*range(0, 4000, 3), 1})
    assert sorted(i for r in hot for i in r.ids) == sorted({*range(0, 4000, 3), 1})
    assert found.select(F.sum(F.size("ids"))).collect()[0][0] == 4000


@pytest.mark.parametrize(
    "name", ["cdc1_audit_overdue", "l6_book_status_after_returns", "l6_book_status_from_loans"]
)
def test_known_changes_need_no_self_join(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan
