"""Loans: admission, returns, renewals, status changes and what they mean for the books.

A job takes tables and a batch of requests, each with a unique ``seq`` that gives their order, and
returns new tables plus a result with one row per request: ``accepted`` and ``reason``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.dates import due_date
from lectern.functions.documents import value_json
from lectern.operators.admission import grant
from lectern.operators.changes import assign_keys, timestamp, touched
from lectern.operators.exclusive import granted_openings
from lectern.operators.lookup import by_key
from lectern.operators.quality import first_broken, loan_period_rules
from lectern.plans.views import is_open
from lectern.schemas import (
    BOOK_STATUSES,
    LOAN_DAYS,
    LOAN_STATUSES,
    MAX_LOAN_DAYS,
    MAX_OPEN_LOANS,
)
from lectern.session import apart, pin
from lectern.sources.collection import Collection


@dataclass(frozen=True)
class Admission:
    """``result`` per request, the admitted ``loans`` and the ``tables`` after the batch."""

    result: DataFrame
    loans: DataFrame
    tables: Collection


def admit_loans(
    tables: Collection,
    requests: DataFrame,
    as_of: date,
    flat_due_date: bool = False,
    max_open: int = MAX_OPEN_LOANS,
    moment: datetime | None = None,
) -> Admission:
    """Admit loan requests as if they were inserted one by one in ``seq`` order.

    A request needs an existing available book without another open loan, an existing active student
    below the limit of open loans, and valid dates. Each admission takes the book and one of the
    student's places. ``requests`` may name the key of the loan to be made in ``loan_id``; keys are
    assigned otherwise.
    """
    open_loans = tables.loans.where(is_open())
    out = by_key(open_loans, requests, "book_id").select("book_id").distinct()
    books = (
        by_key(tables.books, requests, "book_id")
        .select(
            "book_id", F.col("status").alias("_book_status"), F.col("book_type").alias("_book_type")
        )
        .join(out.withColumn("_out", F.lit(True)), "book_id", "left")
    )
    held = (
        by_key(open_loans, requests, "student_id")
        .groupBy("student_id")
        .agg(F.count("*").alias("_held"))
    )
    students = (
        by_key(tables.students, requests, "student_id")
        .select("student_id", F.col("status").alias("_student_status"))
        .join(held, "student_id", "left")
    )

    opened = F.coalesce("loan_date", F.lit(as_of))
    if flat_due_date:
        default_due = F.date_add(F.col("loan_date"), LOAN_DAYS)
    else:
        default_due = due_date(F.col("loan_date"), F.col("_book_type"))
    # Written once: the rounds, the result and the new loans all start from these rows.
    facts = pin(
        requests.withColumn("loan_date", opened)
        .join(apart(books), "book_id", "left")
        .join(apart(students), "student_id", "left")
        .withColumns(
            {
                "estimated_return_date": F.coalesce("estimated_return_date", default_due),
                "_held": F.coalesce("_held", F.lit(0)),
            }
        )
        .withColumn("_broken", first_broken(loan_period_rules(as_of)))
    )
    # Requests that fail on their own never take a book or a place.
    eligible = facts.where(
        (F.col("_book_status") == "available")
        & (F.col("_student_status") == "active")
        & F.col("_out").isNull()
        & F.col("_broken").isNull()
    ).withColumn("_room", F.lit(max_open) - F.col("_held"))
    granted = grant(
        eligible, unique=["book_id"], pool="student_id", room="_room", most_room=max_open
    )

    taken = granted.select("book_id", F.col("seq").alias("_taken_at"))
    # At most ``max_open`` entries per student: that many grants are possible.
    grants = granted.groupBy("student_id").agg(F.collect_list("seq").alias("_grants"))
    seq = F.col("seq")
    held_then = F.col("_held") + F.coalesce(
        F.size(F.filter("_grants", lambda at: at < seq)), F.lit(0)
    )
    reason = (
        F.when(F.col("_book_status").isNull(), "book_not_found")
        .when(
            (F.col("_book_status") != "available") | (F.col("_taken_at") < seq), "book_unavailable"
        )
        .when(F.col("_student_status").isNull(), "student_not_found")
        .when(F.col("_student_status") != "active", "student_inactive")
        .when(held_then >= max_open, "loan_limit")
        .when(F.col("_out").isNotNull(), "book_on_loan")
        .otherwise(F.col("_broken"))
    )
    decided = pin(
        facts.join(apart(taken), "book_id", "left")
        .join(apart(grants), "student_id", "left")
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
    )
    stamp = timestamp(moment)
    stamp = F.lit(None).cast("timestamp_ntz") if stamp is None else stamp
    admitted = decided.where("accepted").withColumns(
        {
            "actual_return_date": F.lit(None).cast("date"),
            "loan_status": F.lit("active"),
            "renewal_count": F.lit(0),
            "created_at": stamp,
            "updated_at": stamp,
        }
    )
    if "loan_id" not in requests.columns:
        admitted = assign_keys(admitted, tables.loans, "loan_id")
    if "notes" not in requests.columns:
        admitted = admitted.withColumn("notes", F.lit(None).cast("string"))
    admitted = admitted.select(
        "seq", *[F.col(c).cast(tables.loans.schema[c].dataType).alias(c) for c in tables.loans.columns]
    )
    new_loans = admitted.select(*tables.loans.columns)
    events = admitted.select(
        "seq", "book_id", F.lit(None).cast("string").alias("old_status"),
        F.col("loan_status").alias("new_status"),
    )
    after = tables.with_tables(
        loans=tables.loans.unionByName(new_loans),
        books=derive_book_status(tables.books, events, moment),
    )
    result = decided.select(
        "seq", "book_id", "student_id", "loan_date", "estimated_return_date", "accepted", "reason"
    )
    return Admission(result, admitted, after)


def _first_reason(requests: DataFrame, reason: Column) -> DataFrame:
    return requests.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def apply_returns(
    loans: DataFrame, returns: DataFrame, as_of: date, moment: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """Close open loans; returns ``(loans, result)``.

    The first valid return of a loan closes it, later ones find it closed.
    """
    known = by_key(loans, returns, "loan_id").select("loan_id", "loan_date", "loan_status")
    facts = pin(
        returns.select(
            "seq", "loan_id", F.coalesce("return_date", F.lit(as_of)).alias("return_date")
        ).join(apart(known), "loan_id", "left")
    )
    valid = is_open() & (F.col("return_date") >= F.col("loan_date"))
    closing = (
        facts.where(valid)
        .groupBy("loan_id")
        .agg(F.min("seq").alias("_at"), F.min_by("return_date", "seq").alias("_returned"))
    )
    reason = (
        F.when(F.col("loan_status").isNull(), "loan_not_found")
        .when(~is_open() | (F.col("_at") < F.col("seq")), "loan_not_open")
        .when(F.col("return_date") < F.col("loan_date"), "return_before_loan")
    )
    result = _first_reason(facts.join(apart(closing), "loan_id", "left"), reason).select(
        "seq", "loan_id", "return_date", "accepted", "reason"
    )
    closed = F.col("_at").isNotNull()
    changes = {
        "loan_status": F.when(closed, "returned").otherwise(F.col("loan_status")),
        "actual_return_date": F.coalesce("_returned", "actual_return_date"),
        **touched(closed, moment),
    }
    return _change_open(loans, closing, changes), result


def _change_open(loans: DataFrame, wanted: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Loans after ``changes`` to open ones; loans that are over pass through without a join."""
    over = loans.where(~F.coalesce(is_open(), F.lit(False)))
    changed = loans.where(is_open()).join(wanted, "loan_id", "left").withColumns(changes)
    return changed.select(*loans.columns).unionByName(over)


def return_changes(loans: DataFrame, result: DataFrame) -> DataFrame:
    """``seq, book_id, old_status, new_status`` of the returns accepted by ``apply_returns``."""
    accepted = result.where("accepted").select("seq", "loan_id")
    return loans.where(is_open()).join(accepted, "loan_id").select(
        "seq", "book_id", F.col("loan_status").alias("old_status"), F.lit("returned").alias("new_status")
    )


def new_loan_changes(loans: DataFrame) -> DataFrame:
    """``seq, book_id, old_status, new_status`` as if all of ``loans`` were new, in order of their keys."""
    return loans.select(
        F.col("loan_id").alias("seq"),
        "book_id",
        F.lit(None).cast("string").alias("old_status"),
        F.col("loan_status").alias("new_status"),
    )


def renew_loans(
    loans: DataFrame, renewals: DataFrame, moment: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """Give active loans a new due date, once per valid renewal in order; ``(loans, result)``."""
    known = by_key(loans, renewals, "loan_id").select("loan_id", "loan_date", "loan_status")
    facts = renewals.select("seq", "loan_id", "new_due").join(apart(known), "loan_id", "left")
    opened, due = F.col("loan_date"), F.col("new_due")
    reason = (
        F.when(F.col("loan_status").isNull(), "loan_not_found")
        .when(F.col("loan_status") != "active", "loan_not_active")
        .when(due.isNull() | (due <= opened), "due_not_after_loan")
        .when(due > F.date_add(opened, MAX_LOAN_DAYS), "loan_period_too_long")
    )
    decided = pin(_first_reason(facts, reason))
    renewed = (
        decided.where("accepted")
        .groupBy("loan_id")
        .agg(F.count("*").cast("int").alias("_times"), F.max_by("new_due", "seq").alias("_due"))
    )
    changed = F.col("_times").isNotNull()
    changes = {
        "estimated_return_date": F.coalesce("_due", "estimated_return_date"),
        "renewal_count": F.when(changed, F.coalesce("renewal_count", F.lit(0)) + F.col("_times"))
        .otherwise(F.col("renewal_count")),
        **touched(changed, moment),
    }
    after = _change_open(loans, renewed, changes)
    return after, decided.select("seq", "loan_id", "new_due", "accepted", "reason")


def _set_status(
    df: DataFrame,
    wanted: DataFrame,
    key: str,
    column: str,
    refused: Column,
    moment: datetime | None,
) -> tuple[DataFrame, DataFrame]:
    """The last request per key that ``refused`` finds no reason against sets the status."""
    known = by_key(df, wanted, key).drop("status").withColumn("_known", F.lit(True))
    reason = F.when(F.col("_known").isNull(), "not_found").otherwise(refused)
    decided = pin(
        _first_reason(wanted.join(apart(known), key, "left"), reason).select(
            "seq", key, "status", "accepted", "reason"
        )
    )
    last = decided.where("accepted").groupBy(key).agg(F.max_by("status", "seq").alias("_status"))
    changes = {
        column: F.coalesce("_status", column),
        **touched(F.col("_status").isNotNull(), moment),
    }
    return df.join(last, key, "left").withColumns(changes).select(*df.columns), decided


def _status_unknown(allowed: tuple[str, ...]) -> Column:
    known = F.coalesce(F.col("status").isin(*allowed), F.lit(False))
    return F.when(~known, F.lit("status_unknown"))


def set_loan_status(
    loans: DataFrame, wanted: DataFrame, moment: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """Set statuses by ``seq, loan_id, status`` in order, whatever the loan's status was.

    The last status per loan stays. Only the table's own constraints can refuse one: a returned loan
    has a return date, an active loan has none, and a book has one open loan at most at any time.
    """
    status, actual = F.col("status"), F.col("actual_return_date")
    refused = F.coalesce(
        _status_unknown(LOAN_STATUSES),
        F.when((status == "returned") & actual.isNull(), "returned_without_date"),
        F.when((status == "active") & actual.isNotNull(), "active_with_return_date"),
    )
    known = by_key(loans, wanted, "loan_id").select("loan_id", "book_id", "actual_return_date")
    allowed = wanted.join(pin(known), "loan_id").where(refused.isNull())
    events = pin(
        allowed.where("book_id is not null").select(
            "seq",
            F.col("book_id").alias("key"),
            F.col("loan_id").alias("item"),
            is_open(status).alias("opens"),
        )
    )
    open_loans = loans.where(is_open()).withColumnRenamed("book_id", "key")
    holders = by_key(open_loans, events, "key").select("key", F.col("loan_id").alias("item"))
    granted = granted_openings(events, holders).withColumn("_granted", F.lit(True))
    marked = pin(wanted.join(granted, "seq", "left"))
    refused = F.coalesce(
        refused, F.when(
            is_open(status) & F.col("book_id").isNotNull() & F.col("_granted").isNull(),
            "book_on_loan",
        ),
    )
    return _set_status(loans, marked, "loan_id", "loan_status", refused, moment)


def set_book_status(
    books: DataFrame, wanted: DataFrame, moment: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """Set statuses by ``seq, book_id, status``; the last one per book stays."""
    return _set_status(books, wanted, "book_id", "status", _status_unknown(BOOK_STATUSES), moment)


def _turns_overdue(as_of: date) -> Column:
    return (
        (F.col("loan_status") == "active")
        & F.col("actual_return_date").isNull()
        & (F.col("estimated_return_date") < F.lit(as_of))
    )


def mark_overdue(loans: DataFrame, as_of: date, moment: datetime | None = None) -> DataFrame:
    """Active loans past their due date become overdue. No shuffle: one pass over the loans."""
    turns = _turns_overdue(as_of)
    status = F.when(turns, "overdue").otherwise(F.col("loan_status"))
    return loans.withColumns({"loan_status": status, **touched(turns, moment)})


def overdue_pairs(loans: DataFrame, as_of: date, moment: datetime | None = None) -> DataFrame:
    """``old`` and ``new`` rows of the loans that ``mark_overdue`` changes, from one pass over them."""
    turns = loans.where(_turns_overdue(as_of)).withColumn("old", F.struct(*loans.columns))
    changes = {"loan_status": F.lit("overdue"), **touched(F.lit(True), moment)}
    return turns.withColumns(changes).select("old", F.struct(*loans.columns).alias("new"))


def overdue_count(loans: DataFrame, as_of: date) -> DataFrame:
    """``updated_count``: how many loans ``mark_overdue`` changes."""
    return loans.where(_turns_overdue(as_of)).agg(F.count("*").alias("updated_count"))


def overdue_audit(loans: DataFrame, as_of: date, moment: datetime) -> DataFrame:
    """The audit row of one ``mark_overdue`` run."""
    return overdue_count(loans, as_of).select(
        F.lit("loans").alias("table_name"),
        F.lit("BATCH_UPDATE").alias("operation"),
        F.lit(None).cast("long").alias("row_key"),
        F.lit(None).cast("string").alias("old_values"),
        value_json(F.struct("updated_count", F.lit("mark_overdue").alias("operation"))).alias(
            "new_values"
        ),
        F.lit(None).cast("string").alias("user_id"),
        timestamp(moment).alias("timestamp"),
    )


def loan_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``seq, book_id, old_status, new_status`` of loans whose status differs between snapshots.

    The old status is null for a new loan, the new one for a deleted loan. ``seq`` is the loan key.
    """
    old = before.select("loan_id", F.struct("book_id", "loan_status").alias("old"))
    new = after.select("loan_id", F.struct("book_id", "loan_status").alias("new"))
    return (
        old.join(new, "loan_id", "full_outer")
        .where(~F.col("old.loan_status").eqNullSafe(F.col("new.loan_status")))
        .select(
            F.col("loan_id").alias("seq"),
            F.coalesce("new.book_id", "old.book_id").alias("book_id"),
            F.col("old.loan_status").alias("old_status"),
            F.col("new.loan_status").alias("new_status"),
        )
    )


def book_status_effect() -> Column:
    """What a loan's change means for its book's status; null when it means nothing."""
    old, new = F.col("old_status"), F.col("new_status")
    return (
        F.when(new.isNull(), F.when(is_open(old), "available"))
        .when(old.isNull(), F.when(is_open(new), "loaned"))
        .when((new == "returned") & (old != "returned"), "available")
        .when(is_open(new) & (old == "returned"), "loaned")
        .when((new == "lost") & (old != "lost"), "lost")
    )


def derive_book_status(
    books: DataFrame, changes: DataFrame, moment: datetime | None = None
) -> DataFrame:
    """Books after loan changes ``seq, book_id, old_status, new_status``; the last effect stays."""
    effects = (
        changes.withColumn("_effect", book_status_effect())
        .where(F.col("_effect").isNotNull())
        .groupBy("book_id")
        .agg(F.max_by("_effect", "seq").alias("_effect"))
    )
    changed = F.col("_effect").isNotNull()
    return (
        books.join(effects, "book_id", "left")
        .withColumns(
            {"status": F.coalesce("_effect", "status"), **touched(changed, moment)}
        )
        .select(*books.columns)
    )
