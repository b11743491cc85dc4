"""Loan events (``loan``, ``return``, ``renew``, ``lost``) as a stream of micro-batches.

Events take effect one after another by ``seq``. Within a micro-batch that is worked out by set
operations; micro-batches are expected to arrive in that order too.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.dates import due_date
from lectern.operators.changes import audit_diff, timestamp, touched
from lectern.operators.circulation import book_status_effect, derive_book_status
from lectern.operators.intervals import NEVER, grant_intervals
from lectern.operators.lookup import by_key
from lectern.operators.quality import first_broken, loan_period_rules
from lectern.operators.running import running_max, running_total
from lectern.plans.views import is_open
from lectern.schemas import LOAN_EVENTS, MAX_LOAN_DAYS, MAX_OPEN_LOANS
from lectern.session import apart, pin
from lectern.sources.collection import Collection
from lectern.streaming.ledger import Ledger

# More than the places one student can hold.
_BATCH = 2**31


@dataclass(frozen=True)
class EventOutcome:
    """``result`` per event; ``loans`` and ``books`` hold only the rows that may have changed."""

    result: DataFrame
    loans: DataFrame
    books: DataFrame
    audit: DataFrame


def fold_events(
    loans: DataFrame, events: DataFrame, moment: datetime | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply returns, renewals and losses to their loans; ``(loans, result, status changes)``.

    Equal to one event after another: the first loss ends what can be returned, the first valid
    return before it closes the loan, and renewals count up to either. All of it comes from minima
    per loan, so a loan with very many events is no burden.
    """
    none = F.lit(2**63 - 1)
    lost = F.when(F.col("event") == "lost", F.col("seq"))
    losses = events.groupBy("loan_id").agg(F.min(lost).alias("_lost"))
    state = loans.select("loan_id", "book_id", "loan_date", "loan_status").join(
        losses, "loan_id", "left"
    )
    facts = pin(
        events.select("seq", "event", "loan_id", "event_date", "new_due")
        .join(apart(state), "loan_id", "left")
        .withColumn("_lost_or_end", F.coalesce("_lost", none))
    )
    opened, day, due = F.col("loan_date"), F.col("event_date"), F.col("new_due")
    returns = facts.where(
        (F.col("event") == "return")
        & is_open()
        & (day >= opened)
        & (F.col("seq") < F.col("_lost_or_end"))
    ).groupBy("loan_id").agg(
        F.min("seq").alias("_returned"), F.min_by("event_date", "seq").alias("_day")
    )
    facts = facts.join(apart(returns), "loan_id", "left").withColumn(
        "_ends", F.least("_lost_or_end", F.coalesce("_returned", none))
    )
    seq, event, status = F.col("seq"), F.col("event"), F.col("loan_status")
    reason = (
        F.when(status.isNull(), "loan_not_found")
        .when(
            event == "return",
            F.when(
                ~is_open() | (F.col("_lost") < seq) | (F.col("_returned") < seq), "loan_not_open"
            ).when(day.isNull() | (day < opened), "return_before_loan"),
        )
        .when(
            event == "renew",
            F.when((status != "active") | (F.col("_ends") < seq), "loan_not_active")
            .when(due.isNull() | (due <= opened), "due_not_after_loan")
            .when(due > F.date_add(opened, MAX_LOAN_DAYS), "loan_period_too_long"),
        )
        .when(event != "lost", "event_unknown")
    )
    decided = pin(
        facts.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    )
    renewed = F.col("accepted") & (F.col("event") == "renew")
    net = (
        decided.where("accepted")
        .groupBy("loan_id")
        .agg(
            F.min("_lost").alias("_lost"),
            F.min("_returned").alias("_returned"),
            F.min("_day").alias("_day"),
            F.count_if(renewed).cast("int").alias("_renewals"),
            F.max_by("new_due", F.when(renewed, F.col("seq"))).alias("_due"),
        )
    )
    applied = loans.join(net, "loan_id")
    after = applied.withColumns(
        {
            "loan_status": F.when(F.col("_lost").isNotNull(), "lost")
            .when(F.col("_returned").isNotNull(), "returned")
            .otherwise(F.col("loan_status")),
            "actual_return_date": F.coalesce("_day", "actual_return_date"),
            "estimated_return_date": F.coalesce("_due", "estimated_return_date"),
            "renewal_count": F.coalesce("renewal_count", F.lit(0)) + F.col("_renewals"),
            **touched(F.lit(True), moment),
        }
    ).select(*loans.columns)
    steps = F.array(
        F.struct(
            F.col("_returned").alias("seq"),
            F.col("loan_status").alias("old_status"),
            F.lit("returned").alias("new_status"),
        ),
        F.struct(
            F.col("_lost").alias("seq"),
            F.when(F.col("_returned").isNotNull(), "returned")
            .otherwise(F.col("loan_status"))
            .alias("old_status"),
            F.lit("lost").alias("new_status"),
        ),
    )
    changes = (
        applied.select("book_id", F.explode(steps).alias("step"))
        .where("step.seq is not null")
        .select("step.seq", "book_id", "step.old_status", "step.new_status")
    )
    return after, decided.select("seq", "event", "loan_id", "accepted", "reason"), changes


def _lives(requests: DataFrame, events: DataFrame) -> DataFrame:
    """When the loans of ``requests`` would come back or be lost, by events on them behind the request.

    The first valid return before the first loss ends a loan and frees its book, a loss ends it and
    keeps the book. A loss behind the return takes the book away again.
    """
    columns, none = requests.columns, F.lit(None)
    asked = requests.withColumns(
        {"_at": F.col("seq"), "_event": none.cast("string"), "_day": F.unix_date("loan_date")}
    )
    told = events.where(
        F.col("loan_id").isNotNull()
        & ((F.col("event") == "lost") | ((F.col("event") == "return") & F.col("event_date").isNotNull()))
    ).select(
        F.col("loan_id").alias("unique"), F.col("seq").alias("_at"), F.col("event").alias("_event"),
        F.unix_date("event_date").alias("_day"),
    )
    known = T.StructType([*requests.schema, T.StructField("_back", T.LongType()), T.StructField("_lost", T.LongType())])
    line = asked.unionByName(told, allowMissingColumns=True).repartition("unique")
    # Backwards, so that what lies behind a request comes before it.
    line = line.sortWithinPartitions("unique", F.desc("_at"), F.col("_event").isNotNull())
    ends = line.mapInArrow(_first_ends(columns), known)
    never = F.lit(NEVER)
    back = F.when(F.col("_back") < F.coalesce("_lost", never), F.col("_back"))
    change = lambda at, free: F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(free).alias("free")))
    return ends.select(
        *columns,
        F.coalesce(F.least(back, "_lost"), never).alias("ends"),
        F.coalesce(back, never).alias("held_until"),
        F.array_compact(
            F.array(change(F.col("seq"), False), change(back, True), change(F.col("_lost"), False))
        ).alias("states"),
    )


def _first_ends(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds to requests their first valid return and first loss, of lines that come loan by loan, backwards.

        Of a loan's returns those count that are earlier or of a later day than all others, so at most
        one per day is kept; they stand with earlier ones, of earlier days, behind.
        """
        loan, lost, days, returns = None, None, [], []
        for batch in batches:
            asked, backs, losses = [], [], []
            lists = [batch.column(c).to_pylist() for c in ("unique", "_at", "_event", "_day")]
            for place, (unique, at, event, day) in enumerate(zip(*lists, strict=True)):
                if unique != loan:
                    loan, lost, days, returns = unique, None, [], []
                if event == "lost":
                    lost = at
                elif event == "return":
                    while days and -days[-1] <= day:
                        days.pop()
                        returns.pop()
                    days.append(-day)
                    returns.append(at)
                else:
                    found = bisect_right(days, -day)
                    asked.append(place)
                    backs.append(returns[found - 1] if found else None)
                    losses.append(lost)
            kept = batch.take(pa.array(asked, pa.int64())).select(columns)
            yield pa.record_batch([*kept.columns, pa.array(backs, pa.int64()), pa.array(losses, pa.int64())], [*columns, "_back", "_lost"])

    return follow


def _request_facts(
    tables: Collection, asked: DataFrame, closings: DataFrame, as_of: date
) -> DataFrame:
    """``asked`` with its book, student and dates, as far as they do not depend on other requests.

    ``closings``: the loans that were open before the batch and the ``seq`` that ends each. A book's
    older loan keeps it out up to ``_out_until``; ``room`` is the student's room at the request but for
    new loans, and ``tight`` says whether so many requests come before it that they may fill the room.
    """
    open_loans = pin(tables.loans.where(is_open()).select("loan_id", "book_id", "student_id"))
    out = (
        by_key(open_loans, asked, "book_id")
        .join(apart(closings), "loan_id", "left")
        .groupBy("book_id")
        .agg(F.max(F.coalesce("_closed", F.lit(NEVER))).alias("_out_until"))
    )
    books = (
        by_key(tables.books, asked, "book_id")
        .select("book_id", F.col("status").alias("_book_status"), F.col("book_type").alias("_book_type"))
        .join(out, "book_id", "left")
    )
    held = by_key(open_loans, asked, "student_id").groupBy("student_id").agg(F.count("*").alias("_held"))
    students = (
        by_key(tables.students, asked, "student_id")
        .select("student_id", F.col("status").alias("_student_status"))
        .join(held, "student_id", "left")
    )
    default_due = due_date(F.col("loan_date"), F.col("_book_type"))
    facts = pin(
        asked.select(
            "seq", "loan_id", "book_id", "student_id",
            F.coalesce("event_date", F.lit(as_of)).alias("loan_date"),
            F.col("new_due").alias("estimated_return_date"),
        )
        .join(apart(books), "book_id", "left")
        .join(apart(students), "student_id", "left")
        .withColumn("estimated_return_date", F.coalesce("estimated_return_date", default_due))
        .withColumn("_broken", first_broken(loan_period_rules(as_of)))
    )
    # One running total counts both the loans given back and the requests before each request.
    given_back = open_loans.join(apart(closings), "loan_id").join(
        apart(students.select("student_id")), "student_id", "left_semi"
    )
    line = facts.where("student_id is not null").select(
        "student_id", "seq", (F.col("seq") * 2).alias("_at"), F.lit(_BATCH).alias("_step")
    )
    line = line.union(
        given_back.select("student_id", F.lit(None).cast("long"), F.col("_closed") * 2 + 1, F.lit(1))
    )
    totals = running_total(line, ["student_id"], "_at", F.col("_step"), "_total").where("seq is not null")
    totals = totals.select("seq", "_total")
    room = MAX_OPEN_LOANS - F.coalesce("_held", F.lit(0)) + F.coalesce(F.col("_total") % _BATCH, F.lit(0))
    return facts.join(apart(totals), "seq", "left").withColumns(
        {"room": room, "tight": F.floor(F.col("_total") / _BATCH) - 1 >= room}
    ).drop("_total")


def _refusals(facts: DataFrame, granted: DataFrame, changes: DataFrame) -> DataFrame:
    """``facts`` with the ``reason`` each request was refused for, null if granted.

    Every request is judged on the state before it: the last change of its book's status, the loans its
    student then had, and whether its key was in use.
    """
    taken = granted.select(F.col("unique").alias("loan_id"), F.col("seq").alias("_taken_at"))
    number = F.create_map(*[x for i, s in enumerate(("available", "loaned", "lost")) for x in (F.lit(s), F.lit(i))])
    told = changes.select("book_id", (F.col("seq") * 2 + 1).alias("_at"), (F.col("seq") * 4 + number[F.col("status")]).alias("_told"))
    line = facts.where("_book_status is not null").select("book_id", "seq", (F.col("seq") * 2).alias("_at"), F.lit(None).cast("long").alias("_told"))
    line = line.unionByName(told.withColumn("seq", F.lit(None).cast("long")))
    told = running_max(line, ["book_id"], "_at", F.col("_told"), "_last").where("seq is not null").select("seq", "_last")
    claims = granted.select(F.col("pool").alias("student_id"), F.lit(None).cast("long").alias("seq"), (F.col("seq") * 2 + 1).alias("_at"), F.lit(1).alias("_step"))
    claims = claims.union(
        granted.where(F.col("ends") < NEVER).select("pool", F.lit(None).cast("long"), F.col("ends") * 2 + 1, F.lit(-1))
    )
    line = facts.where("student_id is not null").select("student_id", "seq", (F.col("seq") * 2).alias("_at"), F.lit(0).alias("_step"))
    held = running_total(line.union(claims), ["student_id"], "_at", F.col("_step"), "_new").where("seq is not null").select("seq", "_new")
    status = F.when(F.col("_last").isNull(), F.col("_book_status")).otherwise(
        F.element_at(F.array(F.lit("available"), F.lit("loaned"), F.lit("lost")), (F.pmod(F.col("_last"), F.lit(4)) + 1).cast("int"))
    )
    reason = (
        F.when(F.col("loan_id").isNull(), "loan_id_missing")
        .when(F.col("_taken_at") < F.col("seq"), "loan_exists")
        .when(F.col("_book_status").isNull(), "book_not_found")
        .when(status != "available", "book_unavailable")
        .when(F.col("_student_status").isNull(), "student_not_found")
        .when(F.col("_student_status") != "active", "student_inactive")
        .when(F.coalesce("_new", F.lit(0)) >= F.col("room"), "loan_limit")
        .when(F.col("_out_until") > F.col("seq"), "book_on_loan")
        .otherwise(F.col("_broken"))
    )
    return (
        facts.join(apart(taken), "loan_id", "left")
        .join(apart(told), "seq", "left")
        .join(apart(held), "seq", "left")
        .withColumn("reason", reason)
    )


def apply_events(
    tables: Collection, events: DataFrame, as_of: date, moment: datetime, run: int = 1_000_000
) -> EventOutcome:
    """The outcome of a batch of events on the current tables, as if they came one by one by ``seq``.

    Events on loans that exist depend on nothing else and are folded first; they say when books and
    students' places come free. New loans are then admitted with the ends their own events give them
    (``intervals.grant_intervals``), and the events behind an admitted loan are folded onto it. Where a
    stream is cut into batches makes no difference, nor does ``run``, about how many requests one task
    decides in order. Requests without a ``loan_id`` are refused.
    """
    is_loan = F.col("event") == "loan"
    asked, others = events.where(is_loan), events.where(~is_loan)
    existing = pin(by_key(tables.loans, events, "loan_id").select(*tables.loans.columns))
    on_existing = others.join(existing.select("loan_id"), "loan_id", "left_semi")
    on_fresh = pin(others.join(existing.select("loan_id"), "loan_id", "left_anti").select(*events.columns))
    folded, folded_result, folded_changes = fold_events(existing, on_existing, moment)
    folded, folded_changes = pin(folded), pin(folded_changes)

    repeated = asked.join(existing.select("loan_id"), "loan_id", "left_semi")
    closings = (
        folded_result.where("accepted and event in ('return', 'lost')")
        .join(existing.where(is_open()).select("loan_id"), "loan_id", "left_semi")
        .groupBy("loan_id")
        .agg(F.min("seq").alias("_closed"))
    )
    new = asked.join(existing.select("loan_id"), "loan_id", "left_anti")
    facts = pin(_request_facts(tables, new, pin(closings), as_of))
    eligible = facts.where(
        F.col("loan_id").isNotNull()
        & F.col("_book_status").isNotNull()
        & (F.col("_student_status") == "active")
        & (F.coalesce("_out_until", F.lit(-NEVER)) < F.col("seq"))
        & F.col("_broken").isNull()
        & (F.col("room") > 0)
    )
    effects = folded_changes.withColumn("status", book_status_effect()).where("status is not null")
    before_all = F.lit(-NEVER).alias("at")
    states = pin(
        eligible.groupBy("book_id")
        .agg(F.first("_book_status").alias("status"))
        .select(F.col("book_id").alias("key"), before_all, (F.col("status") == "available").alias("free"))
        .unionByName(
            effects.select(F.col("book_id").alias("key"), F.col("seq").alias("at"), (F.col("status") == "available").alias("free"))
        )
    )
    granted = grant_intervals(
        eligible.select(
            "seq", F.col("book_id").alias("key"), F.col("loan_id").alias("unique"),
            F.col("student_id").alias("pool"), "room", "tight", "loan_date",
        ),
        states,
        lambda ready: _lives(ready, on_fresh),
        run,
    )
    granted = pin(granted)
    steps = granted.select(F.col("key").alias("book_id"), F.posexplode("states").alias("_place", "_state"))
    steps = steps.select(
        "book_id",
        F.col("_state.at").alias("seq"),
        F.when(F.col("_state.free"), "available").when(F.col("_place") == 0, "loaned").otherwise("lost").alias("status"),
    )
    decided = pin(
        _refusals(facts, granted, steps.unionByName(effects.select("book_id", "seq", "status")))
    )
    stamp = timestamp(moment)
    admitted = decided.where("reason is null").withColumns(
        {
            "actual_return_date": F.lit(None).cast("date"),
            "loan_status": F.lit("active"),
            "renewal_count": F.lit(0),
            "notes": F.lit(None).cast("string"),
            "created_at": F.lit(None).cast("timestamp_ntz") if stamp is None else stamp,
            "updated_at": F.lit(None).cast("timestamp_ntz") if stamp is None else stamp,
        }
    )
    fresh = pin(
        admitted.select(
            "seq", *[F.col(c).cast(tables.loans.schema[c].dataType).alias(c) for c in tables.loans.columns]
        )
    )
    started = fresh.select("loan_id", F.col("seq").alias("_from"))
    timed = pin(on_fresh.join(apart(started), "loan_id", "left"))
    behind = timed.where(F.col("_from") < F.col("seq")).select(*events.columns)
    early = timed.where(F.col("_from").isNull() | (F.col("_from") >= F.col("seq")))
    new_loans = fresh.select(*tables.loans.columns)
    late, late_result, late_changes = fold_events(new_loans, behind, moment)
    fresh_after = new_loans.join(late.select("loan_id"), "loan_id", "left_anti").select(
        *new_loans.columns
    ).unionByName(late)

    # Only the books this batch is about can change.
    books_named = asked.select("book_id").unionByName(existing.select("book_id")).distinct()
    books_before = pin(
        tables.books.join(books_named, "book_id", "left_semi").select(*tables.books.columns)
    )
    opened = fresh.select(
        "seq", "book_id", F.lit(None).cast("string").alias("old_status"),
        F.col("loan_status").alias("new_status"),
    )
    books = derive_book_status(
        books_before, folded_changes.unionByName(opened).unionByName(late_changes), moment
    )
    loans = folded.unionByName(fresh_after)
    refused = lambda rows, reason: rows.select(
        "seq", "event", "loan_id", F.lit(False).alias("accepted"), F.lit(reason).alias("reason")
    )
    loan_result = decided.select(
        "seq", F.lit("loan").alias("event"), "loan_id", F.col("reason").isNull().alias("accepted"), "reason"
    )
    result = (
        folded_result.unionByName(loan_result)
        .unionByName(refused(repeated, "loan_exists"))
        .unionByName(refused(early, "loan_not_found"))
        .unionByName(late_result)
    )
    loans_before = existing.join(folded.select("loan_id"), "loan_id", "left_semi")
    audit = audit_diff(
        loans_before.select(*loans.columns), loans, "loans", moment
    ).unionByName(audit_diff(books_before, books, "books", moment))
    return EventOutcome(result, loans, books, audit)


def run_loan_events(
    spark: SparkSession,
    source: str,
    ledger: Ledger,
    as_of: date,
    moment: datetime,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Follow event files in ``source`` and keep the ledger current; returns the running query."""
    reader = spark.readStream.schema(LOAN_EVENTS).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def on_batch(events: DataFrame, batch: int) -> None:
        outcome = apply_events(ledger.current(before_batch=batch), pin(events), as_of, moment)
        ledger.write(outcome.result, "results", batch)
        ledger.write(outcome.audit, "audit", batch)
        ledger.write(outcome.books, "books", batch)
        ledger.write(outcome.loans, "loans", batch)

    writer = (
        reader.load(source)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{ledger.root}/stream")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
