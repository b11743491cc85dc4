"""Placing books on shelves within capacity, and keeping the shelves' counts true."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import capacity
from lectern.operators.changes import touched
from lectern.operators.lookup import by_key
from lectern.operators.quality import first_broken, strict_rules
from lectern.operators.running import running_total
from lectern.operators.runs import granted_in_runs, marked
from lectern.plans.views import physical_books, shelf_sizes
from lectern.session import apart, pin
from lectern.sources.collection import Collection


def _needs_shelf() -> Column:
    return (F.col("book_type") == "physical") & F.col("shelf_id").isNotNull()


def _free(tables: Collection) -> DataFrame:
    return tables.shelves.select("shelf_id", capacity.available_space().alias("_free"))


def place_books(tables: Collection, placements: DataFrame, as_of: date) -> DataFrame:
    """Decide ``seq, <books columns>`` in order; adds ``accepted`` and ``reason``.

    A physical book needs an existing shelf with room left by the ones before it. A book that breaks
    a rule of its own takes no room. Shelves of any size are handled: ranks come from running totals
    that cut a hot shelf's queue into slices.
    """
    broken = first_broken(strict_rules("books", as_of))
    facts = pin(
        placements.join(_free(tables), "shelf_id", "left")
        .withColumn("_broken", broken)
        .select(*placements.columns, "_free", "_broken")
    )
    waiting = facts.where(_needs_shelf() & F.col("_free").isNotNull())
    rest = facts.where(~F.coalesce(_needs_shelf() & F.col("_free").isNotNull(), F.lit(False)))
    sound = F.when(F.col("_broken").isNull(), 1).otherwise(0)
    ranked = running_total(waiting, ["shelf_id"], "seq", sound, "_place")
    # A sound book needs its own place to exist, an unsound one only meets a full shelf.
    full = (F.col("_place") - sound) >= F.col("_free")
    queued = ranked.withColumn(
        "reason", F.when(full, "shelf_full").otherwise(F.col("_broken"))
    )
    unknown = _needs_shelf() & F.col("_free").isNull()
    others = rest.withColumn(
        "reason", F.when(unknown, "shelf_not_found").otherwise(F.col("_broken"))
    )
    columns = [*placements.columns, "reason"]
    return (
        queued.select(*columns)
        .unionByName(others.select(*columns))
        .withColumn("accepted", F.col("reason").isNull())
    )


_SIDE = 2**32


def _bounds(open_moves: DataFrame) -> DataFrame:
    """Adds ``_on`` (the shelf before the batch), ``_most`` and ``_least`` to moves.

    ``_most`` and ``_least`` bound how many books the wanted shelf has gained before the move: a move counts
    as an arrival for the one and as a departure for the other. Both are sums along the shelf's line of
    moves, so a shelf or a book with very many moves is cut into slices.
    """
    placed = open_moves.withColumn("_on", F.col("_from"))
    moves_on = ~F.col("shelf_id").eqNullSafe(F.col("_on"))

    def entry(when: Column, shelf: str, seq: Column, later: int, step: int) -> Column:
        return F.when(
            when,
            F.struct(
                F.col(shelf).alias("shelf_id"), seq.cast("long").alias("seq"),
                (F.col("seq") * 2 + later).alias("_at"), F.lit(step).cast("long").alias("_step"),
            ),
        )

    entries = F.array_compact(
        F.array(
            entry(moves_on, "shelf_id", F.lit(None), 1, _SIDE),
            entry(moves_on & F.col("_on").isNotNull(), "_on", F.lit(None), 1, -1),
            entry(F.lit(True), "shelf_id", F.col("seq"), 0, 0),
        )
    )
    totals = running_total(placed.select(F.inline(entries)), ["shelf_id"], "_at", F.col("_step"), "_total")
    least = F.pmod(F.col("_total") + _SIDE // 2, F.lit(_SIDE)) - _SIDE // 2
    totals = totals.where("seq is not null").select(
        "seq", ((F.col("_total") - least) / _SIDE).cast("long").alias("_most"), least.alias("_least")
    )
    return placed.join(apart(totals), "seq")


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``seq`` and ``accepted`` of moves that come in order."""
    place, gained = {}, {}
    for batch in batches:
        seqs, verdicts = [], []
        for seq, book, shelf, on, room in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            on = place.get(book, on)
            moves = on != shelf
            accepted = not moves or room > gained.get(shelf, 0)
            if accepted and moves:
                gained[shelf] = gained.get(shelf, 0) + 1
                if on is not None:
                    gained[on] = gained.get(on, 0) - 1
                place[book] = shelf
            seqs.append(seq)
            verdicts.append(accepted)
        yield pa.record_batch([pa.array(seqs, pa.int64()), pa.array(verdicts, pa.bool_())], ["seq", "accepted"])


def _decide_moves(sound: DataFrame, run: int) -> DataFrame:
    """``seq`` and ``accepted`` of sound moves, as if made one after another.

    A batch of no more than a run is decided by one task. Of a larger one, a move is refused at once if its
    shelf has no place even if every open departure before it happens and no open arrival does, and the book
    cannot be on that shelf already. Moves that wait for a place another one leaves may form chains of any
    length, so the others are decided in order, run by run.
    """
    pending = pin(sound.select("seq", "book_id", "shelf_id", "_from", "_free"))
    if pending.count() <= run:
        line = pending.repartition(1).sortWithinPartitions("seq")
        decided = pin(line.mapInArrow(_one_by_one, "seq long, accepted boolean"))
        return pending.select("seq").join(apart(decided), "seq", "left").select("seq", "accepted")
    left = _judged(_bounds(pending)).where("accepted is null or accepted")
    asks = left.select(
        "seq", F.col("book_id").cast("string").alias("row"), F.lit(True).alias("first"), F.lit(True).alias("later"),
        F.lit(True).alias("asks0"), F.col("_from").cast("string").alias("had0"), F.col("shelf_id").cast("string").alias("gets0"),
        F.col("_free").cast("long").alias("free0"),
    )
    return marked(pending, granted_in_runs(asks, 1, run), "accepted")


def _judged(bounded: DataFrame) -> DataFrame:
    """Open moves with bounds, and the ``accepted`` that both bounds agree on, else null."""
    open_ones = pin(bounded)
    stays = F.col("shelf_id").eqNullSafe(F.col("_on"))
    may = stays | (F.col("_free") > F.col("_least"))
    heads = open_ones.groupBy("book_id").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_head"))
    # Up to a book's first move to a shelf that may succeed, none to that shelf does.
    first = open_ones.where(may).groupBy("book_id", "shelf_id").agg(F.min("seq").alias("_first"))
    judged = open_ones.join(apart(heads), "seq", "left").join(apart(first), ["book_id", "shelf_id"], "left")
    verdict = F.when((F.col("_free") > F.col("_most")) | (stays & F.col("_head")), True).when(
        ~may & (F.col("_first").isNull() | (F.col("seq") < F.col("_first"))), False
    )
    return judged.withColumn("accepted", verdict)


def move_books(
    tables: Collection, moves: DataFrame, moment: datetime | None = None, run: int = 200_000
) -> tuple[Collection, DataFrame]:
    """Move physical books by ``seq, book_id, shelf_id``, one after another; ``(tables, result)``.

    A move needs a place on its shelf at its turn: those before it have taken theirs and left theirs
    behind. A book may move several times. A move to the shelf the book is on needs no place.
    ``run`` bounds how many moves one task decides in order at a time; it does not change the outcome.
    """
    books = by_key(tables.books, moves, "book_id").select(
        "book_id", "book_type", F.col("shelf_id").alias("_from"), F.lit(True).alias("_known")
    )
    facts = moves.join(apart(books), "book_id", "left").join(_free(tables), "shelf_id", "left")
    unsound = (
        F.when(F.col("_known").isNull(), "book_not_found")
        .when(F.col("book_type") != "physical", "book_not_physical")
        .when(F.col("shelf_id").isNull(), "shelf_required")
        .when(F.col("_free").isNull(), "shelf_not_found")
    )
    checked = pin(facts.withColumn("_unsound", unsound))
    decided = _decide_moves(checked.where(F.col("_unsound").isNull()), run)
    full = F.when(~F.col("accepted"), "shelf_full")
    result = pin(
        checked.join(apart(decided), "seq", "left")
        .withColumn("reason", F.coalesce("_unsound", full))
        .select("seq", "book_id", "shelf_id", "reason")
        .withColumn("accepted", F.col("reason").isNull())
    )
    done = result.where("accepted").groupBy("book_id").agg(F.max_by("shelf_id", "seq").alias("_to"))
    moved = F.col("_to").isNotNull()
    changes = {"shelf_id": F.coalesce("_to", "shelf_id"), **touched(moved, moment)}
    after = tables.books.join(done, "book_id", "left").withColumns(changes)
    after = after.select(*tables.books.columns)
    # Only the books that moved can change a shelf's count.
    before = by_key(tables.books, done, "book_id")
    deltas = shelf_deltas(before, by_key(after, done, "book_id"))
    shelves, _ = apply_shelf_deltas(tables.shelves, deltas, moment)
    return tables.with_tables(books=after, shelves=shelves), result


def shelf_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """``shelf_id, delta``: change of every shelf's physical books between two snapshots.

    Both sides are counted per shelf, so the books are never joined with each other.
    """

    def weighed(books: DataFrame, weight: int) -> DataFrame:
        return physical_books(books).select("shelf_id", F.lit(weight).alias("weight"))

    return (
        weighed(before, -1)
        .unionByName(weighed(after, 1))
        .groupBy("shelf_id")
        .agg(F.sum("weight").alias("delta"))
        .where("delta != 0")
    )


def apply_shelf_deltas(
    shelves: DataFrame, deltas: DataFrame, moment: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add deltas to the recorded counts; returns ``(shelves, result)``.

    A delta for an unknown shelf, below zero or beyond the capacity is refused and changes nothing.
    """
    totals = deltas.groupBy("shelf_id").agg(F.sum("delta").alias("delta"))
    room = shelves.select("shelf_id", "total_capacity", "current_book_count")
    count = F.col("current_book_count") + F.col("delta")
    reason = (
        F.when(F.col("total_capacity").isNull(), "shelf_not_found")
        .when(count < 0, "count_negative")
        .when(count > F.col("total_capacity"), "capacity_exceeded")
    )
    result = (
        totals.join(room, "shelf_id", "left")
        .withColumn("reason", reason)
        .select(
            "shelf_id",
            "delta",
            F.when(F.col("reason").isNull(), count).alias("new_count"),
            F.col("reason").isNull().alias("accepted"),
            "reason",
        )
    )
    changed = F.col("new_count").isNotNull()
    changes = {
        "current_book_count": F.coalesce("new_count", "current_book_count").cast("int"),
        **touched(changed, moment),
    }
    applied = result.where("accepted").select("shelf_id", "new_count")
    after = shelves.join(applied, "shelf_id", "left").withColumns(changes)
    return after.select(*shelves.columns), result


def fix_capacity_counts(tables: Collection, moment: datetime | None = None) -> DataFrame:
    """Shelves with every count taken anew from the books, 0 where there are none."""
    changes = {
        "current_book_count": F.coalesce("rows", F.lit(0)).cast("int"),
        **touched(F.lit(True), moment),
    }
    counted = tables.shelves.join(shelf_sizes(tables.books), "shelf_id", "left")
    return counted.withColumns(changes).select(*tables.shelves.columns)
