"""Deciding a batch of requests as if they came one after another, in rounds of set operations.

Requests carry a total order ``seq`` and claim
* unique keys, each of which only one request can get, and
* at most one place in a pool that has a given amount of room.

A request is granted when all its unique keys are free and its pool has room. In every round the
requests that no earlier undecided request can affect are granted; those that met a taken key or a
full pool leave. Requests that wait for each other may form chains of any length, so a round also
goes through a bounded run of the earliest undecided requests in one task. The outcome equals that of
the one-by-one loop.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.running import number_rows, running_total
from lectern.session import apart, pin

# Up to this room, Spark prunes ranked rows before the shuffle, so a plain window is enough.
_PRUNED_RANK = 1000


def _ranked(pending: DataFrame, pool: str, most_room: int | None) -> DataFrame:
    """``seq`` of the pending requests whose place in their pool's queue fits its room."""
    queued = pending.where(F.col(pool).isNotNull()).select("seq", pool, "_room")
    if most_room is not None and most_room <= _PRUNED_RANK:
        place = F.row_number().over(Window.partitionBy(pool).orderBy("seq"))
        placed = queued.withColumn("_place", place).where(F.col("_place") <= most_room)
    else:
        placed = running_total(queued, [pool], "seq", F.lit(1), "_place")
    fits = placed.where(F.col("_place") <= F.col("_room")).select("seq")
    return fits.unionByName(pending.where(F.col(pool).isNull()).select("seq"))


def _heads(pending: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` of the pending requests that are first for their key, or claim none.

    One row per key leaves each task, so a key asked for very often is no burden.
    """
    if columns == ["seq"]:
        row = F.struct(F.min("seq").alias("seq"))
    else:
        row = F.min_by(F.struct(*columns), "seq")
    first = pending.where(F.col(key).isNotNull()).groupBy(key).agg(row.alias("_row"))
    return first.select("_row.*").unionByName(pending.where(F.col(key).isNull()).select(*columns))


def _without(pending: DataFrame, granted: DataFrame, unique: Sequence[str]) -> DataFrame:
    """Pending requests that were not granted and whose unique keys are still free."""
    keyless = reduce(lambda a, b: a & b, [F.col(k).isNull() for k in unique], F.lit(True))
    # A granted request with a key leaves along with the others that claim the key.
    keyed = pending.where(~keyless)
    for key in unique:
        keyed = keyed.join(granted.select(key), key, "left_anti")
    free = pending.where(keyless).join(granted.where(keyless).select("seq"), "seq", "left_anti")
    columns = pending.columns
    return keyed.select(*columns).unionByName(free.select(*columns))


def grant(
    requests: DataFrame,
    unique: Sequence[str] = (),
    pool: str | None = None,
    room: str | None = None,
    most_room: int | None = None,
    run: int = 100_000,
) -> DataFrame:
    """The granted requests: ``seq`` with the ``unique`` and ``pool`` columns.

    ``room`` holds the free places of the request's pool, equal on all requests of one pool.
    ``most_room`` is an upper bound of it where one is known. Keys already taken before the batch
    must have been filtered out. ``run`` bounds how many requests one task decides in order at a time;
    it does not change the outcome.
    """
    claims = [*unique, *([pool] if pool else [])]
    columns = [F.col("seq"), *[F.col(c) for c in claims]]
    if pool:
        columns.append(F.col(room).cast("long").alias("_room"))
    pending = requests.select(*columns)
    if pool:
        pending = pending.where(F.col(pool).isNull() | (F.col("_room") > 0))
    pending = pin(pending)
    rounds = []
    while n_open := pending.count():
        if n_open > run:
            granted = pin(_unaffected(pending, unique, pool, most_room, claims))
            rounds.append(granted)
            pending = pin(_left(pending, granted, unique, pool))
        earliest = pending
        if n_open > run:
            earliest = pin(number_rows(pending, "seq", "_place").where(F.col("_place") <= run).drop("_place"))
        granted = pin(_in_order(earliest, unique, pool))
        rounds.append(granted)
        if n_open <= run:
            break
        last = earliest.agg(F.max("seq")).first()[0]
        if last is None:
            break
        pending = pin(_left(pending.where(F.col("seq") > last), granted, unique, pool))
    if not rounds:
        return pending.select("seq", *claims)
    return reduce(DataFrame.unionByName, rounds)


def _unaffected(
    pending: DataFrame, unique: Sequence[str], pool: str | None, most_room: int | None, claims: list[str]
) -> DataFrame:
    """The pending requests that no earlier one can affect."""
    ready = _heads(pending, unique[0], ["seq", *claims]) if unique else pending
    for key in unique[1:]:
        ready = ready.join(_heads(pending, key, ["seq"]), "seq", "left_semi")
    if pool:
        ready = ready.join(_ranked(pending, pool, most_room), "seq", "left_semi")
    return ready.select("seq", *claims)


def _left(pending: DataFrame, granted: DataFrame, unique: Sequence[str], pool: str | None) -> DataFrame:
    """The pending requests that may still be granted, with the room left to them."""
    left = _without(pending, granted, unique)
    if pool:
        used = granted.groupBy(pool).agg(F.count("*").alias("_used"))
        left = (
            left.join(apart(used), pool, "left")
            .withColumn("_room", F.col("_room") - F.coalesce("_used", F.lit(0)))
            .where(F.col(pool).isNull() | (F.col("_room") > 0))
        )
    return left.select(*pending.columns)


def _in_order(earliest: DataFrame, unique: Sequence[str], pool: str | None) -> DataFrame:
    """The requests to grant, of the earliest pending ones, one after another in one task.

    A later request that was granted before left room for all pending ones before it, so the room at
    hand is the room of each.
    """
    keys = list(unique)

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, used = [set() for _ in keys], {}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            rooms = columns.get("_room", [None] * len(batch))
            pools = columns[pool] if pool else [None] * len(batch)
            kept = []
            for claimed, place, room in zip(zip(*(columns[k] for k in ["seq", *keys]), strict=True), pools, rooms, strict=True):
                claimed = claimed[1:]
                fits = place is None or used.get(place, 0) < room
                granted = fits and not any(k in seen for k, seen in zip(claimed, taken, strict=True))
                kept.append(granted)
                if granted:
                    used[place] = used.get(place, 0) + 1
                    for k, seen in zip(claimed, taken, strict=True):
                        if k is not None:
                            seen.add(k)
            yield batch.filter(pa.array(kept, pa.bool_())).select([c for c in batch.schema.names if c != "_room"])

    schema = earliest.drop("_room").schema
    return earliest.repartition(1).sortWithinPartitions("seq").mapInArrow(one_by_one, schema)
