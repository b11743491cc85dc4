"""Deciding requests whose claims end at known points, as if they came one after another.

A request, once granted at its ``seq``, holds
* its unique key for good,
* its key (one holder at a time) up to ``held_until``, and
* a place in its pool up to ``ends``.

What would end a claim is known before anything is decided, only whether the claim comes about is not.
A key also has a state, free or not, which changes at known points and by the grants themselves; a
request needs the state before it to be free.

Requests may wait for each other in chains of any length, so they are decided in order, run by run, by a
task per run. Every request is written once and read once, so the work grows with the requests. What a
run needs of the runs before it, it looks up in what was granted: the unique keys that are taken, the
last state and the holder of its keys, and the places of its pools.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import apart, pin, scratch_path

NEVER = 2**62

# Kinds of rows a run reads, in this order.
_KEY, _UNIQUE, _POOL, _REQUEST = range(4)


def _mark(at: Column, free: Column) -> Column:
    """A change of a key as one number: twice its point, plus one if the key is free then."""
    return at * 2 + free.cast("long")


def _decider(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The granted requests of a run that comes in order, behind what was granted before it."""
        taken, until, told, coming, held = set(), {}, {}, {}, {}
        granted_last = None
        for batch in batches:
            granted = []
            plain = ("_kind", "seq", "key", "unique", "pool", "_known", "_limit", "ends", "held_until")
            lists, marks = [batch.column(c).to_pylist() for c in plain], batch.column("_marks")
            for at, (kind, seq, key, unique, pool, known, limit, ends, held_until) in enumerate(zip(*lists, strict=True)):
                if kind != _REQUEST:
                    if kind == _UNIQUE:
                        taken.add(unique)
                    elif kind == _POOL:
                        held[pool] = sorted(marks[at].as_py())
                    else:
                        if known is not None:
                            told[key] = known
                        if held_until is not None:
                            until[key] = held_until
                        coming[key] = sorted(marks[at].as_py())
                    continue
                if seq == granted_last:
                    # A repeated row of the request.
                    granted.append(at)
                    continue
                ahead = coming.get(key)
                while ahead and ahead[0] < 2 * seq:
                    told[key] = heapq.heappop(ahead)
                last = told.get(key, known)
                if last is None or last % 2 == 0 or unique in taken or until.get(key, seq - 1) >= seq:
                    continue
                places = held.setdefault(pool, [])
                while places and places[0] < seq:
                    heapq.heappop(places)
                if limit is not None and len(places) >= limit:
                    continue
                granted.append(at)
                granted_last = seq
                taken.add(unique)
                heapq.heappush(places, ends)
                until[key] = held_until
                ahead = coming.setdefault(key, [])
                for mark in marks[at].as_py():
                    heapq.heappush(ahead, mark)
            yield batch.take(pa.array(granted, pa.int64())).select(columns)

    return decide


def _before(part: DataFrame, granted: DataFrame | None, moving: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """What a run has to know: of its keys, unique keys and pools, as rows before its requests.

    The run's requests come behind ``low``, up to ``high``; None is no bound.
    """
    low = -NEVER if low is None else low
    none = F.lit(None).cast("long")
    changes = moving.select("key", "mark", none.alias("held_until"))
    if granted is not None:
        changes = changes.unionByName(granted.select("key", F.explode("_marks").alias("mark"), "held_until"))
    mine = lambda rows, name: rows.join(apart(part.select(name).distinct()), name, "left_semi")
    mark = F.col("mark")
    if high is not None:
        changes = changes.where(mark < 2 * high)
    # No request of the run has ``low`` itself, so a mark at it lies before all of them.
    found = mine(changes, "key").groupBy("key").agg(
        F.max(F.when(mark < 2 * low + 2, mark)).alias("_known"),
        F.max("held_until").alias("held_until"),
        F.collect_list(F.when(mark >= 2 * low + 2, mark)).alias("_marks"),
    )
    found = found.withColumn("_kind", F.lit(_KEY))
    if granted is None:
        return found
    uniques = mine(granted.select("unique"), "unique").distinct().withColumn("_kind", F.lit(_UNIQUE))
    pools = mine(granted.where(F.col("ends") > low).select("pool", "ends"), "pool").groupBy("pool")
    pools = pools.agg(F.collect_list("ends").alias("_marks")).withColumn("_kind", F.lit(_POOL))
    return found.unionByName(uniques, allowMissingColumns=True).unionByName(pools, allowMissingColumns=True)


def grant_intervals(
    requests: DataFrame,
    states: DataFrame,
    lives: Callable[[DataFrame], DataFrame],
    run: int = 1_000_000,
) -> DataFrame:
    """The granted requests with what ``lives`` says about them.

    ``requests``: ``seq``, ``key``, ``unique``, ``pool``, ``room`` (places of the pool at ``seq`` but for
    this batch's grants), ``tight`` (false if the pool cannot run short before the request), and further
    columns. ``states``: ``key``, ``at``, ``free``: the known changes of keys. ``lives`` adds to requests
    ``ends``, ``held_until`` (``NEVER`` for no end) and ``states``, an array of (``at``, ``free``): how
    the request would change its key. ``run`` is about how many requests one task decides in order; it
    does not change the outcome. A task keeps what it granted and what it looked up, not the requests.
    """
    asked = pin(lives(requests))
    columns = [c for c in asked.columns if c != "states"]
    n, first = asked.agg(F.count("*"), F.min("seq")).first()
    if not n:
        return asked
    marked = states.select("key", "at", _mark(F.col("at"), F.col("free")).alias("mark"))
    # What a key is before the first request goes with the requests.
    known = marked.where(F.col("at") < first).groupBy("key").agg(F.max("mark").alias("_known"))
    moving = pin(marked.where(F.col("at") >= first).select("key", "mark"))
    line = asked.join(apart(known), "key", "left").select(
        *columns,
        "_known",
        F.when(F.col("tight"), F.col("room")).alias("_limit"),
        F.transform("states", lambda s: _mark(s["at"], s["free"])).alias("_marks"),
        F.lit(_REQUEST).alias("_kind"),
    )
    log = [*columns, "_marks"]
    schema = line.select(*log).schema

    def decided(part: DataFrame, granted: DataFrame | None, low: int | None, high: int | None) -> DataFrame:
        rows = part.unionByName(_before(part, granted, moving, low, high), allowMissingColumns=True)
        return rows.repartition(1).sortWithinPartitions("_kind", "seq").mapInArrow(_decider(log), schema)

    states_again = F.transform("_marks", lambda m: F.struct(F.shiftright(m, 1).alias("at"), (m % 2 != 0).alias("free"))).alias("states")
    if n <= run:
        return decided(line, None, None, None).select(*columns, states_again)
    spark, folder = asked.sparkSession, scratch_path(asked.sparkSession, "intervals")
    runs = -(-n // run)
    cuts = asked.agg(F.percentile_approx("seq", [i / runs for i in range(1, runs)], 100_000)).first()[0]
    cuts = sorted(set(cuts))
    number = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda at, cut: at + (F.col("seq") > cut).cast("int"))
    line.withColumn("_run", number).repartition("_run").write.partitionBy("_run").parquet(f"{folder}/requests")
    placed = spark.read.schema(T.StructType([*line.schema, T.StructField("_run", T.IntegerType())])).parquet(f"{folder}/requests")
    granted = None
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = placed.where(F.col("_run") == k).drop("_run")
        decided(part, granted, low, high).write.mode("append").parquet(f"{folder}/granted")
        granted = spark.read.schema(schema).parquet(f"{folder}/granted")
    return granted.select(*columns, states_again)
