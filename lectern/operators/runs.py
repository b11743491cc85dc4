"""Deciding requests for values in order, in bounded runs.

A request is about a row, which holds one value per kind, and asks for other values for it. A value has
places; a row that gets another value leaves its place behind. Such requests may wait for each other in
chains of any length, so they are decided in order, by a task per run. What a run needs of the runs
before it are the values its rows got and the places its values gained, looked up in a log of what was
granted. Every request is written once and read once, so the work grows with the requests; of the log,
a run scans what was granted so far and keeps what it asks about.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.running import number_rows
from lectern.session import apart, pin, scratch_path

# Kinds of log entries: a request was granted, a row has a value of kind i (2i), a value of kind i gained (2i + 1).
_GRANTED = -1
_LOG = "tag int, name string, seq long, value string, step long"


def granted_in_runs(requests: DataFrame, kinds: int, run: int) -> DataFrame:
    """``seq`` of the granted requests.

    ``requests``: unique ``seq``; ``row`` as text; ``first`` and ``later``, whether the request is sound
    while nothing was granted to its row and afterwards; and for each kind ``asks<i>``, ``had<i>`` (the row's value before all requests), ``gets<i>``
    and ``free<i>`` (places of that value before all requests, null for no limit). ``run`` bounds how many
    requests one task decides; it does not change the outcome. A task keeps the values it meets, not the
    requests.
    """
    spark, folder = requests.sparkSession, scratch_path(requests.sparkSession, "runs")
    requests = requests.where("first or later")
    numbered = number_rows(pin(requests), "seq", "_place")
    placed = numbered.withColumn("_run", F.floor((F.col("_place") - 1) / run).cast("int")).drop("_place")
    placed.repartition("_run").write.partitionBy("_run").parquet(f"{folder}/requests")
    # Below a folder of partitions there is a row's run; an empty table has none.
    last = spark.read.schema(f"{_ddl(requests)}, _run int").parquet(f"{folder}/requests").agg(F.max("_run")).first()[0]
    granted = spark.createDataFrame([], _LOG)
    for k in range(0 if last is None else last + 1):
        part = spark.read.schema(requests.schema).parquet(f"{folder}/requests/_run={k}")
        line = part.withColumn("_late", F.lit(1))
        if k:
            wanted = part.select(F.inline(_wanted(kinds))).where("name is not null").distinct()
            # At most a few names per request of the run.
            known = granted.join(F.broadcast(wanted), ["tag", "name"], "left_semi").groupBy("tag", "name").agg(
                F.max_by("value", "seq").alias("value"), F.sum("step").alias("step")
            )
            line = line.unionByName(known.withColumn("_late", F.lit(0)), allowMissingColumns=True)
        decided = line.repartition(1).sortWithinPartitions("_late", "seq").mapInArrow(_decider(kinds), _LOG)
        decided.write.mode("append").parquet(f"{folder}/granted")
        granted = spark.read.schema(_LOG).parquet(f"{folder}/granted")
    return granted.where(F.col("tag") == _GRANTED).select("seq")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _wanted(kinds: int):
    names = [F.struct(F.lit(_GRANTED).alias("tag"), F.when(~F.col("first") | ~F.col("later"), F.col("row")).alias("name"))]
    for i in range(kinds):
        names.append(F.struct(F.lit(2 * i).alias("tag"), F.when(F.col(f"asks{i}"), F.col("row")).alias("name")))
        names.append(F.struct(F.lit(2 * i + 1).alias("tag"), F.when(F.col(f"asks{i}"), F.col(f"gets{i}")).alias("name")))
    return F.array(*names)


def _listed(column: pa.Array) -> list:
    if column.null_count == len(column):
        return [None] * len(column)
    plain = not column.null_count and not pa.types.is_string(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _decider(kinds: int):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        begun: set[str] = set()
        has: list[dict] = [{} for _ in range(kinds)]
        gained: list[dict] = [{} for _ in range(kinds)]
        for batch in batches:
            columns = {name: _listed(batch.column(name)) for name in batch.schema.names}
            out: list[tuple] = []
            asked = [tuple(columns[f"{c}{i}"] for c in ("asks", "had", "gets", "free")) for i in range(kinds)]
            requests = zip(*(columns[c] for c in ("_late", "seq", "row", "first", "later")), strict=True)
            for at, (late, seq, row, first, later) in enumerate(requests):
                if not late:
                    tag, name = columns["tag"][at], columns["name"][at]
                    if tag == _GRANTED:
                        begun.add(name)
                    elif tag % 2:
                        gained[tag // 2][name] = columns["step"][at]
                    else:
                        has[tag // 2][name] = columns["value"][at]
                    continue
                if not (first if first == later or row not in begun else later):
                    continue
                steps = []
                for i, (asks, had, gets, free) in enumerate(asked):
                    if not asks[at]:
                        continue
                    old, new = has[i].get(row, had[at]), gets[at]
                    if old == new:
                        continue
                    if new is not None and free[at] is not None and free[at] <= gained[i].get(new, 0):
                        break
                    steps.append((i, old, new))
                else:
                    begun.add(row)
                    out.append((_GRANTED, row, seq, None, 0))
                    for i, old, new in steps:
                        has[i][row] = new
                        out.append((2 * i, row, seq, new, 0))
                        for value, step in ((old, -1), (new, 1)):
                            if value is not None:
                                gained[i][value] = gained[i].get(value, 0) + step
                                out.append((2 * i + 1, value, seq, None, step))
            types = (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64())
            lists = zip(*out, strict=True) if out else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(lists, types, strict=True)], ["tag", "name", "seq", "value", "step"])

    return decide


def marked(requests: DataFrame, granted: DataFrame, name: str) -> DataFrame:
    """``seq`` of every request, and whether it was granted."""
    granted = granted.withColumn("_granted", F.lit(True))
    found = requests.select("seq").join(apart(granted), "seq", "left")
    return pin(found.select("seq", F.col("_granted").isNotNull().alias(name)))
