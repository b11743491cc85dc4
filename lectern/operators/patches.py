"""Patches of rows, each judged as if the accepted ones before it had been applied.

A patch is judged by the rules of its table on the row it leads to, by the rows it refers to, by unique
values, and, for books, by the room of the shelf. A unique value is a pool with one place and a shelf one
with as many as it has, so both are counted on one time line per value: who takes it and who leaves it.

All verdicts are first assumed, then every patch is judged anew under the assumed ones of the patches
before it. Verdicts that come out as assumed are those of one patch after another, since the first is
judged under none. Patches that wait for each other's values may form chains of any length, so a round
also goes through a bounded run of the earliest open patches in order, in one task. A batch larger than a
run would take a round for each, so there the first verdicts assumed are not acceptance but those of all
patches in order, run by run; judging everything anew then confirms them, as a rule at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import capacity
from lectern.operators.changes import touched
from lectern.operators.lookup import by_key
from lectern.operators.quality import first_broken, strict_rules
from lectern.operators.running import largest_before, number_rows, running_total
from lectern.operators.runs import granted_in_runs, marked
from lectern.operators.shelving import apply_shelf_deltas
from lectern.schemas import NOT_NULL, PATCHABLE, PRIMARY_KEY, UNIQUE
from lectern.session import apart, pin
from lectern.sources.collection import Collection

_ROOM = "shelf_id"
_PAIR = ("book_type", _ROOM)
# A run of requests for values takes this many times as many as one of patches with their rows.
_COMPACT = 5


def _facts(
    tables: Collection, patches: DataFrame, table: str, fields: list[str], unique: list[str], as_of: date
) -> DataFrame:
    """Patches with the row they are about and what the batch cannot change.

    ``_new_<field>`` holds the value in a struct, null where the patch does not set the field.
    ``_free_<column>`` is the room of the value asked for before the batch.
    """
    key, base = PRIMARY_KEY[table], getattr(tables, table)
    kinds = {f.name: f.dataType for f in base.schema}

    def is_set(f: str) -> Column:
        return F.array_contains("set_fields", f) if "set_fields" in patches.columns else F.lit(True)

    asked = patches.select(
        "seq", key, *[F.when(is_set(f), F.struct(F.col(f).cast(kinds[f]).alias("value"))).alias(f"_new_{f}") for f in fields]
    )
    clean = first_broken(strict_rules(table, as_of)).isNull()
    known = by_key(base, asked, key).select(key, F.struct(*base.columns).alias("_row"), clean.alias("_clean"))
    facts = asked.join(apart(known), key, "left")
    for c in unique:
        wanted = facts.select(F.col(f"_new_{c}.value").alias(c)).where(F.col(c).isNotNull())
        held = by_key(base, wanted, c).groupBy(c).agg((1 - F.count(F.lit(1))).alias(f"_free_{c}"))
        held = held.withColumnRenamed(c, "_value")
        facts = facts.join(apart(held), F.col(f"_new_{c}.value") == F.col("_value"), "left").drop("_value")
        facts = facts.withColumn(f"_free_{c}", F.coalesce(f"_free_{c}", F.lit(1).cast("long")))
    missing = F.lit(None).cast("string")
    if _ROOM in fields:
        shelves = tables.shelves.select(
            F.col("shelf_id").alias("_value"), capacity.available_space().cast("long").alias(f"_free_{_ROOM}"), F.lit(True).alias("_found")
        )
        asks = F.col(f"_new_{_ROOM}.value")
        facts = facts.join(apart(by_key(shelves, facts.select(asks.alias("_value")), "_value")), asks == F.col("_value"), "left")
        missing = F.when(asks.isNotNull() & F.col("_found").isNull(), "shelf_not_found")
    sets = reduce(lambda a, b: a | b, [F.col(f"_new_{f}").isNotNull() for f in fields], F.lit(False))
    static = F.when(F.col("_row").isNull(), "not_found").when(~sets, "nothing_set")
    # Apart from a book's kind and shelf, no rule joins two columns that patches change.
    halves = [F.col(f"_new_{f}").isNotNull() for f in _PAIR if f in fields]
    own = F.col("_clean") & (halves[0] == halves[-1] if halves else F.lit(True))
    columns = [f"_new_{f}" for f in fields] + [f"_free_{c}" for c in [*unique, _ROOM] if c in fields]
    return facts.select("seq", key, "_row", *columns, static.alias("_static"), missing.alias("_missing"), own.alias("_own"))


def _asked(table: str, fields: list[str], unique: list[str], old: dict[str, Column], new: dict[str, Column]) -> list[tuple]:
    """Per kind of value: whether the patch asks, what the row had and gets, and the room of that before the batch."""
    asked = [(F.col(f"_new_{c}").isNotNull(), old[c], new[c], F.col(f"_free_{c}")) for c in unique]
    if table == "books" and any(f in fields for f in _PAIR):
        spot = [F.when(row["book_type"] == "physical", row["shelf_id"]) for row in (old, new)]
        free = F.col(f"_free_{_ROOM}") if _ROOM in fields else F.lit(None).cast("long")
        moves = reduce(lambda a, b: a | b, [F.col(f"_new_{f}").isNotNull() for f in _PAIR if f in fields])
        asked.append((moves, *spot, free))
    return asked


def _forecast(facts: DataFrame, table: str, fields: list[str], unique: list[str], as_of: date, run: int) -> DataFrame:
    """``seq`` and ``assumed``: the verdicts of all patches in order, but for kinds and shelves set one without the other.

    An accepted patch leaves its row clean. So up to the first one a patch is sound if it makes the row of
    before the batch clean, and afterwards if what it sets is.
    """
    rules, key = strict_rules(table, as_of), PRIMARY_KEY[table]
    columns = facts.schema["_row"].dataType.names
    old = {c: F.col(f"_row.{c}") for c in columns}
    new = {c: F.when(F.col(f"_new_{c}").isNull(), old[c]).otherwise(F.col(f"_new_{c}.value")) for c in fields}
    new = old | new
    # What a patch does not set is sound by then, or never.
    alone = {c: F.lit(None).cast(facts.schema["_row"].dataType[c].dataType) for c in columns}
    alone |= {c: old[c] for c in _PAIR if c in columns} | {c: F.col(f"_new_{c}.value") for c in fields}
    given = [r for r in rules if r.name not in {f"{c}_missing" for c in NOT_NULL[table]}]
    blanks = [F.col(f"_new_{c}").isNotNull() & F.col(f"_new_{c}.value").isNull() for c in NOT_NULL[table] if c in fields]
    sound = F.col("_missing").isNull() & ~reduce(lambda a, b: a | b, blanks, F.lit(False))
    asked = _asked(table, fields, unique, old, new)
    kept = [F.col(key).cast("string").alias("row"), sound.alias("sound")]
    for i, (asks, had, gets, free) in enumerate(asked):
        kept += [
            asks.alias(f"asks{i}"), had.cast("string").alias(f"had{i}"), gets.cast("string").alias(f"gets{i}"),
            free.cast("long").alias(f"free{i}"),
        ]
    later = F.col("_kept.sound") & first_broken(given).isNull()
    line = facts.select(
        "seq", "_own", "_row", "_missing", *[f"_new_{f}" for f in fields], F.struct(*kept).alias("_kept"),
        *[alone[c].alias(c) for c in columns],
    ).withColumn("later", later).drop(*columns)
    names = [f.name for f in line.schema["_kept"].dataType if f.name != "sound"]
    kept = [F.col(f"_kept.{n}") for n in names]
    # The rules on whole rows are asked only where the row of before the batch matters.
    plain = line.where("_own").select("seq", *kept, F.col("later").alias("first"), "later")
    others = line.where("not _own").select("seq", "_kept", "later", "_missing", *[new[c].alias(c) for c in columns])
    first = first_broken(rules).isNull() & F.col("_missing").isNull()
    line = plain.unionByName(others.select("seq", *kept, first.alias("first"), "later"))
    if asked:
        return marked(facts, granted_in_runs(line, len(asked), _COMPACT * run), "assumed")
    line = pin(line)
    begins = line.where("first and not later or later and not first").select("row").distinct()
    begins = line.where("first").join(apart(begins), "row", "left_semi").groupBy("row").agg(F.min("seq").alias("_begins"))
    later = F.coalesce(F.col("seq") > F.col("_begins"), F.lit(False))
    line = line.join(apart(begins), "row", "left")
    return pin(line.select("seq", F.when(later, F.col("later")).otherwise(F.col("first")).alias("assumed")))


def _judged(facts: DataFrame, assumed: DataFrame, table: str, fields: list[str], unique: list[str], as_of: date) -> DataFrame:
    """Every patch under the assumed verdicts of those before it.

    ``_broken`` is what its row or a reference is refused for, ``reason`` also counts values. ``_claims``
    tells per kind of value what the row had and gets, and the room of that before the batch.
    """
    key = PRIMARY_KEY[table]
    line = facts.join(apart(assumed), "seq")
    made = {
        f"_last_{f}": F.when(
            F.col("assumed") & F.col(f"_new_{f}").isNotNull(),
            F.struct(F.col("seq").alias("seq"), F.col(f"_new_{f}.value").alias("value")),
        )
        for f in fields
    }
    if fields:
        line = largest_before(line, [key], "seq", made)
    columns = facts.schema["_row"].dataType.names
    old, new = {}, {}
    for c in columns:
        old[c] = new[c] = F.col(f"_row.{c}")
        if c in fields:
            old[c] = F.when(F.col(f"_last_{c}").isNull(), old[c]).otherwise(F.col(f"_last_{c}.value"))
            new[c] = F.when(F.col(f"_new_{c}").isNull(), old[c]).otherwise(F.col(f"_new_{c}.value"))

    claims = [
        F.when(
            asks,
            F.struct(
                F.lit(i).alias("kind"), had.cast("string").alias("had"), gets.cast("string").alias("gets"), free.alias("free")
            ),
        )
        for i, (asks, had, gets, free) in enumerate(_asked(table, fields, unique, old, new))
    ]
    empty = F.array().cast("array<struct<kind:int,had:string,gets:string,free:bigint>>")
    rows = line.select(
        "seq", *[new[c].alias(c) for c in columns], "assumed", "_missing", "_own",
        (F.array_compact(F.array(*claims)) if claims else empty).alias("_claims"),
    )
    broken = F.coalesce(first_broken(strict_rules(table, as_of)), "_missing")
    judged = pin(rows.select("seq", key, "assumed", "_own", "_claims", broken.alias("_broken")))
    if not claims:
        return judged.withColumn("reason", F.col("_broken"))
    each = judged.select("seq", "assumed", F.inline("_claims")).where("not (had <=> gets)")

    def entries(value: str, when: Column, later: int, step: int, asks: bool) -> DataFrame:
        return each.where(when & F.col(value).isNotNull()).select(
            "kind", F.col(value).alias("value"), (F.col("seq") * 2 + later).alias("_at"), F.lit(step).alias("_step"),
            F.when(F.lit(asks), F.col("seq")).alias("seq"), F.when(F.lit(asks), F.col("free")).alias("free"),
        )

    steps = (
        entries("gets", F.lit(True), 0, 0, True)
        .unionByName(entries("gets", F.col("assumed"), 1, 1, False))
        .unionByName(entries("had", F.col("assumed"), 1, -1, False))
    )
    totals = running_total(steps, ["kind", "value"], "_at", F.col("_step"), "_taken")
    refused = totals.where("seq is not null and free <= _taken").groupBy("seq").agg(F.min("kind").alias("_kind"))
    names = F.array(*[F.lit(f"{c}_taken") for c in unique], F.lit("shelf_full"))
    judged = judged.join(apart(refused), "seq", "left")
    return judged.withColumn("reason", F.coalesce("_broken", F.get(names, F.col("_kind")))).drop("_kind")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``seq``, ``accepted`` and ``sure`` of patches of a run that comes in order.

    A patch is not sure if a verdict on its row came out other than assumed and its rules look at that.
    """
    has, gained, turned, sure = {}, {}, set(), True
    for batch in batches:
        out = []
        names = ("seq", "key", "assumed", "sound", "_own", "_claims")
        for seq, row, assumed, sound, own, claims in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            sure = sure and (own or row not in turned)
            steps, accepted = [], sound
            for c in claims:
                had, gets = has.setdefault((c["kind"], row), c["had"]), c["gets"]
                if had == gets:
                    continue
                if gets is not None and c["free"] is not None and c["free"] <= gained.get((c["kind"], gets), 0):
                    accepted = False
                steps.append((c["kind"], had, gets))
            if accepted:
                for kind, had, gets in steps:
                    has[kind, row] = gets
                    for value, step in ((had, -1), (gets, 1)):
                        if value is not None:
                            gained[kind, value] = gained.get((kind, value), 0) + step
            if accepted != assumed:
                turned.add(row)
            out.append((seq, accepted, sure))
        kinds = (pa.int64(), pa.bool_(), pa.bool_())
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), kinds, strict=True)],
            ["seq", "accepted", "sure"],
        )


def _steps(claims: DataFrame) -> DataFrame:
    """What accepted claims add to and take from each value: ``kind``, ``value``, ``step``."""
    ways = [("gets", 1), ("had", -1)]
    each = claims.where("not (had <=> gets)")
    parts = [each.select("kind", F.col(v).alias("value"), F.lit(n).alias("step")).where("value is not null") for v, n in ways]
    return parts[0].unionByName(parts[1])


def _decided(facts: DataFrame, table: str, fields: list[str], unique: list[str], as_of: date, run: int) -> DataFrame:
    """The patches as judged under verdicts that came out as assumed."""
    key = PRIMARY_KEY[table]
    assumed = facts.select("seq", F.lit(True).alias("assumed"))
    if facts.count() > run:
        assumed = _forecast(facts, table, fields, unique, as_of, run)
    done = None
    while True:
        judged = pin(_judged(facts, assumed, table, fields, unique, as_of))
        accepted = F.col("reason").isNull()
        if judged.where(F.col("assumed") != accepted).isEmpty():
            return judged
        open_ones = judged if done is None else judged.where(F.col("seq") > done)
        earliest = open_ones
        if open_ones.count() > run:
            earliest = number_rows(open_ones, "seq", "_place").where(F.col("_place") <= run).drop("_place")
        earliest = pin(earliest)
        if done is not None:
            before = judged.where(accepted & (F.col("seq") <= done)).select(F.inline("_claims"))
            taken = pin(_steps(before).groupBy("kind", F.col("value").alias("gets")).agg(F.sum("step").alias("taken")))
            left = F.col("free") - F.coalesce("taken", F.lit(0))
            claims = earliest.select("seq", F.inline("_claims")).join(apart(taken), ["kind", "gets"], "left")
            claims = claims.groupBy("seq").agg(
                F.collect_list(F.struct("kind", "had", "gets", left.alias("free"))).alias("_claims")
            )
            earliest = earliest.drop("_claims").join(apart(claims), "seq", "left")
            earliest = earliest.withColumn("_claims", F.coalesce("_claims", F.array().cast(claims.schema["_claims"].dataType)))
        rows = earliest.select("seq", F.col(key).alias("key"), "assumed", F.col("_broken").isNull().alias("sound"), "_own", "_claims")
        decided = pin(
            rows.repartition(1).sortWithinPartitions("seq").mapInArrow(_in_order, "seq long, accepted boolean, sure boolean")
        )
        done = decided.where("sure").agg(F.max("seq")).first()[0]
        # Behind the run, the verdicts of this round are the assumptions of the next.
        assumed = pin(
            judged.join(apart(decided), "seq", "left").select("seq", F.coalesce("accepted", accepted).alias("assumed"))
        )


def apply_patches(
    tables: Collection, patches: DataFrame, table: str, as_of: date, moment: datetime | None = None, run: int = 200_000
) -> tuple[Collection, DataFrame]:
    """Apply ``seq, <key>, <fields...>[, set_fields]`` one after another; returns ``(tables, result)``.

    Only patchable fields change. ``set_fields`` names the fields a patch sets, so that a field can be set
    to null; without that column every field present counts as set. ``result`` has one row per patch:
    ``seq``, the key, ``updated``, and the ``reason`` of a patch that was refused. A refused patch leaves
    its row as the ones before it made it. A unique value is free once the row that had it got another.
    A physical book needs a place on a new shelf at its turn, and shelf counts follow. ``seq`` must be
    unique. ``run`` bounds how many patches one task decides in order at a time; it does not change
    the outcome.
    """
    key, base = PRIMARY_KEY[table], getattr(tables, table)
    fields = [f for f in PATCHABLE[table] if f in patches.columns]
    unique = [c for c in UNIQUE[table] if c in fields]
    facts = pin(_facts(tables, patches, table, fields, unique, as_of))
    judged = _decided(facts.where(F.col("_static").isNull()), table, fields, unique, as_of, run)
    result = pin(
        facts.select("seq", key, "_static")
        .join(apart(judged.select("seq", "reason")), "seq", "left")
        .withColumn("reason", F.coalesce("_static", "reason"))
        .select("seq", key, F.col("reason").isNull().alias("updated"), "reason")
    )
    made = facts.join(apart(result.where("updated").select("seq")), "seq", "left_semi")
    last = [F.max_by(f"_new_{f}", F.when(F.col(f"_new_{f}").isNotNull(), F.col("seq"))).alias(f"_new_{f}") for f in fields]
    folded = made.groupBy(key).agg(F.lit(True).alias("_changed"), *last)
    changed = F.col("_changed").isNotNull()
    values = {f: F.when(F.col(f"_new_{f}").isNull(), F.col(f)).otherwise(F.col(f"_new_{f}.value")) for f in fields}
    after = base.join(pin(folded), key, "left").withColumns({**values, **touched(changed, moment)})
    changes = {table: after.select(*base.columns)}
    if table == "books":
        moved = _steps(judged.where("reason is null").select(F.inline("_claims")).where(F.col("kind") == len(unique)))
        deltas = moved.groupBy(F.col("value").cast("long").alias("shelf_id")).agg(F.sum("step").alias("delta"))
        changes["shelves"], _ = apply_shelf_deltas(tables.shelves, deltas.where("delta <> 0"), moment)
    return tables.with_tables(**changes), result
