"""Taking in batches of new students, shelves and books."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import capacity
from lectern.operators.admission import grant
from lectern.operators.changes import assign_keys, timestamp
from lectern.operators.lookup import by_key
from lectern.operators.quality import first_broken, strict_rules
from lectern.plans.views import physical_books
from lectern.schemas import DEFAULTS, PRIMARY_KEY, TABLES, UNIQUE
from lectern.session import apart, pin
from lectern.sources.collection import Collection


@dataclass(frozen=True)
class Intake:
    """Accepted rows with keys, ``result`` per request and the ``tables`` with the rows added."""

    accepted: DataFrame
    result: DataFrame
    tables: Collection


def fill_defaults(rows: DataFrame, table: str, moment: datetime | None = None) -> DataFrame:
    """Rows in the table's shape: absent columns and nulls take the column's default."""
    schema, stamp = TABLES[table], timestamp(moment)
    filled = []
    for f in schema:
        value = F.col(f.name) if f.name in rows.columns else F.lit(None)
        if f.name in DEFAULTS[table]:
            value = F.coalesce(value, F.lit(DEFAULTS[table][f.name]))
        elif f.name in ("created_at", "updated_at") and stamp is not None:
            value = stamp
        filled.append(value.cast(f.dataType).alias(f.name))
    return rows.select("seq", *filled)


def ingest(
    tables: Collection,
    rows: DataFrame,
    table: str,
    as_of: date,
    moment: datetime | None = None,
) -> Intake:
    """Insert ``seq, <columns>`` as if row by row in ``seq`` order.

    A row is accepted when it breaks no rule of the table, its unique values are new, and, for a
    physical book, its shelf exists and has room. The first of several rows with one unique value
    gets it, unless that row fails for another reason. Shelf counts follow the books placed.
    """
    if table == "loans":
        raise ValueError("loans come in through circulation.admit_loans")
    existing = tables.as_dict()[table]
    key, unique = PRIMARY_KEY[table], list(UNIQUE[table])
    facts = fill_defaults(rows, table, moment).withColumn(
        "_reason", first_broken(strict_rules(table, as_of))
    )
    for column in unique:
        taken = by_key(existing, facts, column).select(column).distinct()
        facts = (
            facts.join(apart(taken.withColumn("_taken", F.lit(True))), column, "left")
            .withColumn(
                "_reason",
                F.coalesce("_reason", F.when(F.col("_taken").isNotNull(), f"{column}_taken")),
            )
            .drop("_taken")
        )
    pool = None
    if table == "books":
        pool = "_pool"
        free = tables.shelves.select(
            F.col("shelf_id").alias("_pool"), capacity.available_space().alias("_free")
        )
        on_shelf = F.when(F.col("book_type") == "physical", F.col("shelf_id"))
        unknown = F.col("_pool").isNotNull() & F.col("_free").isNull()
        full = F.col("_free") <= 0
        facts = (
            facts.withColumn("_pool", on_shelf)
            .join(free, "_pool", "left")
            .withColumn(
                "_reason",
                F.coalesce(
                    F.when(unknown, "shelf_not_found").when(full, "shelf_full"), F.col("_reason")
                ),
            )
        )
    facts = pin(facts)
    room = "_free" if pool else None
    granted = grant(
        facts.where(F.col("_reason").isNull()), unique=unique, pool=pool, room=room
    )
    # A sound row that was not granted met a value or a shelf that an earlier row had used up.
    lost = F.lit("shelf_full") if pool else F.lit("value_taken")
    for column in reversed(unique):
        lost = F.when(F.col(f"_{column}_at") < F.col("seq"), f"{column}_taken").otherwise(lost)
    decided = facts.join(
        granted.select("seq", F.lit(True).alias("_granted")), "seq", "left"
    )
    for column in unique:
        winners = granted.where(F.col(column).isNotNull()).select(
            column, F.col("seq").alias(f"_{column}_at")
        )
        decided = decided.join(winners, column, "left")
    decided = pin(
        decided.withColumn("accepted", F.col("_granted").isNotNull()).withColumn(
            "reason", F.when(~F.col("accepted"), F.coalesce("_reason", lost))
        )
    )
    columns = existing.columns
    accepted = assign_keys(decided.where("accepted").select("seq", *columns), existing, key)
    added = accepted.select(*columns)
    changed = {table: existing.unionByName(added)}
    if table == "books":
        placed = physical_books(added).groupBy("shelf_id").agg(F.count("*").alias("_placed"))
        count = F.col("current_book_count") + F.coalesce("_placed", F.lit(0)).cast("int")
        changed["shelves"] = (
            tables.shelves.join(placed, "shelf_id", "left")
            .withColumn("current_book_count", count)
            .select(*tables.shelves.columns)
        )
    result = decided.select("seq", "accepted", "reason")
    return Intake(accepted.select("seq", *columns), result, tables.with_tables(**changed))
