"""Snapshot-to-snapshot changes: deletes, key assignment, audit.

Built-in file tables have no row updates, so each job reads one snapshot and returns the next. The
caller writes the result to a new place (see ``sources.loader``).
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.documents import value_json
from lectern.operators.running import number_rows
from lectern.plans.views import is_open, shelf_sizes
from lectern.schemas import PRIMARY_KEY
from lectern.session import apart
from lectern.sources.collection import Collection


def timestamp(moment: datetime | None) -> Column | None:
    return None if moment is None else F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def touched(changed: Column, moment: datetime | None) -> dict[str, Column]:
    """``updated_at`` moved to ``moment`` on changed rows; nothing when no moment is given."""
    if moment is None:
        return {}
    return {"updated_at": F.when(changed, timestamp(moment)).otherwise(F.col("updated_at"))}


def max_key(df: DataFrame, key: str) -> Column:
    """Largest key in use as a scalar subquery, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).scalar()


def assign_keys(rows: DataFrame, existing: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Gives new rows the keys after the largest one in use, dense and in ``order``."""
    numbered = number_rows(rows.drop(key), order, "_number").withColumn(
        "_top", max_key(existing, key)
    )
    return numbered.withColumn(key, F.col("_top") + F.col("_number")).drop("_number", "_top")


def delete_students(tables: Collection, keys: DataFrame, moment: datetime | None = None) -> Collection:
    """Remove students and their loans; books that were out on those loans become available."""
    keys = apart(keys.select("student_id").distinct())
    gone = tables.loans.join(keys, "student_id", "left_semi")
    freed = gone.where(is_open()).select("book_id").distinct().withColumn("_freed", F.lit(True))
    is_freed = F.col("_freed").isNotNull()
    books = tables.books.join(freed, "book_id", "left")
    status = F.when(is_freed, "available").otherwise(F.col("status"))
    return tables.with_tables(
        students=tables.students.join(keys, "student_id", "left_anti"),
        loans=tables.loans.join(keys, "student_id", "left_anti"),
        books=books.withColumns({"status": status, **touched(is_freed, moment)}).select(
            *tables.books.columns
        ),
    )


def delete_books(tables: Collection, keys: DataFrame, moment: datetime | None = None) -> Collection:
    """Remove books and their loans, and take the physical ones off their shelves' counts."""
    keys = apart(keys.select("book_id").distinct())
    taken = shelf_sizes(tables.books.join(keys, "book_id", "left_semi"))
    fewer = F.col("rows").isNotNull()
    count = F.col("current_book_count") - F.coalesce("rows", F.lit(0)).cast("int")
    shelves = tables.shelves.join(taken, "shelf_id", "left")
    return tables.with_tables(
        books=tables.books.join(keys, "book_id", "left_anti"),
        loans=tables.loans.join(keys, "book_id", "left_anti"),
        shelves=shelves.withColumns(
            {"current_book_count": count, **touched(fewer, moment)}
        ).select(*tables.shelves.columns),
    )


def delete_shelves(tables: Collection, keys: DataFrame) -> tuple[Collection, DataFrame]:
    """Remove empty shelves; returns the tables and ``shelf_id, accepted, reason`` per asked key.

    A shelf with a recorded count is refused, and so is one that still holds physical books in spite
    of a count of zero: those books would be left without the shelf they must have. Digital books
    that point at a removed shelf lose the reference.
    """
    asked = keys.select("shelf_id").distinct()
    known = tables.shelves.select("shelf_id", "current_book_count").join(
        shelf_sizes(tables.books), "shelf_id", "left"
    )
    reason = (
        F.when(F.col("current_book_count").isNull(), "shelf_not_found")
        .when(F.col("current_book_count") > 0, "shelf_not_empty")
        .when(F.col("rows").isNotNull(), "shelf_holds_books")
    )
    result = asked.join(known, "shelf_id", "left").select(
        "shelf_id", reason.isNull().alias("accepted"), reason.alias("reason")
    )
    removed = apart(result.where("accepted").select("shelf_id"))
    lost = removed.withColumn("_lost", F.lit(True))
    shelf = F.when(F.col("_lost").isNull(), F.col("shelf_id"))
    books = tables.books.join(lost, "shelf_id", "left").withColumn("shelf_id", shelf)
    changed = tables.with_tables(
        shelves=tables.shelves.join(removed, "shelf_id", "left_anti"),
        books=books.select(*tables.books.columns),
    )
    return changed, result


# Audit


def audit_diff(
    before: DataFrame, after: DataFrame, table: str, moment: datetime, user: str | None = None
) -> DataFrame:
    """One row per inserted, updated or deleted key, old and new row as JSON.

    A row left as it was gives no audit row. ``log_id`` is assigned when the rows are appended.
    """
    key = PRIMARY_KEY[table]
    columns = before.columns
    old = before.select(F.col(key), F.struct(*columns).alias("old"))
    new = after.select(F.col(key), F.struct(*columns).alias("new"))
    return audit_pairs(old.join(new, key, "full_outer").select("old", "new"), table, moment, user)


def audit_pairs(
    pairs: DataFrame, table: str, moment: datetime, user: str | None = None
) -> DataFrame:
    """The audit rows of ``old``, ``new`` row pairs, for jobs that know both without a join."""
    key = PRIMARY_KEY[table]
    operation = (
        F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE")
    ).otherwise("UPDATE")
    return pairs.where(~F.col("old").eqNullSafe(F.col("new"))).select(
        F.lit(table).alias("table_name"),
        operation.alias("operation"),
        F.coalesce(f"new.{key}", f"old.{key}").alias("row_key"),
        value_json(F.col("old")).alias("old_values"),
        value_json(F.col("new")).alias("new_values"),
        F.lit(user).cast("string").alias("user_id"),
        timestamp(moment).alias("timestamp"),
    )


def append_audit(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Audit rows with ``log_id`` continuing the log, ordered by table and row key."""
    place = F.struct("timestamp", "table_name", "row_key")
    keyed = assign_keys(rows.withColumn("_place", place), log, "log_id", "_place")
    return keyed.select(*log.columns)


def replay_audit(before: DataFrame, audit: DataFrame, table: str) -> DataFrame:
    """The snapshot after the audited changes, rebuilt from ``before`` and the audit rows."""
    key = PRIMARY_KEY[table]
    ours = audit.where(F.col("table_name") == table)
    rebuilt = ours.where(F.col("operation") != "DELETE").select(
        F.from_json("new_values", before.schema).alias("row")
    )
    kept = before.join(ours.select(F.col("row_key").alias(key)), key, "left_anti")
    return kept.select(*before.columns).unionByName(rebuilt.select("row.*"))

