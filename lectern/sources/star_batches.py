"""Job inputs derived from the star schema: every event, part, supplier or order makes a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.views import is_open
from lectern.sources.collection import Collection
from lectern.sources.star import source


class StarBatches:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.events = source(spark, sf_dir, "events")
        self.orders = source(spark, sf_dir, "orders")
        self.customers = source(spark, sf_dir, "customer")
        self.parts = source(spark, sf_dir, "part")
        self.suppliers = source(spark, sf_dir, "supplier")

    @staticmethod
    def _rows(df: DataFrame) -> Column:
        return df.agg(F.count("*").alias("n")).scalar()

    def _some_loan(self) -> Column:
        """A loan key per event, many events on one loan among them, some beyond the last key."""
        return (F.col("event_id") * 31 + F.col("user_id")) % (self._rows(self.orders) + 50)

    # Keys to look up

    def student_numbers(self) -> DataFrame:
        number = F.concat(F.lit("20"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
        return self.events.select(number.alias("student_number"))

    def emails(self) -> DataFrame:
        digits = F.lpad(F.col("user_id").cast("string"), 9, "0")
        return self.events.select(
            F.concat(F.lit("customer."), digits, F.lit("@example.org")).alias("email")
        )

    def location_codes(self) -> DataFrame:
        digits = F.lpad((F.col("event_id") % 150).cast("string"), 9, "0")
        return self.events.select(F.concat(F.lit("Supplier#"), digits).alias("location_code"))

    def shelf_requests(self) -> DataFrame:
        """One request per event for a shelf, some of them unknown."""
        shelf = F.col("event_id") % (self._rows(self.suppliers) + 5)
        return self.events.select(F.col("event_id").alias("seq"), shelf.alias("shelf_id"))

    def loan_requests_by_event(self) -> DataFrame:
        """One (book, student) pair per event, some of them unknown."""
        return self.events.select(
            F.col("event_id").alias("seq"),
            (F.col("event_id") % (self._rows(self.parts) + 20)).alias("book_id"),
            (F.col("event_id") * 7 % (self._rows(self.customers) + 20)).alias("student_id"),
        )

    # Circulation

    def returns(self) -> DataFrame:
        day = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("event_id") % 300).cast("int"))
        return self.events.select(
            F.col("event_id").alias("seq"),
            self._some_loan().alias("loan_id"),
            F.when(F.col("event_id") % 10 != 0, day).alias("return_date"),
        )

    def renewals(self) -> DataFrame:
        day = F.date_add(F.lit("2001-03-01").cast("date"), (F.col("event_id") % 250).cast("int"))
        return self.events.select(
            F.col("event_id").alias("seq"),
            self._some_loan().alias("loan_id"),
            day.alias("new_due"),
        )

    def loan_statuses(self) -> DataFrame:
        turn = F.col("event_id") % 5
        return self.events.select(
            F.col("event_id").alias("seq"),
            self._some_loan().alias("loan_id"),
            F.when(turn == 0, "active")
            .when(turn == 1, "overdue")
            .when(turn == 2, "lost")
            .when(turn == 3, "returned")
            .otherwise("misplaced")
            .alias("status"),
        )

    def book_statuses(self) -> DataFrame:
        turn = F.col("event_id") % 5
        return self.events.select(
            F.col("event_id").alias("seq"),
            (F.col("event_id") * 3 % (self._rows(self.parts) + 20)).alias("book_id"),
            F.when(turn == 0, "available")
            .when(turn == 1, "maintenance")
            .when(turn == 2, "lost")
            .when(turn == 3, "loaned")
            .otherwise("misplaced")
            .alias("status"),
        )

    # Shelving

    def placements(self, tables: Collection) -> DataFrame:
        """A second copy of every book, bound for the shelf of the first."""
        return tables.books.withColumn("seq", F.col("book_id"))

    def moves(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.parts.select(
            key.alias("seq"),
            (key - F.when(key % 9 == 8, 1).otherwise(0)).alias("book_id"),
            ((key * 7 + 3) % (self._rows(self.suppliers) + 1)).alias("shelf_id"),
        )

    def reshelved(self, tables: Collection) -> DataFrame:
        """Books a season later: lost ones struck off, mended ones digital, loaned ones a shelf on."""
        status = F.col("status")
        next_shelf = (F.col("shelf_id") + 1) % self._rows(self.suppliers)
        shelf = F.when(status == "loaned", next_shelf).otherwise(F.col("shelf_id"))
        turned = status == "maintenance"
        return (
            tables.books.where(status != "lost")
            .withColumn("shelf_id", F.when(~turned, shelf))
            .withColumn("book_type", F.when(turned, "digital").otherwise(F.col("book_type")))
        )

    # Changes

    def student_patches(self) -> DataFrame:
        """New programs, and for every third event a phone set to null."""
        clears = F.col("event_id") % 3 == 0
        return self.events.select(
            F.col("event_id").alias("seq"),
            (F.col("event_id") * 7 % (self._rows(self.customers) + 20)).alias("student_id"),
            F.upper("event_type").alias("program"),
            F.lit(None).cast("string").alias("phone"),
            F.when(clears, F.array(F.lit("program"), F.lit("phone")))
            .otherwise(F.array(F.lit("program")))
            .alias("set_fields"),
        )

    def email_patches(self) -> DataFrame:
        """New addresses: some are other students', some are asked for by several students."""
        other = F.lpad((F.col("event_id") * 11 % 60).cast("string"), 9, "0")
        fresh = F.concat(F.lit("new."), (F.col("event_id") % 40).cast("string"), F.lit("@example.org"))
        return self.events.select(
            F.col("event_id").alias("seq"),
            (F.col("event_id") * 7 % (self._rows(self.customers) + 20)).alias("student_id"),
            F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("customer."), other, F.lit("@example.org")))
            .otherwise(fresh)
            .alias("email"),
        )

    def code_patches(self) -> DataFrame:
        """New location codes for shelves, each asked for by several."""
        letter = F.char(F.lit(65) + F.col("event_id") % 3)
        return self.events.select(
            F.col("event_id").alias("seq"),
            (F.col("event_id") * 3 % (self._rows(self.suppliers) + 3)).alias("shelf_id"),
            F.concat(letter, (F.col("event_id") % 10).cast("string")).alias("location_code"),
        )

    def shelf_patches(self) -> DataFrame:
        """Other shelves for books, some of them unknown."""
        return self.events.select(
            F.col("event_id").alias("seq"),
            (F.col("event_id") * 3 % (self._rows(self.parts) + 20)).alias("book_id"),
            (F.col("event_id") * 7 % (self._rows(self.suppliers) + 5)).alias("shelf_id"),
        )

    def shelf_keys(self) -> DataFrame:
        """Every shelf, and one unknown."""
        return self.suppliers.select(
            (F.col("s_suppkey") + F.when(F.col("s_suppkey") == 0, -1).otherwise(0)).alias("shelf_id")
        )


def replayed(tables: Collection) -> tuple[Collection, DataFrame]:
    """The collection without its open loans, and those loans as requests in key order.

    Answers which of the open loans the admission rules would have let through.
    """
    requests = tables.loans.where(is_open()).select(
        F.col("loan_id").alias("seq"),
        "book_id",
        "student_id",
        "loan_date",
        "estimated_return_date",
        "notes",
    )
    usual = F.when(F.col("status") == "loaned", "available").otherwise(F.col("status"))
    base = tables.with_tables(
        loans=tables.loans.where(~is_open()), books=tables.books.withColumn("status", usual)
    )
    return base, requests


def new_shelves(tables: Collection) -> DataFrame:
    """Every shelf under a code of a letter and two digits; codes repeat beyond 2600 shelves."""
    key = F.col("shelf_id")
    letter = F.expr("char(65 + (shelf_id div 100) % 26)")
    code = F.concat(letter, (key % 100).cast("string"))
    return tables.shelves.withColumns({"seq": key, "location_code": code})


def emptied(tables: Collection) -> Collection:
    """The collection before its first book came in."""
    return tables.with_tables(
        books=tables.books.where("false"),
        loans=tables.loans.where("false"),
        shelves=tables.shelves.withColumn("current_book_count", F.lit(0)),
    )


def loan_events(tables: Collection) -> DataFrame:
    """The life of every loan as events: lent, perhaps renewed, perhaps returned or lost.

    ``seq`` spreads the four possible events of a loan over four runs of loan keys.
    """
    key, status = F.col("loan_id"), F.col("loan_status")

    def event(kind: str, offset: int, day: Column, due: Column | None = None) -> Column:
        return F.struct(
            (key * 4 + offset).alias("seq"),
            F.lit(kind).alias("event"),
            day.alias("event_date"),
            (F.lit(None).cast("date") if due is None else due).alias("new_due"),
        )

    renewed_to = F.date_add(F.col("estimated_return_date"), 7)
    events = F.array_compact(
        F.array(
            event("loan", 0, F.col("loan_date")),
            F.when(
                F.col("renewal_count") > 0, event("renew", 1, F.col("loan_date"), renewed_to)
            ),
            F.when(status == "returned", event("return", 2, F.col("actual_return_date"))),
            F.when(status == "lost", event("lost", 3, F.col("estimated_return_date"))),
        )
    )
    return tables.loans.select(
        "loan_id", "book_id", "student_id", F.explode(events).alias("e")
    ).select("e.seq", "e.event", "loan_id", "book_id", "student_id", "e.event_date", "e.new_due")


def shelf_delta_events(tables: Collection) -> DataFrame:
    """One arrival per physical book, and a departure for every fifth of them."""
    key = F.col("book_id")
    deltas = F.when(key % 5 == 0, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    return (
        tables.books.where((F.col("book_type") == "physical") & F.col("shelf_id").isNotNull())
        .select(key, "shelf_id", F.posexplode(deltas).alias("step", "delta"))
        .select((key * 2 + F.col("step")).alias("seq"), "shelf_id", "delta")
    )
