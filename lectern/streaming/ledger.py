"""State of a loan stream: a base snapshot plus the rows each micro-batch changed.

A batch writes only the loans and books it touched, under its own ``batch=<id>`` folder. Reading the
state as of a batch ignores that batch and later ones, and a repeated batch replaces its own folder,
so a batch that runs twice after a failure leaves the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.schemas import PRIMARY_KEY
from lectern.sources.collection import Collection
from lectern.sources.loader import read_collection, write_collection

CHANGED = ("loans", "books")


def latest(changes: DataFrame, key: str, version: str = "batch") -> DataFrame:
    """The row of the highest version per key. Aggregates map-side, so a hot key stays small."""
    columns = [c for c in changes.columns if c != version]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("row"))
    return newest.select("row.*")


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def start(cls, root: str, tables: Collection) -> "Ledger":
        """Write the base snapshot. Starting a new ledger from ``current()`` compacts an old one."""
        ledger = cls(tables.loans.sparkSession, root)
        write_collection(tables, f"{ledger.root}/base")
        for table in CHANGED:
            ledger.write(tables.as_dict()[table].limit(0), table, -1)
        return ledger

    def write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{kind}/batch={batch}")

    def read(self, kind: str, schema: T.StructType) -> DataFrame:
        schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}")

    def current(self, before_batch: int | None = None) -> Collection:
        """The tables after all batches, or after those before ``before_batch``."""
        base = read_collection(self.spark, f"{self.root}/base")
        overlaid = {}
        for table in CHANGED:
            rows, key = base.as_dict()[table], PRIMARY_KEY[table]
            changes = self.read(table, rows.schema)
            if before_batch is not None:
                changes = changes.where(F.col("batch") < before_batch)
            newest = latest(changes, key)
            kept = rows.join(newest.select(key), key, "left_anti")
            overlaid[table] = kept.select(*rows.columns).unionByName(newest)
        return base.with_tables(**overlaid)
