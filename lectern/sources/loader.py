"""Reading and publishing the collection tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.schemas import TABLES
from lectern.sources.collection import Collection


def read_table(
    spark: SparkSession,
    path: str | None = None,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Load one table from any batch source Spark knows, schema given rather than inferred.

    Options pass straight through, so ``fmt="jdbc"`` takes ``url``, ``dbtable`` or ``query`` and,
    for a parallel read, ``partitionColumn`` with its bounds. That source brings its own schema,
    which is then cast to the one asked for.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        loaded = reader.load()
        if schema is None:
            return loaded
        return loaded.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    if schema is None:
        return reader.load(path)
    # Partition columns come last from files; the schema's order is the table's.
    return reader.schema(schema).load(path).select(*schema.names)


def read_collection(
    spark: SparkSession, root: str, fmt: str = "parquet", **options: str
) -> Collection:
    """Load the four tables from the folders ``root/<table>``."""
    return Collection(
        **{
            name: read_table(spark, f"{root.rstrip('/')}/{name}", schema, fmt, **options)
            for name, schema in TABLES.items()
        }
    )


def write_collection(
    tables: Collection,
    root: str,
    fmt: str = "parquet",
    partition_by: Mapping[str, tuple[str, ...]] | None = None,
) -> None:
    """Write a new snapshot. The target must not exist: snapshots replace, never overwrite.

    Partitioning loans by ``loan_status`` lets the open-loan views and jobs skip the (far larger)
    returned history at planning time.
    """
    partition_by = {"loans": ("loan_status",)} if partition_by is None else partition_by
    for name, df in tables.as_dict().items():
        writer = df.write.mode("errorifexists").format(fmt)
        if partition_by.get(name):
            writer = writer.partitionBy(*partition_by[name])
        writer.save(f"{root.rstrip('/')}/{name}")
