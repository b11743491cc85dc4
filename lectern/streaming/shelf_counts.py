"""Running physical-book count per shelf from a stream of ``(seq, shelf_id, delta)`` files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lectern.schemas import SHELF_DELTAS
from lectern.streaming.ledger import latest

_COUNTS = T.StructType(
    [
        T.StructField("shelf_id", T.LongType()),
        T.StructField("book_count", T.LongType()),
        T.StructField("batch", T.LongType()),
    ]
)


def running_counts(deltas: DataFrame) -> DataFrame:
    """Works on a batch as well as on a stream; deltas combine map-side before the shuffle."""
    return deltas.groupBy("shelf_id").agg(F.sum("delta").alias("book_count"))


def run_shelf_counts(
    spark: SparkSession,
    source: str,
    target: str,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Follow delta files; each micro-batch writes the counts it changed to ``target``."""
    reader = spark.readStream.schema(SHELF_DELTAS).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def on_batch(counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{target}/counts/batch={batch}")

    writer = (
        running_counts(reader.load(source))
        .writeStream.outputMode("update")
        .foreachBatch(on_batch)
        .option("checkpointLocation", f"{target}/stream")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_counts(spark: SparkSession, target: str) -> DataFrame:
    """``shelf_id, book_count`` after all batches written so far."""
    return latest(spark.read.schema(_COUNTS).parquet(f"{target}/counts"), "shelf_id")
