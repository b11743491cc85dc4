"""Session settings and reliable cutting of lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, app: str = "lectern") -> SparkSession:
    """Session for tests and the bench. On a cluster, submit with that cluster's own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(Path(tempfile.gettempdir(), "lectern-scratch")))
        .config("spark.driver.memory", "8g")
        # Recording the Python call site of every column expression doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def with_scratch(spark: SparkSession) -> SparkSession:
    """``spark``, with a throw-away folder if it runs in this process alone and names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, never used twice."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, counted now, else unmarked.

    For narrow frames that are cheap to count, such as pinned ones.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def few_tasks(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """``df`` in a task per 10,000 of its ``rows``; from ``most`` rows on as it is.

    For steps that are repeated over small frames: each task of a shuffle or a pin writes files of its own.
    """
    return df if rows >= most else df.coalesce(1 + rows // 10_000)


def apart(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew, so that a join or grouping behind it starts from a plain stage.

    AQE splits a skewed join only if both sides are plain shuffles. A side that was just grouped or
    joined on the same key would keep that partitioning, and with it a hot key in one task. For the
    small side of a join: what is dealt out is one row per key.
    """
    return df.hint("rebalance")


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and continue from the written rows.

    Used where later steps must see exactly the same rows however often a task is retried
    (row positions, rounds of an iteration), and where several of them use the same rows. A lost
    executor costs a re-read, not a re-run. It also ends the stage: a skewed join right before it can
    be split, which a grouping on the join's key would prevent.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
