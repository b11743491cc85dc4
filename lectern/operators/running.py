"""Running totals and row numbers whose groups may be larger than one task can hold.

A plain window sends a whole group to one task. Here the rows are cut by range into slices of
about even size, totals are taken per slice, and each slice starts from the sum of the slices
before it. One group may span many slices, so the largest unit of work is a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import pin


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    weight: Column,
    name: str,
) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the group's rows up to and including this one.

    ``order`` must be unique and group columns not null.
    """
    return _running(df, group, order, {name: weight.cast("long")}, F.sum, lambda a, b: a + b, 0)


def running_max(
    df: DataFrame, group: Sequence[str], order: str, value: Column, name: str
) -> DataFrame:
    """Adds ``name``: the largest ``value`` of the group's rows up to and including this one, or null."""
    return _running(df, group, order, {name: value}, F.max, F.greatest, None)


def largest_before(df: DataFrame, group: Sequence[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Adds, under each name, the largest such value of the group's rows before this one, or null."""
    return _running(df, group, order, values, F.max, F.greatest, None, end=-1)


def _running(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    values: dict[str, Column],
    total: Callable[[Column], Column],
    combine: Callable[[Column, Column], Column],
    start: int | None,
    end: int = Window.currentRow,
) -> DataFrame:
    group = list(group)
    places = range(len(values))
    weighed = df.withColumns({f"_weight{i}": v for i, v in enumerate(values.values())})
    # The slice number depends on sampled range bounds, so it is written down before use.
    sliced = pin(
        weighed.repartitionByRange(*group, order).withColumn("_slice", F.spark_partition_id())
    )
    in_slice = (
        Window.partitionBy(*group, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    )
    # At most one row per group and slice: the slice count bounds this window.
    earlier = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        sliced.groupBy(*group, "_slice")
        .agg(*[total(f"_weight{i}").alias(f"_slice_total{i}") for i in places])
        .select(
            *group,
            "_slice",
            *[
                F.coalesce(total(f"_slice_total{i}").over(earlier), F.lit(start)).alias(f"_before{i}")
                for i in places
            ],
        )
    )
    return (
        sliced.withColumns({f"_within{i}": total(f"_weight{i}").over(in_slice) for i in places})
        .join(before, [*group, "_slice"])
        .withColumns(
            {name: combine(F.col(f"_before{i}"), F.col(f"_within{i}")) for i, name in enumerate(values)}
        )
        .select(*df.columns, *values)
    )


def number_rows(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds ``name``: dense numbers 1, 2, ... in ``order``."""
    return running_total(df, [], order, F.lit(1), name)
