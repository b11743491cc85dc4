"""Gathering the rows of a group into arrays of bounded length.

A group's rows are ranked by their key, and every ``page_size`` of them make a page. That is one rule
and one plan for groups of any size: ranks come from counts of key ranges, which are small, and from a
window within one range, which cannot hold more than ``KEY_RANGE`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE = 10_000
KEY_RANGE = 1 << 16


def gather(
    df: DataFrame,
    group: str,
    row_key: str,
    element: Column,
    name: str,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """``group, page, name``: sorted arrays of ``element`` for each page of the group.

    ``row_key`` is a whole number, unique in ``df``. Pages follow each other in key order.
    """
    ranged = F.floor(F.col(row_key) / F.lit(KEY_RANGE)).alias("_range")
    elements = df.select(group, row_key, element.alias("_element"), ranged)
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        elements.groupBy(group, "_range")
        .agg(F.count("*").alias("_n"))
        .select(group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(group, "_range").orderBy(row_key)
    rank = F.col("_before") + F.row_number().over(inside) - 1
    return (
        elements.join(before, [group, "_range"])
        .withColumn("page", F.floor(rank / F.lit(page_size)).cast("int"))
        .groupBy(group, "page")
        .agg(F.array_sort(F.collect_list("_element")).alias(name))
    )
