"""Places in an order of all rows, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.components import frequent, lookup
from factloom.operators.written import written


def with_place(rows: DataFrame, order: tuple[str, ...], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) by the columns ``order``.

    Places come from counts of the range partitions of the order, one row per
    partition, not from a sort of all rows in one task. The rows are written
    first, as finding the ranges reads them once and dealing them once more,
    and so are the partitions, so that counts and rows see the same.
    """
    parts = written(rows, "rows").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    parts = written(parts, "numbered")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("_part", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"))
    return parts.join(starts, "_part").withColumn(name, F.col("_id") + F.col("_shift") + 1).drop("_part", "_id", "_shift")


def with_place_in(rows: DataFrame, group: str, order: tuple[str, ...], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in their group: that among all rows
    by group and order, less the group's first, so a group of most rows is
    dealt over tasks like any other. Rows with a null group are a group."""
    key = F.struct(F.col(group).isNull().alias("none"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("of"))
    placed = written(with_place(rows.withColumn("_group", key), ("_group", *order), "_place"), "places")
    first = placed.groupBy("_group").agg(F.min("_place").alias("_least"))
    found = lookup(placed, first, "_group", frequent(placed, "_group"))
    return found.withColumn(name, F.col("_place") - F.col("_least") + 1).drop("_group", "_place", "_least")
