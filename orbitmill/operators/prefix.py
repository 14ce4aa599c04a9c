"""Running sums and dense numbering without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import materialise


def running_sums(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Adds, for each ``out: value``, the sum of ``value`` over the rows before, in ascending order of the unique column ``order``.

    Rows are sorted by range; sums run within ranges, and each range is moved by
    the totals of the ranges before it, a table of one row per range. Ranges are
    sampled from df, which so is computed twice: a costly one should be a table.
    """
    parted = materialise(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = parted.groupBy("_range").agg(*[F.sum(value).alias(f"_total_{out}") for out, value in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select("_range", *[F.coalesce(F.sum(f"_total_{out}").over(before), F.lit(0)).cast("long").alias(f"_moved_{out}") for out in sums])
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parted.join(F.broadcast(moved), "_range")
    return summed.select(*df.columns, *[(F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long") + F.col(f"_moved_{out}")).alias(out) for out, value in sums.items()])


def running_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """running_sums() of one value."""
    return running_sums(df, order, {out: value})


def dense_index(df: DataFrame, order: str, out: str = "idx") -> DataFrame:
    """Numbers rows from 0 in ascending order of the unique column ``order``."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")
