"""Running totals per key without putting a whole key in one task.

A window partitioned by the key alone would send every row of a hot key to a
single task. Here the ordered rows of a key are cut into slices; the window
runs per (key, slice), the slice totals are summed per key over the slices
before each one, and the two are added. Only a single slice of a single key
ever shares a task.

Slices come from range partitioning on (key, order): Spark samples the bounds,
so a key with a third of all rows, even all in one burst of time, spans many
ranges; each range is sorted and cut into chunks of ``rows_per_slice`` rows.
The slice number grows along the order inside a key; callers write the sliced
rows once, so it never changes afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_range_slices(df: DataFrame, key: str, order_cols: list[str], partitions: int,
                      rows_per_slice: int = 100_000, out: str = "_slice") -> DataFrame:
    """Add ``out``: a slice number that grows along (key, order) and covers at most
    ``rows_per_slice`` rows. Rows are range-partitioned on (key, order) and sorted inside each
    range; ``monotonically_increasing_id`` is then (range number << 33) + position, so dividing it
    by the chunk size numbers consecutive chunks. Write the result once before using it."""
    ranged = df.repartitionByRange(partitions, key, *order_cols).sortWithinPartitions(key, *order_cols)
    return ranged.withColumn(out, F.floor(F.monotonically_increasing_id() / F.lit(int(rows_per_slice))).cast("long"))


def running_sum(df: DataFrame, key: str, order_cols: list[str], value: str, out: str,
                slice_col: str) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows of the same ``key`` up to and including this one,
    in ``order_cols`` order. ``slice_col`` must be non-decreasing along that order."""
    inside = Window.partitionBy(key, slice_col).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    within = df.withColumn("_run_in", F.sum(value).over(inside))
    totals = df.groupBy(key, slice_col).agg(F.sum(value).alias("_slice_total"))
    before = Window.partitionBy(key).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, slice_col, F.coalesce(F.sum("_slice_total").over(before), F.lit(0)).alias("_run_off"))
    return (within.join(offsets, [key, slice_col])
            .withColumn(out, (F.col("_run_off") + F.col("_run_in")).cast("long"))
            .drop("_run_in", "_run_off"))
