"""Dense 1..n numbering of distinct keys without a single-partition window.

``row_number() over (order by k)`` moves every row into one task. Here the
distinct keys are range-partitioned (so many ranges that each stays small),
written to the shared checkpoint folder, counted per range, and numbered inside
each range. The ranges are read back from the written copy, so a recomputation
after an executor loss yields the same numbers. The offsets hold one row per
range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doppel.session import written

ROWS_PER_RANGE = 1_000_000


def dense_number(keys: DataFrame, key: str | list[str], out: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``out`` = 1..n in ascending order of the distinct, non-null key columns."""
    cols = [key] if isinstance(key, str) else list(key)
    distinct = written(keys.select(*cols).dropna(subset=cols).distinct())
    ranges = -(-distinct.count() // rows_per_range) or 1
    ranged = written(distinct.repartitionByRange(ranges, *cols).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*cols))
    return ranged.join(offsets, "_range").select(*cols, (F.col("_off") + place).alias(out))


def running_sum(rows: DataFrame, order: list[str], value: str, out: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before a row in the order of ``order`` (unique keys)."""
    held = written(rows)
    ranges = -(-held.count() // rows_per_range) or 1
    ranged = written(held.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_s"))
    # one row a range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_off"))
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(before), F.lit(0))
    return ranged.join(offsets, "_range").withColumn(out, F.col("_off") + inside).drop("_range", "_off")
