"""Running sums over a whole table in a total order, without one task that holds it.

The rows are range-partitioned by the order and written with the number of
their range; sums of whole ranges (a row each) come first, then sums inside
each range.  A key that very many rows share is spread as long as the order
tells its rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagecask.sources.scratch import written


def in_ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``_range``, which rises with the order; written, since partition numbers must not change any more."""
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def running_total(ranged: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each one."""
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offset = sums.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(offset, "_range").withColumn(out, inside + F.col("_before")).drop("_before")
