"""Ranks of distinct values without a window over a whole column in one task.

Values are range-partitioned and written with the number of their range; a
row's rank is its place inside the range plus the rows of the same group in
earlier ranges.  These offsets come from one row per group and range (bounded
by the number of partitions, not by the values), so a column may have any
number of levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.session import scratch_path


def ranked(distinct: DataFrame, group: str, value: str, out: str = "rank") -> DataFrame:
    """``distinct(group, value)`` rows (no repeats, no nulls) with the 0-based rank of ``value`` inside ``group``.

    Runs one job, which writes the ranges; equal inputs give equal ranks
    whatever the ranges are.
    """
    spark = distinct.sparkSession
    path = scratch_path(spark, "ranges")
    ranges = distinct.select(group, value).repartitionByRange(group, value).withColumn("range", F.spark_partition_id())
    ranges.write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy(group, "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy(group, "range").orderBy(value)) - 1
    placed = rows.withColumn("inside", inside).join(F.broadcast(offsets), [group, "range"])
    return placed.select(group, value, (F.col("before") + F.col("inside")).alias(out))
