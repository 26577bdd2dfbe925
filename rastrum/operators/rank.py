"""Numbers of rows in an order of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rastrum.session import checkpoint, partitions_of


def ranked(df: DataFrame, *order: str | Column, name: str = "r") -> DataFrame:
    """df with each row's number from 1 in the order, which must leave no ties.

    Rows are dealt into sorted ranges and numbered within their range; only the counts of the ranges come to
    the driver. The ranges are checkpointed, so that their counts and their numbers are of the same rows.
    """
    dealt = checkpoint(df.repartitionByRange(partitions_of(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()))
    counts = dict(dealt.groupBy("_range").count().collect())
    starts, at = [], 0
    for r in range(max(counts, default=0) + 1):
        starts.append(at)
        at += counts.get(r, 0)
    start = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_range"))
    return dealt.withColumn(name, start + F.row_number().over(Window.partitionBy("_range").orderBy(*order))).drop("_range")
