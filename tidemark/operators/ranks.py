"""Ranks inside keys of any size: rows are sorted by ranges, so that one key's rows may lie in many partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """rows with their place (from 1) among the rows of equal keys, in the given order; keys aren't null.

    The sorted rows are written once with ids that ascend over the partitions. What a key has in earlier
    partitions is a prefix sum over one small row for each key and partition.
    """
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "placed").withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    return placed.join(parts, [*keys, "_part"]).withColumn(name, F.col("_ahead") + F.col("_at") - F.col("_first") + 1).drop("_at", "_part", "_first", "_ahead")
