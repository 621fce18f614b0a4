"""Bit vectors: distances and a decision by margin (the search itself is in nearest.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP, MAX_DISTANCE, MIN_MARGIN, MIN_COMPARED = 5, 128, 96, 3


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def sign_bits(vector: Column, start: int = 0, size: int = 64) -> Column:
    """The signs of up to 64 vector elements as one word, the first element in the lowest bit."""
    bits = F.transform(F.slice(vector, start + 1, size), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), (i % 32).cast("double")).cast("long"))
    low = F.aggregate(F.slice(bits, 1, 32), F.lit(0).cast("long"), lambda s, b: s + b)
    high = F.aggregate(F.slice(bits, 33, 32), F.lit(0).cast("long"), lambda s, b: s + b)
    return F.array(low, high)


def decide_by_margin(scored: DataFrame, query: str, candidate: str, distance: str, day: str, compared: str = "compared", max_distance: int = MAX_DISTANCE, min_margin: int = MIN_MARGIN, min_compared: int = MIN_COMPARED) -> DataFrame:
    """(query, best, day, distance, margin, decisive): best by (distance, candidate), margin to the best of another day (null: no rival)."""
    # a row per day is enough for both, so scored is made once and joined with nothing
    days = scored.groupBy(query, day).agg(F.min(F.struct(distance, candidate, day)).alias("b"), F.min(distance).alias("least"), F.max(compared).alias("compared"))
    days = days.withColumn("b", F.min("b").over(Window.partitionBy(query)))
    found = days.groupBy(query).agg(F.first("b").alias("b"), F.min(F.when(F.col(day) != F.col(f"b.{day}"), F.col("least"))).alias("rival"), F.max("compared").alias("compared"))
    rows = found.select(query, F.col(f"b.{candidate}").alias("best"), F.col(f"b.{day}").alias("day"), F.col(f"b.{distance}").alias("distance"), (F.col("rival") - F.col(f"b.{distance}")).alias("margin"), "compared")
    good = (F.col("compared") >= min_compared) & (F.col("distance") <= max_distance) & F.coalesce(F.col("margin") >= min_margin, F.lit(True))
    return rows.withColumn("decisive", good)
