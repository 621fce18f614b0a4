"""What the whole inventory says: bulk-copy days, the earliest populated year, consensus years, cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, paths
from tidemark.functions import values as V
from tidemark.operators.verdict import is_confident


def spike_days(instants: DataFrame, ts: str, min_count: int = V.SPIKE_COUNT, min_share: float = V.SPIKE_SHARE) -> DataFrame:
    """(day, files): UTC days with at least min_count files and min_share of all. One aggregation; the total is its sum."""
    days = instants.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("files"))
    total = days.agg(F.sum("files").alias("total"))
    return days.crossJoin(F.broadcast(total)).filter((F.col("files") >= min_count) & (F.col("files") >= min_share * F.col("total"))).drop("total")  # total is one row


def floor_year(evidence: DataFrame, now_year: int, share: float = V.FLOOR_SHARE, least: int = V.FLOOR_COUNT) -> DataFrame:
    """(floor_year), one row: the first year with enough capture claims, null if none has."""
    claims = evidence.filter(F.col("kind").isin(*V.FLOOR_KINDS) & F.col("wall").isNotNull() & ~dates.is_reset_clock(F.col("wall")) & dates.is_plausible_year(F.col("wall.year"), now_year))
    years = claims.groupBy(F.col("wall.year").alias("year")).agg(F.count("*").alias("n"))
    total = years.agg(F.sum("n").alias("total"))
    enough = F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("total") * share))
    return years.crossJoin(F.broadcast(total)).agg(F.min(F.when(enough, F.col("year"))).alias("floor_year"))  # total is one row


def consensus_years(rows: DataFrame, group: str, year: str, least: int = V.COHORT_COUNT, share: float = V.COHORT_SHARE) -> DataFrame:
    """(group, year, n, total): the most frequent year of each group if it is frequent enough; ties go to the earlier year."""
    counts = rows.filter(F.col(year).isNotNull()).groupBy(group, F.col(year).alias("year")).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.max_by("year", F.struct("n", -F.col("year"))).alias("year"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.filter((F.col("n") >= least) & (F.col("n") >= share * F.col("total")))


def cohorts(verdicts: DataFrame) -> DataFrame:
    """(dir, year, n, total) of directories whose confident verdicts agree."""
    return consensus_years(verdicts.filter(is_confident()).withColumn("dir", paths.dir_of(F.col("path"))), "dir", "year")


def camera_census(verdicts: DataFrame, facts: DataFrame) -> DataFrame:
    """(dir, model, first_year, last_year, neighbours, sides, years): the cameras of each directory's confident verdicts.

    years: (year, n) in ascending order, as many as there are plausible years at most; with them a photo that is itself
    counted can be left out again (`without`).
    """
    rows = facts.filter("model IS NOT NULL").join(verdicts.filter(is_confident()).select("path", "year"), "path").withColumn("dir", paths.dir_of(F.col("path")))
    sides = rows.groupBy("dir", "model").agg(F.array_sort(F.array_compact(F.array_union(F.collect_set("width"), F.collect_set("height")))).alias("sides"))
    years = rows.groupBy("dir", "model", "year").agg(F.count("*").alias("n")).groupBy("dir", "model").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("n").alias("neighbours"), F.array_sort(F.collect_list(F.struct("year", "n"))).alias("years"))
    return years.join(sides, ["dir", "model"]).select("dir", "model", "first_year", "last_year", "neighbours", "sides", "years")


def without(census: DataFrame, own_year: str) -> DataFrame:
    """Rows of a census with first_year, last_year and neighbours as they are without one photo of own_year (null: it isn't counted)."""
    left = F.filter("years", lambda y: (y["year"] != F.col(own_year)) | F.col(own_year).isNull() | (y["n"] > 1))
    own = F.col(own_year).isNotNull()
    return census.withColumn("years", left).withColumns({"first_year": F.array_min("years")["year"], "last_year": F.array_max("years")["year"], "neighbours": F.col("neighbours") - own.cast("long")})
