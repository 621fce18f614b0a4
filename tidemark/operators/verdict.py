"""Resolution: the ranked claims of an asset become one verdict that keeps what it overruled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions import values as V


def judged(evidence: DataFrame, now_year: int, floor_year: DataFrame | int | None = None) -> DataFrame:
    """Evidence with `year`, `fate` (null for a candidate, else why not) and `place` (order of the claim).

    floor_year is a number or a one-row DataFrame with the column floor_year.
    """
    if isinstance(floor_year, DataFrame):
        evidence = evidence.crossJoin(F.broadcast(floor_year.select(F.col("floor_year").alias("_floor"))))  # one row
    else:
        evidence = evidence.withColumn("_floor", F.lit(floor_year).cast("int"))
    year = dates.claim_year(F.col("wall"), F.col("instant"))
    reset = F.col("_floor").isNotNull() & ~F.col("date_only") & F.col("kind").isin(*V.RESET_CLOCK_KINDS) & dates.is_reset_clock(F.col("wall")) & (year < F.col("_floor"))
    fate = (
        F.when(~dates.is_plausible_year(year, now_year), "implausible-year").when(reset, "reset-camera-clock")
        .when(F.col("kind") == "fs-mtime", "ignored").when(F.col("kind") == "editor-save", "editor-save-date")
    )
    place = F.row_number().over(Window.partitionBy("path").orderBy("rank", "source_ord", "seq"))
    return evidence.withColumns({"year": year, "fate": fate, "place": place}).drop("_floor")


def resolve(evidence: DataFrame, now_year: int, floor_year: DataFrame | int | None = None) -> DataFrame:
    """One verdict per path: one shuffle by path, then everything from the asset's sorted claims."""
    rows = judged(evidence, now_year, floor_year)
    row = F.struct("place", "kind", "confidence", "wall", "instant", "date_only", "detail", "season", "year", "fate")
    claims = rows.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("claims"))
    candidates = F.filter("claims", lambda c: c["fate"].isNull())
    claims = claims.withColumn("won", F.get(candidates, F.lit(0))).withColumn("losers", F.slice(candidates, 2, F.greatest(F.size(candidates) - 1, F.lit(0))))
    w = F.col("won")
    partial = w["kind"].isin(*V.PARTIAL_KINDS)
    text = F.when(~partial & w["wall"].isNotNull(), F.when(w["date_only"], F.substring(dates.format_wall(w["wall"]), 1, 10)).otherwise(dates.format_wall(w["wall"])))
    dispute = lambda c, reason: F.struct(c["kind"].alias("kind"), c["detail"].alias("detail"), reason.alias("reason"))
    rejected = F.transform(F.filter("claims", lambda c: c["fate"].isNotNull() & (c["fate"] != "ignored")), lambda c: dispute(c, c["fate"]))
    conflicts = F.transform(F.filter("losers", lambda c: c["year"] != w["year"]), lambda c: dispute(c, F.lit("conflicts-with-winner")))
    agreeing = F.filter("losers", lambda c: c["year"] == w["year"])
    known = w.isNotNull()
    return claims.select(
        "path", F.when(~known, "unknown").when(partial, "partial").otherwise("dated").alias("status"), text.alias("date"), F.when(known, w["date_only"]).alias("date_only"),
        F.when(~partial, w["instant"]).alias("instant"), w["year"].alias("year"), F.when(partial, w["season"]).alias("season"), w["confidence"].alias("confidence"), w["kind"].alias("winner"),
        F.transform(agreeing, lambda c: c["kind"]).alias("corroborated"), F.coalesce(w["kind"].isin(*V.ASSUMED_KINDS), F.lit(False)).alias("assumed"), F.concat(rejected, conflicts).alias("disputed"),
    )


def is_confident(verdict: str | None = None) -> Column:
    """Whether a verdict can speak for its neighbours: a year, not assumed, not of low confidence."""
    c = (lambda n: F.col(f"{verdict}.{n}")) if verdict else F.col
    return c("year").isNotNull() & ~c("winner").isin(*V.ASSUMED_KINDS) & (c("confidence") != "low")


def counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("dated", "partial", "unknown")])
