"""Equal files: groups by content hash, one keeper each and the criteria that decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.functions import values as V


def keeper_scores(status: Column, assumed: Column, path: Column) -> list[Column]:
    """Smaller is better: certainty of the date, assumed, marked as a copy, in the inbox, depth."""
    return [
        F.when(status == "dated", 0).when(status == "partial", 1).otherwise(2), F.coalesce(assumed, F.lit(False)).cast("int"), paths.looks_like_a_copy(path).cast("int"),
        paths.in_inbox(path).cast("int"), paths.depth(path),
    ]


def choose_keepers(rows: DataFrame, key: str, path: str, scores: list[Column], reasons: tuple[str, ...] = V.KEEPER_REASONS) -> DataFrame:
    """(key, keeper, n, reason) of groups of two or more: the least by all scores and then the path.

    A criterion counts as decisive if the rows that equal the keeper on all earlier ones differ on it.
    Only least and greatest scores are aggregated, in one pass for each criterion over the rows still equal, so
    a group of any size is never gathered in one place.
    """
    named = rows.select(F.col(key).alias("key"), F.col(path).alias("path"), F.array(*[s.cast("long") for s in scores]).alias("s"))
    best = named.groupBy("key").agg(F.min(F.struct("s", "path")).alias("best"), F.count("*").alias("n")).filter("n > 1")
    k = len(scores)
    equal = lambda upto: F.slice(F.col("s"), 1, upto) == F.slice(F.col("best.s"), 1, upto) if upto else F.lit(True)
    differs = [F.max(equal(i) & (F.get("s", F.lit(i)) != F.get("best.s", F.lit(i)))).alias(f"d{i}") for i in range(k)]
    told = named.join(best, "key").groupBy("key").agg(F.first("best").alias("best"), F.first("n").alias("n"), *differs, F.count_if(equal(k)).alias("same"))
    decisive = F.array_compact(F.array(*[F.when(F.col(f"d{i}"), reasons[i]) for i in range(k)], F.when(F.col("same") > 1, reasons[k])))
    return told.select(F.col("key").alias(key), F.col("best.path").alias("keeper"), "n", F.array_join(decisive, V.KEEPER_REASON_LINK).alias("reason"))


def duplicate_groups(assets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(sha256, keeper, n, reason) of media files with equal content."""
    media = assets.filter(F.col("kind").isin(*V.MEDIA_KINDS) & F.col("sha256").isNotNull()).join(verdicts.select("path", "status", "assumed"), "path", "left")
    return choose_keepers(media, "sha256", "path", keeper_scores(F.col("status"), F.col("assumed"), F.col("path")))


def copies(assets: DataFrame, groups: DataFrame) -> DataFrame:
    """(path, keeper) of every copy that isn't the keeper."""
    media = assets.filter(F.col("kind").isin(*V.MEDIA_KINDS) & F.col("sha256").isNotNull())
    return media.select("path", "sha256").join(groups.select("sha256", "keeper"), "sha256").filter("path <> keeper").select("path", "keeper")
