"""Where an asset belongs: one CASE from kind and verdict to a destination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, paths
from tidemark.functions import values as V


def _strings(*items: Column | str) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(x) for x in items])


def bucketed(assets: DataFrame) -> DataFrame:
    """Adds action, segments, name, why and issue to rows of path, kind, status, date, instant, year, season, assumed, winner and is_copy."""
    path, kind, status, year = (F.col(c) for c in ("path", "kind", "status", "year"))
    sub = F.when(kind == "video", _strings(V.KIND_SUBDIR["video"])).when(kind == "audio", _strings(V.KIND_SUBDIR["audio"])).otherwise(F.array().cast("array<string>"))
    tail = F.concat(sub, paths.custom_dirs(path))
    of_year = F.array(year.cast("string"))
    season = F.element_at(F.create_map(*[F.lit(x) for pair in V.SEASON_OF_WORD.items() for x in pair]), F.col("season"))
    when = F.coalesce(F.substring(F.col("date"), 6, 2).cast("int"), F.month("instant"))
    taken = F.coalesce(F.substring(F.col("date"), 1, 4).cast("int"), F.year("instant"))
    why = (
        F.when(F.col("is_copy"), "copy").when(kind == "junk", "junk").when(kind == "other", "other").when(F.coalesce(status, F.lit("unknown")) == "unknown", "unknown")
        .when(F.col("assumed"), "assumed").when((status == "partial") & season.isNotNull(), "partial-season").when(status == "partial", "partial-year").otherwise("dated")
    )
    rows = assets.withColumn("why", why)
    why = F.col("why")
    segments = (
        F.when(why == "copy", _strings(V.GLOBAL_OTHER, V.DUPES_DIR)).when(why == "junk", _strings(V.GLOBAL_OTHER, V.JUNK_DIR)).when(why == "unknown", F.concat(_strings(V.GLOBAL_OTHER), tail))
        .when(why == "partial-season", F.concat(of_year, F.array(season), tail)).when(why.isin("assumed", "partial-year"), F.concat(of_year, _strings(V.YEAR_OTHER), tail))
        .when(why == "dated", F.concat(F.array(taken.cast("string")), F.array(dates.season_of_month(F.when(why == "dated", when))), tail)).otherwise(F.array().cast("array<string>"))
    )
    issue = (
        F.when(why == "assumed", "assumed-year").when((why == "partial-year") & F.col("season").isNotNull(), "ambiguous-season")
        .when((why == "dated") & F.col("instant").isNotNull() & dates.near_season_boundary(F.col("instant")), "timezone-boundary")
    )
    name = F.when(why.isin("copy", "junk"), paths.flat_name(path)).otherwise(paths.base_of(path))
    return rows.withColumns({"action": F.when(why == "other", "stay").otherwise("move"), "segments": segments, "name": name, "issue": issue})


def target() -> Column:
    """The planned path of bucketed rows."""
    return F.concat_ws("/", F.col("segments"), F.col("name"))
