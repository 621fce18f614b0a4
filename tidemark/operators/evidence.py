"""Evidence extraction: an asset gives any number of dated claims, one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, paths
from tidemark.functions import values as V
from tidemark.functions.dates import WALL

CLAIM = f"struct<kind:string,confidence:string,wall:{WALL},instant:timestamp,date_only:boolean,detail:string,season:string>"
CLAIM_COLUMNS = ("path", "source_ord", "seq", "kind", "rank", "confidence", "wall", "instant", "date_only", "detail", "season", "discounted")


def claim(kind: str, wall: Column | None = None, instant: Column | None = None, date_only: bool | Column = False, detail: str | Column | None = None, season: Column | None = None, confidence: str | None = None) -> Column:
    """A claim of exactly one of wall and instant, null where that is null."""
    if (wall is None) == (instant is None):
        raise ValueError("a claim has either a wall clock or an instant")
    if kind not in V.RANK:
        raise ValueError(f"no kind of evidence: {kind}")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = lambda kind: F.lit(None).cast(kind)
    made = F.struct(
        F.lit(kind).alias("kind"), F.lit(confidence or V.CONFIDENCE[kind]).alias("confidence"), (none(WALL) if wall is None else wall).alias("wall"), (none("timestamp") if instant is None else instant).alias("instant"),
        lit(date_only).alias("date_only"), lit(detail).cast("string").alias("detail"), (none("string") if season is None else season).alias("season"),
    ).cast(CLAIM)
    return F.when((instant if wall is None else wall).isNotNull(), made)


def rank_of(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, V.EVIDENCE_KINDS)), kind).cast("int") - 1


#: Detectors in the order in which their claims count: name, pattern, groups (6 wall parts, 3 date parts, 1 digits or 0 a year), confidence.
_EDGE, _END = "(?:^|[^0-9])", "(?=[^0-9]|$)"
_Y, _2 = "([0-9]{4})", "([0-9]{2})"
DETECTORS = (
    ("android-camera", rf"(?i)^(?:IMG|VID|PANO|BURST)_{_Y}{_2}{_2}_{_2}{_2}{_2}", 6, None),
    ("screenshot", rf"(?i)^Screenshot[ _-]{_Y}-{_2}-{_2}-{_2}-{_2}-{_2}", 6, None),
    ("whatsapp", rf"(?i)^(?:IMG|VID|AUD)-{_Y}{_2}{_2}-WA[0-9]+", 3, None),
    ("windows-phone", rf"(?i)^WP_{_Y}{_2}{_2}_", 3, None),
    ("ios-dotted", rf"^{_Y}-{_2}-{_2}[ _]{_2}\.{_2}\.{_2}", 6, None),
    ("leading-iso-date", rf"^{_Y}-{_2}-{_2}(?:[^0-9]|$)", 3, None),
    ("telegram-photo", r"(?i)^photo([0-9]{10})$", 1, None),
    ("epoch-stem", r"^([0-9]{10}|[0-9]{13})$", 1, None),
    ("paren-epoch", r"\(([0-9]{10}|[0-9]{13})\)", 1, None),
    ("compact-anywhere", rf"{_EDGE}{_Y}{_2}{_2}[_-]{_2}{_2}{_2}{_END}", 6, "medium"),
    ("iso-date-anywhere", rf"{_EDGE}{_Y}-{_2}-{_2}{_END}", 3, "medium"),
    ("year-anywhere", rf"{_EDGE}((?:19|20)[0-9]{{2}}){_END}", 0, None),
)


def _let(value: Column, body) -> Column:
    """body(value) with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def name_claims(name: Column, now_year: int) -> Column:
    """All claims of a file name, an array in detector order.

    A detector's groups are extracted once, and only from names that match it.
    """

    def detected(stem: Column, detail: str, pattern: str, parts: int, confidence: str | None) -> Column:
        if parts == 1:
            made = lambda g: claim("filename-epoch", instant=dates.epoch_instant(g[0], now_year), detail=detail)
        elif parts == 0:
            made = lambda g: claim("filename-year", wall=F.when(dates.is_plausible_year(g[0].cast("int"), now_year), dates.wall(g[0], F.lit(1), F.lit(1))), date_only=True, detail=detail)
        else:
            made = lambda g: claim("filename-timestamp", wall=dates.wall(*[g[i] for i in range(parts)]), date_only=parts == 3, detail=detail, confidence=confidence)
        groups = F.array(*[F.regexp_extract(stem, pattern, i) for i in range(1, max(parts, 1) + 1)])
        return F.when(stem.rlike(pattern), _let(groups, made))

    return _let(paths.stem_of(name), lambda stem: F.array_compact(F.array(*[detected(stem, *d) for d in DETECTORS])))


def best_name_claim(name: Column, now_year: int) -> Column:
    return F.get(name_claims(name, now_year), F.lit(0))


def directory_claim(path: Column, now_year: int) -> Column:
    """The claim of the innermost directory with a plausible year, or null.

    A season word may stand in that directory or in a deeper one that doesn't carry another year.
    """
    year_of = lambda s: F.nullif(F.regexp_extract(s, V.YEAR_TOKEN, 1), F.lit("")).cast("int")
    season_of = lambda s: F.nullif(F.lower(F.regexp_extract(s, V.SEASON_TOKEN, 1)), F.lit(""))
    parts = F.transform(F.reverse(paths.directories(path)), lambda s, i: F.struct(s.alias("name"), i.alias("i"), year_of(s).alias("year"), season_of(s).alias("season")))

    def found(parts: Column, dated: Column) -> Column:
        season = F.get(F.filter(parts, lambda p: p["season"].isNotNull() & (p["i"] <= dated["i"]) & ((p["i"] == dated["i"]) | p["year"].isNull() | (p["year"] == dated["year"]))), F.lit(0))
        detail = F.when(season["name"] != dated["name"], F.concat_ws("/", dated["name"], season["name"])).otherwise(dated["name"])
        return claim("dirname", wall=dates.wall(dated["year"], F.lit(1), F.lit(1)), date_only=True, detail=detail, season=season["season"])

    first = lambda parts: F.get(F.filter(parts, lambda p: dates.is_plausible_year(p["year"], now_year)), F.lit(0))
    return _let(parts, lambda parts: _let(first(parts), lambda dated: found(parts, dated)))


def exploded(assets: DataFrame, claims: Column, source_ord: int) -> DataFrame:
    """Evidence rows of an array of claims for each path."""
    rows = assets.select("path", F.posexplode(claims).alias("seq", "claim"))
    return rows.select(
        "path", F.lit(source_ord).alias("source_ord"), "seq", F.col("claim.kind").alias("kind"), rank_of(F.col("claim.kind")).alias("rank"), "claim.confidence", "claim.wall", "claim.instant", "claim.date_only", "claim.detail", "claim.season", F.lit(False).alias("discounted"),
    )


def mtime_claims(assets: DataFrame, spike_days: DataFrame, source_ord: int = 9) -> DataFrame:
    """Modification times as claims; `discounted` on days on which files were copied in bulk."""
    instant = F.timestamp_millis(F.col("mtime_ms").cast("long"))
    rows = assets.filter("mtime_ms IS NOT NULL").withColumn("instant", instant).withColumn("day", F.to_date("instant"))
    # days are few against files: one row each, and Spark decides on the join by their size
    rows = rows.join(spike_days.select("day", F.lit(True).alias("spike")), "day", "left")
    return rows.select("path", F.lit(source_ord).alias("source_ord"), F.lit(0).alias("seq"), F.lit("fs-mtime").alias("kind"), F.lit(V.RANK["fs-mtime"]).alias("rank"), F.lit("low").alias("confidence"), F.lit(None).cast(WALL).alias("wall"), "instant", F.lit(False).alias("date_only"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("season"), F.coalesce("spike", F.lit(False)).alias("discounted"))


def union(*sources: DataFrame) -> DataFrame:
    """All claims together; source_ord and seq keep the order of ties."""
    return reduce(DataFrame.unionByName, [s.select(*CLAIM_COLUMNS) for s in sources])


def collect(assets: DataFrame, now_year: int, *others: DataFrame) -> DataFrame:
    """Name and directory claims of media files together with claims from other sources (metadata, sidecars)."""
    media = assets.filter(F.col("kind").isin(*V.MEDIA_KINDS))
    names = exploded(media, name_claims(paths.base_of(F.col("path")), now_year), 1)
    dirs = exploded(media, F.array_compact(F.array(directory_claim(F.col("path"), now_year))), 2)
    return union(*others, names, dirs)
