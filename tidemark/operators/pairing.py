"""Joins between assets: sidecars, originals, camera families, widening candidate pools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.functions import values as V
from tidemark.operators import corpus


def pair_sidecars(assets: DataFrame) -> DataFrame:
    """(sidecar, path): a sidecar belongs to the file whose full name is its stem, else to the only file of its stem."""
    named = assets.select("path", "kind", F.col("path").alias("p")).withColumns({"dir": paths.dir_of(F.col("p")), "name": paths.base_of(F.col("p"))}).drop("p")
    media = named.filter(F.col("kind").isin(*V.MEDIA_KINDS) & ~paths.is_sidecar(F.col("path")))
    sidecars = named.filter(paths.is_sidecar(F.col("path"))).select(F.col("path").alias("sidecar"), "dir", F.lower(paths.stem_of(F.col("name"))).alias("key"))
    exact = media.groupBy("dir", F.lower("name").alias("key")).agg(F.max("path").alias("exact"))
    only = media.groupBy("dir", F.lower(paths.stem_of(F.col("name"))).alias("key")).agg(F.min("path").alias("only"), F.count("*").alias("n")).filter("n = 1").drop("n")
    both = sidecars.join(exact, ["dir", "key"], "left").join(only, ["dir", "key"], "left")
    return both.select("sidecar", F.coalesce("exact", "only").alias("path")).filter("path IS NOT NULL")


def originals_of(facts: DataFrame, originals: DataFrame) -> DataFrame:
    """(path, original, ...): what the first original (by path) of the document id that a file derives from says.

    originals: path and the columns to inherit, of files with an original capture date.
    """
    w = Window.partitionBy("document_id").orderBy("path")
    first = facts.filter("document_id IS NOT NULL").join(originals, "path").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").select("document_id", F.col("path").alias("original"), *[c for c in originals.columns if c != "path"])
    return facts.filter("derived_from IS NOT NULL").select("path", "derived_from").join(first, F.col("derived_from") == F.col("document_id")).filter("path <> original").drop("derived_from", "document_id")


def family_match(queries: DataFrame, census: DataFrame, least: int = V.FAMILY_NEIGHBOURS) -> DataFrame:
    """(path, model, matched_by, first_year, last_year, neighbours): the query's own model if others of the directory have it, else the only model of enough neighbours with a side in common.

    queries: path, dir, model, width, height and, where the query itself is counted in the census, own_year: a
    photo is no neighbour of its own. Only its own model's row counts it, so the search by sides leaves that model alone.
    """
    if "own_year" not in queries.columns:
        queries = queries.withColumn("own_year", F.lit(None).cast("int"))
    years = ["first_year", "last_year", "neighbours"]
    own = corpus.without(queries.select("path", "dir", "model", "own_year").join(census, ["dir", "model"]), "own_year").filter("neighbours > 0").select("path", "model", F.lit("exif").alias("matched_by"), *years)
    sides = census.filter(F.col("neighbours") >= least).select("dir", F.col("model").alias("found"), F.explode("sides").alias("side"))
    rest = queries.join(own.select("path"), "path", "left_anti").select("path", "dir", "model", F.explode(F.array_distinct(F.array_compact(F.array("width", "height")))).alias("side"))
    hits = rest.join(sides, ["dir", "side"]).filter(~F.col("found").eqNullSafe(F.col("model"))).groupBy("path", "dir").agg(F.count_distinct("found").alias("models"), F.min("found").alias("model")).filter("models = 1")
    return own.unionByName(hits.join(census, ["dir", "model"]).select("path", "model", F.lit("geometry").alias("matched_by"), *years))


def widening_pool(queries: DataFrame, candidates: DataFrame, levels: list[str], least: int = 3) -> DataFrame:
    """(query, candidate, level): the candidates of the first level with at least `least` of them.

    queries: query and one column for each level (own directory, parent, ...); candidates: candidate and the same
    columns. An equi-join for each level, counted before anything is fetched; a query stops at its first full level.
    """
    out = None
    left = queries
    for k, level in enumerate(levels):
        sizes = candidates.groupBy(level).agg(F.count("*").alias("pool"))
        ready = left.join(sizes, level).filter(F.col("pool") >= least).select("query", level)
        found = ready.join(candidates.select("candidate", level), level).select("query", "candidate", F.lit(k).alias("level"))
        out = found if out is None else out.unionByName(found)
        left = left.join(ready.select("query"), "query", "left_anti")
    return out


def broken_class(assets: DataFrame, verdicts: DataFrame, saved: DataFrame) -> DataFrame:
    """(path, saved columns) of JPEG photos that an editor saved and that have no date of their own."""
    undated = verdicts.filter("status <> 'dated'").select("path")
    return assets.filter("kind = 'photo' AND format = 'jpeg'").select("path").join(undated, "path", "left_semi").join(saved, "path")


def nominate(queries: DataFrame, candidates: DataFrame, levels: int = V.PIXEL_LEVELS, least: int = V.PIXEL_LEAST, most: int | None = V.PIXEL_MOST) -> DataFrame:
    """(query, candidate, day, level, available): which dated photos could be the original of a query.

    queries: path, model, latest (month 'yyyy-MM'), both may be null; candidates: path, model, day. A pool is what lies in
    the query's own directory, or else anywhere below its parent, and so on for `levels` more, of the same model where
    both are known and not of a later month; the first pool of at least `least` is taken. Of a pool the first `most`
    by path are compared (as the search is defined; most=None compares all), `available` is its whole number. Queries of one directory, model and month share
    a pool, so pools are made for those keys, level by level, and only keys without one go on.
    """
    steps = F.reverse(paths.ancestors(F.col("path")))
    named = queries.select(F.col("path").alias("query"), F.col("model").alias("q_model"), "latest", paths.dir_of(F.col("path")).alias("own"), steps.alias("up"))
    keys = ["own", "q_model", "latest"]
    left = named.groupBy(*keys).agg(F.first("up").alias("up"))
    own = candidates.select(F.col("path").alias("candidate"), F.col("model").alias("c_model"), "day", paths.dir_of(F.col("path")).alias("dir"))
    below = candidates.select(F.col("path").alias("candidate"), F.col("model").alias("c_model"), "day", F.explode(F.concat(paths.ancestors(F.col("path")), F.array(F.lit("")))).alias("dir")).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys])
    found = None
    for level in range(levels + 1):
        here = F.coalesce(F.get("up", F.lit(level)), F.when(F.size("up") == level, F.lit("")))  # after the last ancestor comes the root
        at = left.withColumn("dir", here).filter("dir IS NOT NULL")
        fits = (F.col("q_model").isNull() | F.col("c_model").isNull() | (F.col("q_model") == F.col("c_model"))) & (F.col("latest").isNull() | (F.substring("day", 1, 7) <= F.col("latest")))
        pool = at.join(own if level == 0 else below, "dir").filter(fits).select(*keys, "candidate", "day")
        sizes = pool.groupBy(*keys).agg(F.count("*").alias("available")).filter(F.col("available") >= least)
        first = pool if most is None else pool.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("candidate"))).filter(F.col("place") <= most)
        rows = first.alias("l").join(sizes.alias("r"), same).select("l.*", "r.available", F.lit(level).alias("level")).drop("place")
        found = rows if found is None else found.unionByName(rows)
        left = left.alias("l").join(sizes.alias("r"), same, "left_anti")
    return named.alias("l").join(found.alias("r"), same).select("l.query", "r.candidate", "r.day", "r.level", "r.available")
