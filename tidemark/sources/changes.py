"""The difference of two scans: what was added, changed, moved or is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import numbered


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, was) of two scans (ASSET columns): 'added', 'changed', 'gone', or 'moved' with the path that it had.

    A gone file and an added one of equal content, size and time are a move; of several the first by path become
    the first by path. Whatever else differs in size, time, content or kind is changed.
    """
    facts = ["size", "mtime_ms", "kind", "format", "sha256"]
    side = lambda df, name: df.select("path", F.struct(*facts).alias(name))
    rows = side(before, "was").join(side(after, "now"), "path", "full")
    gone, added = rows.filter("now IS NULL").select("path", "was.*"), rows.filter("was IS NULL").select("path", "now.*")
    changed = rows.filter("was IS NOT NULL AND now IS NOT NULL").filter(~F.col("was").eqNullSafe(F.col("now"))).select("path", F.lit("changed").alias("change"), F.lit(None).cast("string").alias("was"))
    same = F.sha2(F.concat_ws(":", "sha256", "size", F.coalesce(F.col("mtime_ms").cast("string"), F.lit(""))), 256)
    keyed = lambda df: numbered(df.filter("sha256 IS NOT NULL").select("path", same.alias("same")), ["same"], ["path"], "n")
    pairs = keyed(added).withColumnRenamed("path", "to").join(keyed(gone), ["same", "n"]).select("to", F.col("path").alias("from"))
    moved = pairs.select(F.col("to").alias("path"), F.lit("moved").alias("change"), F.col("from").alias("was"))
    new = added.join(pairs.select(F.col("to").alias("path")), "path", "left_anti").select("path", F.lit("added").alias("change"), F.lit(None).cast("string").alias("was"))
    lost = gone.join(pairs.select(F.col("from").alias("path")), "path", "left_anti").select("path", F.lit("gone").alias("change"), F.lit(None).cast("string").alias("was"))
    return changed.unionByName(moved).unionByName(new).unionByName(lost)
