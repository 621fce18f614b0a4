"""Proof that a run conserves content: order-free fingerprints of what lies in each directory, before and after.

A fingerprint is the number of files, their bytes and the sum of a hash of each content; sums don't depend on order, and they add
up over a tree. Equal roots mean equal contents wherever they lie; where they differ, the directories
that differ lead down to the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators import tree

_MARKS = ("files", "bytes", "mark")


def fingerprints(files: DataFrame) -> DataFrame:
    """(dir, files, bytes, mark) of the root '' and all directories with files below. files: path, size, sha256."""
    mark = F.xxhash64(F.coalesce("sha256", F.lit("")), F.coalesce("size", F.lit(0))).cast("decimal(38,0)")
    return tree.roll_up(files.select(paths.dir_of(F.col("path")).alias("dir"), F.lit(1).cast("long").alias("files"), F.coalesce("size", F.lit(0)).alias("bytes"), mark.alias("mark")), root=True)


def moved(files: DataFrame, moves: DataFrame) -> DataFrame:
    """files as they should lie after moves (from, to)."""
    return files.join(moves.select(F.col("from").alias("path"), "to"), "path", "left").withColumn("path", F.coalesce("to", "path")).drop("to")


def differing_dirs(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(dir, files_before, files_after) of the directories whose fingerprints differ, the root included."""
    a, b = (fingerprints(x).withColumnsRenamed({m: f"{m}_{side}" for m in _MARKS}) for x, side in ((expected, "before"), (found, "after")))
    both = a.join(b, "dir", "full")
    same = [F.col(f"{m}_before").eqNullSafe(F.col(f"{m}_after")) for m in _MARKS]
    return both.filter(~(same[0] & same[1] & same[2])).select("dir", F.coalesce("files_before", F.lit(0)).alias("files_before"), F.coalesce("files_after", F.lit(0)).alias("files_after"))


def not_conserved(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, what) of the files that aren't as expected: 'lost', 'changed', or 'new'; only differing directories are compared.

    Empty if and only if every content is where it should be, as often as before.
    """
    dirs = differing_dirs(expected, found).select("dir")
    near = lambda files: files.select("path", "size", "sha256", paths.dir_of(F.col("path")).alias("dir")).join(dirs, "dir", "left_semi")
    a = near(expected).select("path", F.struct("size", "sha256").alias("was"))
    b = near(found).select("path", F.struct("size", "sha256").alias("now"))
    rows = a.join(b, "path", "full")
    what = F.when(F.col("now").isNull(), "lost").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed")
    return rows.select("path", what.alias("what")).filter("what IS NOT NULL")


def contents(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(sha256, before, after) of contents that there are more or fewer of than before, wherever they lie."""
    count = lambda files, name: files.groupBy("sha256").agg(F.count("*").alias(name))
    rows = count(expected, "before").join(count(found, "after"), "sha256", "full").na.fill(0, ["before", "after"])
    return rows.filter("before <> after")
