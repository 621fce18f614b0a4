"""The scan cache: a Parquet table keyed by path, size and modification time."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import values as V


def path_of(root: str) -> str:
    """Where a tree's cache lies: in the folder of runs, which no scan lists."""
    return os.path.join(root, V.RUNS_DIR, "scan-cache")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The cached scan; another version, a missing or an unreadable table is an empty one."""
    empty = spark.createDataFrame([], schemas.struct(schemas.SCAN_CACHE))
    try:
        rows = spark.read.parquet(path)
    except Exception:  # no cache: everything is scanned anew
        return empty
    if not {"version", *empty.columns} <= set(rows.columns):
        return empty
    return rows.filter(F.col("version") == schemas.SCAN_CACHE_VERSION).select(empty.columns)


def save(assets: DataFrame, path: str) -> None:
    """Write the rows that have a hash, sorted by path. The new table takes the old one's place when it is whole, as assets may be read from that."""
    rows = assets.filter("sha256 IS NOT NULL").select("path", "size", "mtime_ms", "kind", "format", "sha256", F.lit(schemas.SCAN_CACHE_VERSION).alias("version"))
    rows.orderBy("path").write.mode("overwrite").parquet(f"{path}.new")
    shutil.rmtree(path, ignore_errors=True)
    os.replace(f"{path}.new", path)


def probe(listing: DataFrame, cached: DataFrame) -> DataFrame:
    """The listing with kind, format, sha256 and `hit`: only equal path, size and time count."""
    return listing.join(cached.withColumn("hit", F.lit(True)), ["path", "size", "mtime_ms"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def kept_after(spark: SparkSession, root: str, moves: DataFrame) -> None:
    """Rewrite a tree's cache after moves (from, to): a rename is no reason to read a file again."""
    rows = load(spark, path_of(root))
    if not rows.isEmpty():
        save(rekey(rows, moves), path_of(root))


def rekey(cached: DataFrame, moves: DataFrame) -> DataFrame:
    """The cache after moves (from, to); what lay at a target gives way."""
    moved = cached.join(moves.select(F.col("from").alias("path"), "to"), "path", "left")
    stale = moved.filter("to IS NULL").join(moves.select(F.col("to").alias("path")), "path", "left_semi").select("path")
    moved = moved.join(stale, "path", "left_anti")
    return moved.withColumn("path", F.coalesce("to", "path")).drop("to")
