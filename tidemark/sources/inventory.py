"""Listing a tree of files and reading what a scan needs of each: kind, format, content hash."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import identify, paths
from tidemark.functions import values as V
from tidemark.sources import cache
from tidemark.sources.scratch import written

RUNS_DIR, RECEIPT = V.RUNS_DIR, V.RECEIPT
_CHUNK = 1 << 20


#: Entries that a task lists before it hands the directories that it has found, but not listed, to others.
ENTRIES = 10_000
LISTED = "what string, path string, size long, mtime_ms double, error string"


def list_tree(spark: SparkSession, root: str, entries: int = ENTRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files: path, size, mtime_ms; dirs: dir; errors: path, error) below root, listed by tasks.

    A table of directories is the frontier: tasks list them and what is below, up to `entries` each, and what they
    leave is the next frontier. The tree has to be mounted on every worker. Links aren't followed; the runs' folder and the receipt are
    left out. A directory that can't be listed, a file that can't be asked and a name that isn't text are errors.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def tell(what: str, path: str, size: int | None = None, mtime: float | None = None, error: str | None = None) -> bool:
            try:
                path.encode()
            except UnicodeEncodeError:
                what, path, size, mtime, error = "error", path.encode("utf-8", "backslashreplace").decode(), None, None, "the name is no text"
            rows.append((what, path, size, mtime, error))
            return what != "error"

        for batch in batches:
            left = [path for path in reversed(batch.column(0).to_pylist())]
            given = entries
            while left:
                top = left.pop()
                if given <= 0:
                    tell("open", top)
                    continue
                try:
                    with os.scandir(os.path.join(root, top)) as found:
                        for entry in found:
                            path = f"{top}/{entry.name}" if top else entry.name
                            try:
                                if entry.is_symlink():
                                    continue
                                if entry.is_dir():
                                    if entry.name != RUNS_DIR and tell("dir", path):
                                        left.append(path)
                                elif entry.is_file() and entry.name != RECEIPT:
                                    stat = entry.stat()
                                    tell("file", path, stat.st_size, stat.st_mtime_ns / 1e6)
                            except OSError as error:
                                tell("error", path, error=str(error))
                            given -= 1
                except OSError as error:
                    tell("error", top or ".", error=str(error))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)
                    rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    names, types = ["what", "path", "size", "mtime_ms", "error"], [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string()]
    frontier, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        levels.append(written(frontier.mapInArrow(listed, LISTED), "listing"))
        frontier = levels[-1].filter("what = 'open'").select("path")
        if frontier.isEmpty():
            break
        frontier = frontier.repartition(spark.sparkContext.defaultParallelism * 4)
    rows = reduce(DataFrame.unionByName, levels)
    of = lambda what, *columns: rows.filter(F.col("what") == what).select(*columns)
    return of("file", "path", "size", "mtime_ms").orderBy("path"), of("dir", F.col("path").alias("dir")).orderBy("dir"), of("error", "path", "error")


def read_heads(files: DataFrame, root: str) -> DataFrame:
    """files with head (first bytes), sha256 and error; the tree has to be mounted on every worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, hashes, errors = [], [], []
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                head = digest = error = None
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        made, head = hashlib.sha256(), b""
                        while chunk := file.read(_CHUNK):
                            head = head or chunk[: V.SNIFF_BYTES]
                            made.update(chunk)
                        digest = made.hexdigest()
                except OSError as e:
                    error = str(e)
                heads.append(head)
                hashes.append(digest)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary()), pa.array(hashes, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names, "head", "sha256", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", head binary, sha256 string, error string"
    return files.mapInArrow(run, schema)


def binary_inventory(spark: SparkSession, root: str) -> DataFrame:
    """The same columns for a store that only Spark reads (whole files pass through the JVM)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select(F.col("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime_ms"), F.substring("content", 1, V.SNIFF_BYTES).alias("head"), F.sha2("content", 256).alias("sha256"))


def typed(files: DataFrame) -> DataFrame:
    """Adds kind and format from the name and the head."""
    kind = identify.identify(paths.base_of(F.col("path")), F.col("head"))
    return files.withColumn("_t", kind).withColumns({"kind": F.col("_t.kind"), "format": F.col("_t.format")}).drop("_t")


def scan_tree(spark: SparkSession, root: str, cached: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets, dirs, errors): every file body is read once, here, and files that the cache knows aren't read at all."""
    files, dirs, errors = list_tree(spark, root)
    columns = ["path", "size", "mtime_ms", "kind", "format", "sha256"]
    if cached is None:
        fresh = written(typed(read_heads(files, root)), "scan")
        hits = None
    else:
        probed = cache.probe(files, cached)
        hits = probed.filter("hit").select(columns)
        fresh = written(typed(read_heads(probed.filter("NOT hit").select("path", "size", "mtime_ms"), root)), "scan")
    assets = fresh.select(columns) if hits is None else hits.unionByName(fresh.select(columns))
    return assets, dirs, errors.unionByName(fresh.filter("error IS NOT NULL").select("path", "error"))
