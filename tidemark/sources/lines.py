"""Numbered lines of text files that Spark may cut anywhere: a data source over byte ranges, for tables and for streams.

A range has the lines that begin in it, so a file of any size is read by many tasks and no line twice. The numbers
of lines are prefix sums over the ranges' counts. As a stream, the source tells how far each file is written up to
its last line end; what is appended afterwards is the next batch, and a torn line waits until it is whole.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, part long, at long, i long, text string"
SPLIT = 32 << 20
_CHUNK = 1 << 16


@dataclass
class Range(InputPartition):
    file: str
    part: int
    start: int
    end: int


def ranges(file: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(file, part, at, min(at + split, end)) for part, at in enumerate(range(start, end, split))]


def lines_of(piece: Range, begins: int) -> Iterator[tuple]:
    """(file, part, offset, place in the range, text) of the lines that begin in the range; `begins` is known to be a line's beginning."""
    with open(piece.file, "rb") as file:
        at = piece.start
        if at > begins:  # the line that the byte before belongs to is another range's
            file.seek(at - 1)
            at += len(file.readline()) - 1
        else:
            file.seek(at)
        i = 0
        while at < piece.end and (line := file.readline()):
            yield piece.file, piece.part, at, i, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line)
            i += 1


def whole_lines(file: str) -> int:
    """The offset behind the last line end."""
    at = os.path.getsize(file)
    with open(file, "rb") as opened:
        while at > 0:
            start = max(0, at - _CHUNK)
            opened.seek(start)
            if (found := opened.read(at - start).rfind(b"\n")) >= 0:
                return start + found + 1
            at = start
    return 0


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        return [r for file in sorted(glob.glob(self.path)) for r in ranges(file, 0, os.path.getsize(file), self.split)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_of(partition, 0) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({file: whole_lines(file) for file in sorted(glob.glob(self.path))})}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        known = json.loads(start["files"])
        return [r for file, to in json.loads(end["files"]).items() for r in ranges(file, known.get(file, 0), to, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_of(partition, partition.start - partition.part * self.split)

    def commit(self, end: dict) -> None:
        pass


class Lines(DataSource):
    """Format `numbered-lines`: load(a path or a pattern of paths that every worker sees), option split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "numbered-lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("split", SPLIT)))


def read_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, line, text) with numbers from 1 in each file."""
    spark.dataSource.register(Lines)
    rows = spark.read.format("numbered-lines").option("split", split).load(path)
    counts = rows.groupBy("file", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return rows.join(ahead, ["file", "part"]).select("file", (F.col("ahead") + F.col("i") + 1).alias("line"), "text")


def stream_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, at, text) as lines are appended to the files; `at` is the line's offset in bytes."""
    spark.dataSource.register(Lines)
    return spark.readStream.format("numbered-lines").option("split", split).load(path).select("file", "at", "text")
