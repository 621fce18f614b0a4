"""Sums over a tree of directories, bottom-up: each level's totals are one row a directory, and go to the parents once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.sources.scratch import written


def roll_up(own: DataFrame, root: bool = False) -> DataFrame:
    """(dir, sums of the other columns over all below and itself) of every directory named in own and all above; with root also of ''.

    own: dir and numbers, any number of rows a directory. What is shuffled at a level is its directories, however many
    files and levels there are below.
    """
    sums = [F.sum(c).alias(c) for c in own.columns if c != "dir"]
    level = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    own = written(own.groupBy("dir").agg(*sums).withColumn("_level", level), "own-sums")
    deepest = own.agg(F.max("_level")).first()[0] or 0
    totals, below = [], None
    for at in range(deepest, -1 if root else 0, -1):
        rows = own.filter(F.col("_level") == at).drop("_level")
        if below is not None:
            rows = rows.unionByName(below.withColumn("dir", paths.dir_of(F.col("dir"))))
        below = written(rows.groupBy("dir").agg(*sums), f"level-{at}")
        totals.append(below)
    return reduce(DataFrame.unionByName, totals) if totals else own.drop("_level").filter("false")
