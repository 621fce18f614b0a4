"""Free names: claimants of one target path get ` (n)` with the first free n, as if they were served one after the other.

Claims are served in the order of (target, source). A given name can be a name that another claim asks for, so
the order matters; but it has a shape that leaves no need to serve anybody in turn:

* With an extension, `x (n).jpg` sorts before `x.jpg` (a space before a dot). When the claimants of `x.jpg` are served, all numbered
  names that were asked for are taken already, and nobody has been given `x.jpg`. So the first claimant gets
  it, and the r-th after it gets the r-th number from 2 on that isn't taken: with the taken numbers
  sorted, the i-th leaves taken - 1 - i free ones below it, and r's number is r + 1 plus the count of taken ones that have
  fewer than r free ones below. That is a merge of two sorted lists, done by ranks.
* Without an extension, `x` sorts before `x (n)`. Its claimants find no number taken, but `x` itself may have been given
  to a claimant of the name it extends. So they get x (unless it is taken) and then the numbers from 2 on, and whether
  `x (n)` is taken follows from how many claimants x had: level by level of nested numbers.

No group of claims is brought together anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators.ranks import numbered
from tidemark.sources.scratch import written

#: A number as it is given: from 2 on, without leading zeros (longer ones are never reached).
_NUMBERED = r"(?s)^(.+) \(([2-9]|[1-9][0-9]{1,17})\)$"
_EXTENSION = r"(?s)^.+(\.[^.]*)$"


def _parsed(target: Column) -> dict[str, Column]:
    """ext, base (the path without its last number) and number (null if there is none)."""
    name = paths.base_of(target)
    stem, ext = paths.stem_of(name), F.regexp_extract(name, _EXTENSION, 1)
    digits = F.regexp_extract(stem, _NUMBERED, 2)
    head = F.substring(target, F.lit(1), F.length(target) - F.length(name))
    return {"ext": ext, "number": F.when(digits != "", digits.cast("long")), "base": F.when(digits != "", F.concat(head, F.regexp_extract(stem, _NUMBERED, 1), ext))}


def _shifts(ranked: DataFrame, claims: DataFrame) -> DataFrame:
    """(target, rank, shift) of later claimants: the taken numbers that they have to pass. ranked: target, rank (0 for the first)."""
    wanted = claims.filter("n > 1").select("target", "n")
    taken = claims.filter("number IS NOT NULL").select(F.col("base").alias("target"), "number").join(wanted, "target")
    if taken.isEmpty():
        return ranked.filter("false").select("target", "rank", F.lit(0).cast("long").alias("shift"))
    taken = numbered(taken, ["target"], ["number"], "i").withColumn("free", F.col("number") - 1 - F.col("i")).filter("free < n - 1")
    asked = ranked.filter("rank > 0").join(taken.select("target").distinct(), "target", "left_semi")
    events = taken.select("target", F.col("free").alias("at"), F.lit(0).alias("asks")).unionByName(asked.select("target", (F.col("rank") - 1).alias("at"), F.lit(1).alias("asks")))
    merged = numbered(events, ["target"], ["at", "asks"], "place").filter("asks = 1")
    return merged.select("target", (F.col("at") + 1).alias("rank"), (F.col("place") - F.col("at") - 1).alias("shift"))


def _given_away(claims: DataFrame) -> DataFrame:
    """(target) of the names without extension that a claimant of another name was given."""
    plain = claims.filter("ext = ''").select("target", "n", "base", "number")
    if plain.filter("number IS NOT NULL").isEmpty():
        return plain.filter("false").select("target")
    top = plain.filter("number IS NULL").select("target", F.col("n").alias("top"))
    found = []
    left = plain.filter("number IS NOT NULL")
    # A name is settled once its base is: level by level of nested numbers, and bases that nobody asks for are settled.
    asked = plain.select(F.col("target").alias("base"))
    settled = left.join(asked, "base", "left_anti").select("target", F.col("n").alias("top"))
    top, left = written(top.unionByName(settled), "settled"), written(left.join(asked, "base", "left_semi"), "open")
    while not left.isEmpty():
        level = written(left.join(top.select(F.col("target").alias("base"), F.col("top").alias("given")), "base").withColumn("gone", (F.col("number") <= F.col("given"))), "level")
        found.append(level.filter("gone").select("target"))
        left = written(left.join(level.select("target"), "target", "left_anti"), "open")
        top = level.select("target", (F.col("n") + F.col("gone").cast("long")).alias("top"))
    return reduce(DataFrame.unionByName, found) if found else plain.filter("false").select("target")


def free_names(moves: DataFrame, source: str = "from", target: str = "to", final: str = "final") -> DataFrame:
    """moves with the name that each claim gets. Sources are distinct; no move asks for a null target."""
    asked = moves.select(F.col(f"`{source}`").alias("source"), F.col(f"`{target}`").alias("target"))
    claims = written(asked.groupBy("target").agg(F.count("*").alias("n")).withColumns(_parsed(F.col("target"))), "claims")
    shared = asked.join(claims.filter("n > 1").select("target", "ext"), "target")
    ranked = numbered(shared, ["target"], ["source"], "place").withColumn("rank", F.col("place") - 1).drop("place")
    number = F.col("rank") + 1
    if claims.filter("number IS NOT NULL").isEmpty():  # nobody asks for a number, so none is taken
        late, lone = ranked.select("source", F.when(number > 1, number).alias("number")), None
    else:
        ranked = written(ranked, "claimants")
        shifts = _shifts(ranked.filter("ext <> ''"), claims.filter("ext <> ''"))
        gone = written(_given_away(claims).withColumn("gone", F.lit(1)), "given-away")
        # With an extension: what is passed comes on top; without: one more if the name itself is gone.
        number += F.coalesce("shift", "gone", F.lit(0))
        late = ranked.join(shifts, ["target", "rank"], "left").join(gone, "target", "left").select("source", F.when(number > 1, number).alias("number"))
        lone = asked.join(claims.filter("n = 1").select("target"), "target", "left_semi").join(gone, "target").select("source", F.lit(2).cast("long").alias("number"))
    given = (late if lone is None else late.unionByName(lone)).filter("number IS NOT NULL").select(F.col("source").alias(source), F.col("number").alias("_number"))
    found = moves.join(given, source, "left")
    to = F.col(f"`{target}`")
    return found.withColumn(final, F.when(F.col("_number").isNull(), to).otherwise(paths.suffixed(to, F.col("_number")))).drop("_number").select(*[f"`{c}`" for c in moves.columns], final)
