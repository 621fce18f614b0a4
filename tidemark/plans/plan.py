"""The reorganisation plan: held folders, moves, collisions, emptied folders, counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.functions import values as V
from tidemark.operators import dedupe, tree
from tidemark.plans import buckets, names
from tidemark.sources.scratch import written


def suspicious_dirs(assets: DataFrame) -> DataFrame:
    """(dir, reason, files): the outermost directory of each asset that needs a decision, with its number of assets."""
    found = suspicious_of(assets)
    return found.groupBy("dir", "reason").agg(F.count("*").alias("files"))


def suspicious_of(assets: DataFrame) -> DataFrame:
    """(path, dir, reason) of each asset that lies in such a directory."""
    parts = F.transform(paths.directories(F.col("path")), lambda s, i: F.struct(i.alias("i"), F.when(~paths.is_technical(s), paths.suspicion(s)).alias("reason")))
    first = F.get(F.filter(parts, lambda p: p["reason"].isNotNull()), F.lit(0))
    rows = assets.filter("kind <> 'other'").select("path", first.alias("first")).filter("first IS NOT NULL")
    return rows.select("path", F.array_join(F.slice(paths.directories(F.col("path")), 1, F.col("first.i") + 1), "/").alias("dir"), "first.reason")


def scattered(suspicious: DataFrame, bucketed: DataFrame) -> DataFrame:
    """(dir, reason, files) of the suspicious directories whose assets would go to more than one place; staying is a place.

    suspicious: path, dir, reason. bucketed: path, action and segments.
    """
    place = F.when(F.col("action") == "stay", F.lit("")).otherwise(F.array_join(F.slice("segments", 1, 2), "/"))
    rows = suspicious.join(bucketed.select("path", place.alias("place")), "path")
    return rows.groupBy("dir", "reason").agg(F.count("*").alias("files"), F.count_distinct("place").alias("places")).filter("places > 1").drop("places")


def held_by(assets: DataFrame, held: DataFrame) -> DataFrame:
    """(path, dir): the held directory nearest to the root above each asset. Found once for each directory, by an equi-join with its ancestors."""
    rows = assets.select("path", paths.dir_of(F.col("path")).alias("_own"))
    up = rows.select("_own").distinct().select("_own", F.posexplode(paths.ancestors(F.concat("_own", F.lit("/")))).alias("level", "dir"))
    first = up.join(held.select("dir"), "dir", "left_semi").groupBy("_own").agg(F.min_by("dir", "level").alias("dir"))
    return rows.join(first, "_own").select("path", "dir")


def collisions(moves: DataFrame, source: str = "from", target: str = "to") -> DataFrame:
    """Adds `final`: later claimants of a target (by source) get ` (n)` with the first free n from 2 on."""
    return names.free_names(moves, source, target)


def emptied_dirs(dirs: DataFrame, survivors: DataFrame) -> DataFrame:
    """(dir, level): directories with nothing left below, deepest first. survivors: path (stays, targets, in place)."""
    used = tree.roll_up(survivors.select(paths.dir_of(F.col("path")).alias("dir"), F.lit(1).cast("long").alias("files")).filter("dir <> ''"))
    kept = used.select(paths.normalized(F.col("dir")).alias("key")).distinct()
    rows = dirs.select("dir", paths.normalized(F.col("dir")).alias("key")).filter(F.col("dir") != V.INBOX_DIR)
    return rows.join(kept, "key", "left_anti").select("dir", F.size(F.split("dir", "/")).alias("level")).orderBy(F.desc("level"), F.desc("dir"))


@dataclass
class Plan:
    """Tables of a plan; every one has a total order of its own."""

    operations: DataFrame
    stay: DataFrame
    in_place: DataFrame
    duplicates: DataFrame
    disputed: DataFrame
    suspicious: DataFrame
    emptied: DataFrame

    def counts(self) -> DataFrame:
        """(what, n): one row for each table."""
        named = (("operations", self.operations), ("stay", self.stay), ("in_place", self.in_place), ("duplicates", self.duplicates), ("disputed", self.disputed), ("suspicious", self.suspicious), ("emptied", self.emptied), ("collisions", self.operations.filter("collision_renamed")))
        out = None
        for what, df in named:
            row = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
            out = row if out is None else out.unionByName(row)
        return out


def build_plan(assets: DataFrame, verdicts: DataFrame, dirs: DataFrame, decisions: DataFrame | None = None) -> Plan:
    """assets: path, kind, sha256; dirs: dir; decisions: dir, decision ('sort' or 'as-is')."""
    groups = dedupe.duplicate_groups(assets, verdicts)
    copied = dedupe.copies(assets, groups)
    rows = assets.select(F.col("path").alias("from"), paths.strip_review(F.col("path")).alias("path"), "kind", "sha256")
    rows = rows.join(verdicts.withColumnRenamed("path", "from"), "from", "left").join(copied.select(F.col("path").alias("from"), F.col("keeper").alias("duplicate_of")), "from", "left").withColumn("is_copy", F.col("duplicate_of").isNotNull())
    made = written(buckets.bucketed(written(rows, "assets")), "buckets")
    marked = written(scattered(suspicious_of(made.select("path", "kind")), made), "suspicious")
    decided = marked if decisions is None else marked.join(decisions, "dir", "left").filter("NOT (decision <=> 'sort')")
    held = held_by(made.select("path", "kind").filter("kind <> 'other'"), decided).withColumnRenamed("dir", "review")
    made = written(made.join(held, "path", "left"), "held")  # every table of the plan is made of it
    to = F.when(F.col("review").isNotNull(), F.concat(F.lit(f"{V.REVIEW_DIR}/"), F.col("path"))).otherwise(buckets.target())
    stays = (F.col("action") == "stay") & F.col("review").isNull()
    moving = made.filter(~stays).withColumn("to", to)
    same = paths.same_path(F.col("from"), F.col("to"))
    moves = collisions(moving.filter(~same).select("from", "to", "kind", "why", "duplicate_of", "review"))
    operations = moves.select(F.lit("move").alias("op"), "from", F.col("final").alias("to"), "kind", F.when(F.col("review").isNotNull(), "held").otherwise(F.col("why")).alias("reason"), "duplicate_of", "review", (F.col("final") != F.col("to")).alias("collision_renamed"))
    operations = written(operations, "operations")
    issues = made.filter("review IS NULL AND issue IS NOT NULL").select(F.col("from").alias("path"), "issue", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("detail"))
    overruled = made.filter("review IS NULL").select(F.col("from").alias("path"), F.posexplode("disputed").alias("seq", "d")).select("path", F.col("d.reason").alias("issue"), (F.col("seq") + 1).alias("seq"), F.concat_ws(" ", "d.kind", "d.detail").alias("detail"))
    stay, in_place = made.filter(stays).select("from"), moving.filter(same).select("from")
    survivors = stay.unionByName(in_place).select(F.col("from").alias("path")).unionByName(operations.select(F.col("to").alias("path")))
    return Plan(operations.orderBy("to", "from"), stay.orderBy("from"), in_place.orderBy("from"), groups.orderBy("keeper"), issues.unionByName(overruled).orderBy("path", "issue", "seq"), marked.orderBy("dir"), emptied_dirs(dirs, survivors))
