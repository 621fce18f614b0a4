"""Event logs of runs: what finished, what can be undone, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_history(records: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(run_id, started_at, finished, dry_run, planned, moved, last_seq, has_backup, undoable); one aggregation over the records."""
    kinds = lambda k: F.count_if(F.col("kind") == k)
    runs = records.groupBy("run_id").agg(
        F.min("ts").alias("started_at"), F.bool_or(F.col("kind") == "done").alias("finished"), F.bool_or(F.coalesce("dry_run", F.lit(False))).alias("dry_run"),
        kinds("planned-move").alias("planned"), kinds("moved").alias("moved"), F.max("seq").alias("last_seq"),
    )
    if manifests is None:
        runs = runs.withColumn("has_backup", F.lit(False))
    else:
        backed = manifests.select("run_id").distinct().withColumn("has_backup", F.lit(True))
        runs = runs.join(backed, "run_id", "left").withColumn("has_backup", F.coalesce("has_backup", F.lit(False)))
    return runs.withColumn("undoable", ~F.col("dry_run") & F.col("finished") & F.col("has_backup"))


def unfinished_runs(records: DataFrame) -> DataFrame:
    """Real runs without an end, the oldest first."""
    return run_history(records).filter("NOT finished AND NOT dry_run").select("run_id", "started_at", "planned", "moved", "last_seq").orderBy("started_at", "run_id")


def refusals(asked: DataFrame, history: DataFrame) -> DataFrame:
    """(run_id, reason) of asked runs: 'not-found', 'not-undoable', or null for one that can be undone."""
    known = history.select("run_id", "undoable")
    return asked.select("run_id").distinct().join(known, "run_id", "left").select("run_id", F.when(F.col("undoable").isNull(), "not-found").when(~F.col("undoable"), "not-undoable").alias("reason"))


def unconfirmed_moves(records: DataFrame) -> DataFrame:
    """(run_id, seq, from, to) of planned moves that no record confirms; only the disk can tell whether they happened."""
    planned = records.filter("kind = 'planned-move'").select("run_id", "seq", "from", "to")
    return planned.join(records.filter("kind = 'moved'").select("run_id", "from", "to"), ["run_id", "from", "to"], "left_anti")


def rollback_order(records: DataFrame) -> DataFrame:
    """(run_id, seq, from, to, confirmed): confirmed moves from the last to the first, then the unconfirmed ones."""
    moved = records.filter("kind = 'moved'").select("run_id", "seq", "from", "to", F.lit(True).alias("confirmed"))
    open_moves = unconfirmed_moves(records).select("run_id", "seq", "from", "to", F.lit(False).alias("confirmed"))
    return moved.unionByName(open_moves).orderBy("run_id", F.desc("confirmed"), F.desc("seq"))


def dirs_to_restore(records: DataFrame) -> DataFrame:
    """Removed directories, the shallowest first."""
    return records.filter("kind = 'rmdir'").select("run_id", "dir").distinct().orderBy("run_id", F.size(F.split("dir", "/")), "dir")


def dirs_to_prune(records: DataFrame) -> DataFrame:
    """Created directories, the deepest first; each is removed only if it is empty."""
    return records.filter("kind = 'mkdir'").select("run_id", "dir").distinct().orderBy("run_id", F.desc(F.size(F.split("dir", "/"))), F.desc("dir"))
