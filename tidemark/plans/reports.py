"""Plain-text reports: lines are made by tasks and come to the reader one partition at a time, in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.plan import Plan


def family_phrase(model: Column, matched_by: Column, first_year: Column, last_year: Column, no_later: Column) -> Column:
    """What is known of the camera of a picture without a capture date: its model, its neighbours' years, a latest month."""
    how = F.when(matched_by == "geometry", " (by the size of the frame)").otherwise("")
    span = F.when(first_year == last_year, first_year.cast("string")).otherwise(F.concat_ws("–", first_year.cast("string"), last_year.cast("string")))
    known = F.concat(F.lit("family "), model, how)
    near = F.when(model.isNotNull() & first_year.isNotNull(), F.concat(F.lit("neighbours of the same camera: "), span))
    return F.concat_ws(", ", F.coalesce(known, F.lit("camera unknown")), near, F.concat(F.lit("taken no later than "), no_later))


def operation_lines(operations: DataFrame) -> DataFrame:
    """(to, from, line) of moves: where from, where to and why."""
    note = F.concat_ws("; ", "reason", F.concat(F.lit("copy of "), "duplicate_of"), F.when(F.col("collision_renamed"), "renamed, the name was taken"))
    return operations.select("to", "from", F.concat(F.lit("  "), "from", F.lit(" -> "), "to", F.lit(" ["), note, F.lit("]")).alias("line"))


def _section(title: str, rows: DataFrame, *order: str) -> Iterator[str]:
    """A heading and the rows' `line`s, or nothing where there are none."""
    for n, row in enumerate(rows.orderBy(*order).toLocalIterator()):
        if n == 0:
            yield f"\n{title}"
        yield row["line"]


def plan_report(plan: Plan, root: str) -> Iterator[str]:
    """The lines of a plan's report: numbers first, then a section for each table that has rows."""
    counts = {r["what"]: r["n"] for r in plan.counts().collect()}
    yield f"Plan for {root}"
    yield ", ".join(f"{what} {n}" for what, n in counts.items())
    if not counts["operations"]:
        yield "Everything is in its place."
    yield from _section("Moves", operation_lines(plan.operations), "to", "from")
    groups = plan.duplicates.select("keeper", F.concat(F.lit("  "), "keeper", F.lit(": "), "reason").alias("line"))
    yield from _section("Kept of equal files", groups, "keeper")
    disputed = plan.disputed.select("path", "issue", "seq", F.concat_ws(" ", F.lit(" "), "path", "issue", "detail").alias("line"))
    yield from _section("Disputable", disputed, "path", "issue", "seq")
    held = plan.suspicious.select("dir", F.concat(F.lit("  "), "dir", F.lit(" ("), "reason", F.lit("), files: "), F.col("files").cast("string")).alias("line"))
    yield from _section("Folders that need a decision", held, "dir")
    yield from _section("Emptied folders", plan.emptied.select("dir", "level", F.concat(F.lit("  "), "dir").alias("line")), "level", "dir")


def failures_of_runs(records: DataFrame) -> DataFrame:
    """(run_id, from, to, line): moves of every run whose last word is an error."""
    last = records.filter("kind IN ('moved', 'error')").groupBy("run_id", "from", "to").agg(F.max_by(F.struct("kind", "error"), "seq").alias("r"))
    return last.filter("r.kind = 'error'").select("run_id", "from", "to", F.concat(F.lit("  "), "from", F.lit(": "), "r.error").alias("line"))


def failures(records: DataFrame, run_id: str) -> DataFrame:
    """(from, to, line) of one run."""
    return failures_of_runs(records.filter(F.col("run_id") == run_id)).select("from", "to", "line")


def apply_report(done: dict, records: DataFrame) -> Iterator[str]:
    """The lines of a run's report, with what failed and how to undo it."""
    yield f"Run {done['run_id']}: moved {done['moved']}, failed {done['failed']}, folders removed {done['removed']}"
    yield from _section("Not moved", failures(records, done["run_id"]), "from")
    yield f"To undo it: tidemark rollback DIR {done['run_id']}"


def rollback_report(done: dict) -> Iterator[str]:
    yield f"Run {done['run_id']} undone: restored {done['restored']}, failed {done['failed']}"
    if done["failed"]:
        yield "What failed stays where the run had put it; the journal names it. The rollback can be repeated."


def unfinished_warning(unfinished: DataFrame) -> Iterator[str]:
    """What each run without an end had done, the oldest first; nothing where there is none."""
    for row in unfinished.toLocalIterator():
        yield f"Run {row['run_id']} of {row['started_at']} has no end: moved {row['moved']} of {row['planned']} announced. Resume it (apply DIR {row['run_id']}) or undo it (rollback DIR {row['run_id']}) first."


def remaining(operations: DataFrame, failed: DataFrame) -> DataFrame:
    """Moves of a plan that took place: all but the failed ones (from, to)."""
    return operations.join(failed.select("from", "to"), ["from", "to"], "left_anti")
