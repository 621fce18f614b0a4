"""What a library's root says of its own state: receipt, decisions, inbox, years, runs that can be undone.

These are a handful of small files that one writer keeps, so they are written by the driver; counts of
files and of open decisions come from tables.
"""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import values as V
from tidemark.sources import texts
from tidemark.sources.inventory import RECEIPT, RUNS_DIR
from tidemark.streaming import journal

DECISIONS = "decisions.txt"
_TITLE = "Runs in effect in this folder, the latest first. The file goes when the last of them is undone."
_HELP = (
    "# Folders whose names don't tell what is in them. They are kept aside whole until you decide.",
    f"# After the sign = write {V.SORT_ANSWERS[0]} (or sort) to sort what is inside, {V.AS_IS_ANSWERS[0]} (or keep) to leave the folder as it is.",
)


def receipt_path(root: str) -> Path:
    return Path(root) / RECEIPT


def decisions_path(root: str) -> Path:
    return Path(root) / RUNS_DIR / DECISIONS


def _receipt(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(run_id, what the line before it says), one row for each run that is in effect."""
    if not receipt_path(root).exists():
        return []
    return [(r["run_id"], r["said"]) for r in texts.read_receipt(spark, str(receipt_path(root))).collect()]


def _write_receipt(root: str, runs: list[tuple[str, str]]) -> int:
    path = receipt_path(root)
    if not runs:
        path.unlink(missing_ok=True)
        return 0
    path.write_text("\n".join([_TITLE, ""] + [f"{said}\n    to undo it: tidemark rollback DIR {run_id}\n" for run_id, said in runs]), encoding="utf-8")
    return len(runs)


def record_run(spark: SparkSession, root: str, run_id: str, moved: int, now: datetime | None = None) -> int:
    """Put a run at the head of the receipt, once; the number of runs in effect."""
    said = f"{now or datetime.now():%d.%m.%Y, %H:%M} — files moved: {moved}"
    return _write_receipt(root, [(run_id, said), *((r, s) for r, s in _receipt(spark, root) if r != run_id)])


def forget_run(spark: SparkSession, root: str, run_id: str) -> int:
    """Take an undone run out of the receipt; one that isn't there is no error, and an empty receipt is removed."""
    return _write_receipt(root, [(r, s) for r, s in _receipt(spark, root) if r != run_id])


def decisions(spark: SparkSession, root: str) -> DataFrame:
    """(dir, decision) of the answers given so far; a folder that is named twice counts by its last answer."""
    if not decisions_path(root).exists():
        return spark.createDataFrame([], "dir string, decision string")
    given = texts.read_decisions(spark, str(decisions_path(root))).filter("readable AND decision IS NOT NULL")
    return given.groupBy("dir").agg(F.max_by("decision", "line").alias("decision"))


def pending(suspicious: DataFrame, answers: DataFrame) -> DataFrame:
    """One row (pending, answered): folders that still need a decision, and those that have one."""
    rows = suspicious.select("dir").join(answers.select("dir", "decision"), "dir", "left")
    return rows.agg(F.count_if(F.col("decision").isNull()).alias("pending"), F.count_if(F.col("decision").isNotNull()).alias("answered"))


def save_decisions(spark: SparkSession, root: str, suspicious: DataFrame) -> int:
    """Write the file of decisions anew (dir, reason, files), answers kept; the number of folders without one."""
    answers = decisions(spark, root).collect()  # the file is overwritten below, so its answers are read before
    kept = spark.createDataFrame([tuple(r) for r in answers], "dir string, decision string")
    path = decisions_path(root)
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = texts.decision_lines(suspicious, kept).join(suspicious.select("dir", "reason", "files"), "dir").orderBy("dir")
    with open(path.with_suffix(".new"), "w", encoding="utf-8") as file:
        file.write("\n".join([*_HELP, "", ""]))
        for row in lines.toLocalIterator():
            file.write(f"# {row['reason']}, files: {row['files']}\n{row['line']}\n\n")
    path.with_suffix(".new").replace(path)
    return pending(suspicious, kept).first()["pending"]


def is_year(name: Column) -> Column:
    return name.rlike(r"^(19|20)[0-9]{2}$")


def years(dirs: DataFrame) -> DataFrame:
    """(year) of the year folders at the root, the latest first. dirs: dir."""
    return dirs.filter(is_year(F.col("dir"))).select(F.col("dir").alias("year")).distinct().orderBy(F.desc("year"))


def shape(spark: SparkSession, root: str, dirs: DataFrame) -> dict:
    """Whether the root is a library (it has a receipt), its years and its number of runs in effect."""
    runs = len(_receipt(spark, root))
    return {"library": runs > 0, "years": [r["year"] for r in years(dirs).collect()], "runs": runs}


def in_inbox(path: Column) -> Column:
    return path.startswith(f"{V.INBOX_DIR}/")


def inbox(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """One row (exists, files): whether the inbox is a folder, and the files at any depth below it."""
    there = dirs.agg(F.coalesce(F.bool_or(F.col("dir") == V.INBOX_DIR), F.lit(False)).alias("exists"))
    return there.crossJoin(files.agg(F.count_if(in_inbox(F.col("path"))).alias("files")))  # one row each


def create_inbox(root: str) -> Path:
    """Make the inbox; one that is there is left alone, a root that isn't there is an error and isn't made."""
    if not Path(root).is_dir():
        raise NotADirectoryError(root)
    path = Path(root) / V.INBOX_DIR
    path.mkdir(exist_ok=True)
    return path


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The history of the runs below a root, from their journals and manifests; no rows where there are none."""
    folder = Path(root) / RUNS_DIR
    empty = spark.createDataFrame([], schemas.JOURNAL)
    records = texts.read_journals(spark, f"{folder}/*/journal.jsonl").filter("state = 'ok'") if any(folder.glob("*/journal.jsonl")) else empty
    backed = spark.read.schema(schemas.MANIFEST).json(f"{folder}/*/manifest.jsonl") if any(folder.glob("*/manifest.jsonl")) else None
    return journal.run_history(records, backed)


def undoable(spark: SparkSession, root: str, run_id: str) -> str | None:
    """Why a run can't be undone ('not-found', 'outside', 'not-undoable'), or None where it can."""
    if not run_id.strip():
        return "not-found"
    top, folder = Path(root).resolve(), (Path(root) / RUNS_DIR / run_id).resolve()
    if not folder.exists():
        return "not-found"
    if top not in folder.parents:
        return "outside"
    asked = spark.createDataFrame([(run_id,)], "run_id string")
    return journal.refusals(asked, read_runs(spark, root)).first()["reason"]


def blocking_run(spark: SparkSession, root: str) -> str | None:
    """The oldest real run without an end: a new one has to wait until it is resumed or rolled back."""
    row = read_runs(spark, root).filter("NOT finished AND NOT dry_run").orderBy("started_at", "run_id").select("run_id").first()
    return row["run_id"] if row else None
