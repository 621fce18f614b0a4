"""Small text and JSON-lines files: run journals, manifests, folder decisions, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import values as V
from tidemark.sources import lines


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text files. A file is one value here, so the number of a line doesn't hang on how files are split."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("i", "text")).select("file", (F.col("i") + 1).alias("line"), "text")


def read_journals(spark: SparkSession, path: str, split: int = lines.SPLIT) -> DataFrame:
    """JOURNAL records with `file`, `line` and `state`: 'ok', 'truncated' (a torn last line) or 'broken' (any other bad line).

    A journal may be of any size: it is read in ranges of `split` bytes. path may be a pattern; every worker has to see the files.
    """
    rows = lines.read_lines(spark, path, split).filter(F.trim("text") != "")
    parsed = rows.withColumn("r", F.from_json("text", schemas.struct(schemas.JOURNAL.replace("`", "")), {"mode": "PERMISSIVE"}))
    last = parsed.groupBy("file").agg(F.max("line").alias("last"))
    good = F.col("r.kind").isNotNull()
    state = F.when(good, "ok").when(F.col("line") == F.col("last"), "truncated").otherwise("broken")
    return parsed.join(last, "file").select("file", "line", state.alias("state"), "r.*")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(line, text, dir, decision, readable): 'sort' or 'as-is', null if unanswered; what can't be read is reported, never guessed."""
    rows = numbered_lines(spark, path).withColumn("said", F.trim(F.substring_index("text", "#", 1))).filter("said <> ''")
    dirs = F.trim(F.substring_index("said", "=", 1))
    answer = F.lower(F.trim(F.regexp_replace("said", "^[^=]*=?", "")))
    decision = F.when(answer.isin(*V.SORT_ANSWERS), "sort").when(answer.isin(*V.AS_IS_ANSWERS), "as-is")
    readable = F.col("said").contains("=") & (dirs != "") & ((answer == "") | decision.isNotNull())
    return rows.select("line", "text", F.when(readable, dirs).alias("dir"), F.when(readable, decision).alias("decision"), readable.alias("readable"))


def decision_lines(suspicious: DataFrame, answers: DataFrame) -> DataFrame:
    """(dir, line): the file to be written again, with the answers given so far."""
    word = F.when(F.col("decision") == "sort", V.SORT_ANSWERS[0]).when(F.col("decision") == "as-is", V.AS_IS_ANSWERS[0]).otherwise("")
    rows = suspicious.join(answers.select("dir", "decision"), "dir", "left")
    return rows.select("dir", F.rtrim(F.concat("dir", F.lit(" = "), word)).alias("line")).orderBy("dir")


def read_receipt(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, said, moved): a receipt names a run in the line after the one that says what was moved."""
    from pyspark.sql import Window

    rows = numbered_lines(spark, path)
    paired = rows.withColumn("next", F.lead("text").over(Window.partitionBy("file").orderBy("line")))
    run = F.nullif(F.regexp_extract("next", V.RUN_ID, 0), F.lit(""))
    moved = F.coalesce(F.nullif(F.regexp_extract("text", r"([0-9]+)\s*$", 1), F.lit("")).cast("int"), F.lit(0))
    return paired.select("line", run.alias("run_id"), F.col("text").alias("said"), moved.alias("moved")).filter("run_id IS NOT NULL").orderBy("line").drop("line")
