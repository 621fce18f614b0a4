"""Runs as they go on: journals as a stream, one small state for each run, a timer for runs that stall.

The state of a run is what `journal.run_history` says of it, so the last row that the stream gives of a run equals
the batch's. The stream's checkpoint keeps it over restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark import schemas
from tidemark.sources import lines

STATE = "started long, finished boolean, dry_run boolean, planned long, moved long, failed long, last_seq long"
RUN = f"run_id string, {STATE}, stalled boolean"
_RUN = Row(*[x.split()[0] for x in RUN.split(", ")])
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def records(spark: SparkSession, path: str, split: int = lines.SPLIT) -> DataFrame:
    """JOURNAL records as they are appended below path (a pattern); lines that can't be read are left out."""
    parsed = lines.stream_lines(spark, path, split).select(F.from_json("text", schemas.struct(schemas.JOURNAL.replace("`", "")), {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.filter("r.kind IS NOT NULL").select("r.*")


class Progress(StatefulProcessor):
    """Counts of a run; a run without an end that says nothing for `patience` milliseconds is told of once more as stalled."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        started, finished, dry, planned, moved, failed, last = self.state.get() if self.state.exists() else (None, False, False, 0, 0, 0, None)
        for row in rows:
            started = row.at if started is None else min(started, row.at if row.at is not None else started)
            finished, dry = finished or row.kind == "done", dry or bool(row.dry_run)
            planned, moved, failed = planned + (row.kind == "planned-move"), moved + (row.kind == "moved"), failed + (row.kind == "error")
            last = row.seq if last is None else max(last, row.seq if row.seq is not None else last)
        told = (started, finished, dry, planned, moved, failed, last)
        self.state.update(told)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not finished:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield _RUN(*key, *told, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield _RUN(*key, *self.state.get(), True)

    def close(self) -> None:
        pass


def progress(found: DataFrame, patience: int = 600_000) -> DataFrame:
    """RUN rows of a stream of records (started_at as a timestamp), in update mode: each run when something is said of it, and when it stalls."""
    found.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = found.select("run_id", "seq", "kind", "dry_run", F.unix_micros("ts").alias("at"))
    runs = rows.groupBy("run_id").transformWithState(Progress(patience), RUN, outputMode="update", timeMode="ProcessingTime")
    return runs.withColumn("started", F.timestamp_micros("started")).withColumnRenamed("started", "started_at")
