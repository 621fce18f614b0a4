"""Command line: python -m tidemark.cli scan|plan|apply|rollback DIR."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime
from pathlib import Path


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("command", choices=("scan", "plan", "apply", "rollback"))
    parser.add_argument("root")
    parser.add_argument("run_id", nargs="?", help="rollback: the run; apply: an unfinished run to resume")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--allow-no-snapshot", action="store_true")
    parser.add_argument("--no-pixels", action="store_true", help="don't look for the originals of saved pictures by their pixels")
    parser.add_argument("--no-cache", action="store_true", help="read every file, and leave the cache of the last scan alone")
    said = parser.parse_args(args)
    if not Path(said.root).is_dir():
        print(f"{said.root} is no directory", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from tidemark import engine
    from tidemark.plans import reports
    from tidemark.sources import cache, library, metadata, texts
    from tidemark.sources.inventory import RUNS_DIR
    from tidemark.sources.scratch import written

    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tell = lambda lines: [print(line) for line in lines]
    if said.command == "rollback":
        if not said.run_id:
            parser.error("rollback needs a run id")
        if library.undoable(spark, said.root, said.run_id) in ("not-found", "outside"):
            print(f"{said.run_id} is no run of {said.root}", file=sys.stderr)
            return 2
        done = engine.roll_back(said.root, said.run_id, said.dry_run)
        if not said.dry_run and not done["failed"]:
            library.forget_run(spark, said.root, said.run_id)
        tell([json.dumps(done)] if said.json else reports.rollback_report(done))
        return 1 if done["failed"] else 0
    open_run = library.blocking_run(spark, said.root)
    if said.command == "apply" and not said.dry_run and open_run and said.run_id != open_run:
        tell(reports.unfinished_warning(library.read_runs(spark, said.root).filter("NOT finished AND NOT dry_run").orderBy("started_at", "run_id")))
        return 3
    cached = None if said.no_cache else cache.load(spark, cache.path_of(said.root))
    found = engine.scan(spark, said.root, cached)
    if not said.no_cache:
        found.assets = written(found.assets, "assets")  # the cache that it may be read from is replaced
        cache.save(found.assets, cache.path_of(said.root))
    raw = metadata.read_raw(found.assets, said.root)
    verdicts = engine.annotate(found.assets, datetime.now().year, raw, None if said.no_pixels else said.root)
    if said.command == "scan":
        for row in verdicts.orderBy("path").toJSON().toLocalIterator():
            print(row)
        return 0
    plan = engine.make_plan(found, verdicts, library.decisions(spark, said.root))
    if said.command == "plan":
        tell(plan.operations.toJSON().toLocalIterator() if said.json else reports.plan_report(plan, said.root))
        library.save_decisions(spark, said.root, plan.suspicious)
        return 0
    done = engine.apply(said.root, plan, said.dry_run, not said.allow_no_snapshot, said.run_id, found)
    if not said.dry_run and done["moved"]:
        library.record_run(spark, said.root, done["run_id"], done["moved"])
    records = texts.read_journals(spark, f"{said.root}/{RUNS_DIR}/{done['run_id']}/journal.jsonl").filter("state = 'ok'")
    tell([json.dumps(done)] if said.json else reports.apply_report(done, records))
    return 1 if done["failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
