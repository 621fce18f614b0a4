"""Explicit schemas; nothing is inferred from JSON."""

from __future__ import annotations

from pyspark.sql import types as T

from tidemark.functions.dates import WALL

ASSET = "path string, size bigint, mtime_ms double, kind string, format string, sha256 string"
FACTS = "path string, software string, make string, model string, width int, height int, document_id string, derived_from string, editor boolean"
EVIDENCE = f"path string, source_ord int, seq int, kind string, rank int, confidence string, wall {WALL}, instant timestamp, date_only boolean, detail string, season string, discounted boolean"
DISPUTE = "array<struct<kind:string,detail:string,reason:string>>"
VERDICT = f"path string, status string, date string, date_only boolean, instant timestamp, year int, season string, confidence string, winner string, corroborated array<string>, assumed boolean, disputed {DISPUTE}"
OPERATION = "`op` string, `from` string, `to` string, kind string, reason string, duplicate_of string, review string, collision_renamed boolean"
JOURNAL = "run_id string, seq bigint, kind string, ts timestamp, `from` string, `to` string, dir string, error string, dry_run boolean"
MANIFEST = "run_id string, path string, size bigint, mtime_ms double, sha256 string, dir boolean"
SCAN_CACHE = "path string, size bigint, mtime_ms double, kind string, format string, sha256 string"
SCAN_CACHE_VERSION = 1


def struct(ddl: str) -> T.StructType:
    """A schema text as a type (needs a session)."""
    return T.StructType.fromDDL(ddl)
