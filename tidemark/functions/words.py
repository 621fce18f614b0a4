"""Numbers, sizes and durations in words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import values as V


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Russian number agreement."""
    n = F.abs(n.cast("long"))
    return F.when((n % 100).between(11, 14), many).when(n % 10 == 1, one).when((n % 10).between(2, 4), few).otherwise(many)


def counted(n: Column, one: str, few: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("long").cast("string"), plural(n, one, few, many))


def human_bytes(n: Column, units: Sequence[str] = V.BYTE_UNITS) -> Column:
    """1024-based sizes, the last unit without an upper limit: whole numbers from 100 on and for bytes, else one decimal."""
    out = None
    for i, unit in enumerate(units):
        value = n / float(1024**i)
        text = F.round(value).cast("long").cast("string")
        if i:
            text = F.when(value >= 100, text).otherwise(F.format_string("%.1f", value))
        text = F.concat(text, F.lit(f" {unit}"))
        last = i + 1 == len(units)
        out = (F.when(n.isNull() | (n < 0), "?") if out is None else out)
        out = out.otherwise(text) if last else out.when(n < float(1024 ** (i + 1)), text)
    return out


def human_duration(ms: Column) -> Column:
    s = F.round(ms / 1000).cast("long")
    m = F.floor(s / 60)
    return (
        F.when(ms.isNull() | (ms < 0), "?").when(s < 60, F.format_string("%d с", s)).when(m < 60, F.format_string("%d мин %d с", m, s % 60))
        .otherwise(F.format_string("%d ч %d мин", F.floor(m / 60), m % 60))
    )
