"""Calendar column functions. Wall clocks are structs of six integers and never become timestamps:
second 60 is valid and has to stay what it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import values as V

WALL = "struct<year:int,month:int,day:int,hour:int,minute:int,second:int>"
_PARTS = ("year", "month", "day", "hour", "minute", "second")


def days_in_month(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def is_valid_wall(year, month, day, hour=None, minute=None, second=None) -> Column:
    zero = F.lit(0)
    hour, minute, second = (zero if c is None else c for c in (hour, minute, second))
    return year.between(1, 9999) & month.between(1, 12) & (day >= 1) & (day <= days_in_month(year, month)) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60)


def wall(*parts: Column) -> Column:
    """The wall clock of up to six parts, null if they are no valid time or one is null."""
    parts = [p.cast("int") for p in parts] + [F.lit(0)] * (6 - len(parts))
    return F.when(is_valid_wall(*parts), F.struct(*[p.alias(n) for p, n in zip(parts, _PARTS, strict=True)]))


def wall_of_instant(ts: Column) -> Column:
    """The UTC wall clock of a timestamp."""
    return F.struct(*[f(ts).cast("int").alias(n) for f, n in zip((F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second), _PARTS, strict=True)])


def format_wall(w: Column) -> Column:
    pad = lambda name, n: F.lpad(w[name].cast("string"), n, "0")
    return F.when(w.isNotNull(), F.concat(pad("year", 4), F.lit("-"), pad("month", 2), F.lit("-"), pad("day", 2), F.lit(" "), pad("hour", 2), F.lit(":"), pad("minute", 2), F.lit(":"), pad("second", 2)))


def is_plausible_year(year: Column, now_year: int) -> Column:
    return year.between(V.MIN_YEAR, now_year + V.FUTURE_YEARS)


def is_reset_clock(w: Column) -> Column:
    return w.isNotNull() & (w["month"] == 1) & (w["day"] == 1) & (w["hour"] == 0)


def epoch_instant(digits: Column, now_year: int) -> Column:
    """The instant of 10 (seconds) or 13 (milliseconds) digits, null outside the years that epoch names can have."""
    number = digits.cast("long")
    instant = F.timestamp_millis(F.when(F.length(digits) == 13, number).otherwise(number * 1000))
    return F.when(F.year(instant).between(V.EPOCH_MIN_YEAR, now_year + V.FUTURE_YEARS), instant)


def claim_year(w: Column, instant: Column) -> Column:
    return F.coalesce(w["year"], F.year(instant))


def season_of_month(month: Column) -> Column:
    """Five seasons (winter is two); an impossible month is an error."""
    return (
        F.when(month.isNull(), None).when(month.between(1, 2), V.WINTER_START).when(month.between(3, 5), V.SPRING).when(month.between(6, 8), V.SUMMER)
        .when(month.between(9, 11), V.AUTUMN).when(month == 12, V.WINTER_END).otherwise(F.raise_error(F.lit("month must be 1..12")))
    )


def near_season_boundary(instant: Column) -> Column:
    """Whether a UTC instant lies within 12 hours of the start of a season."""
    month, day, hour = F.month(instant), F.dayofmonth(instant), F.hour(instant)
    starts = lambda m: m.isin(1, 3, 6, 9, 12)
    at_start = (day == 1) & starts(month) & (hour < V.BOUNDARY_HOURS)
    at_end = (day == F.dayofmonth(F.last_day(instant))) & starts(month % 12 + 1) & (hour >= 24 - V.BOUNDARY_HOURS)
    return F.coalesce(at_start | at_end, F.lit(False))


def date_in_words(text: Column, instant: Column) -> Column:
    """`day month year`, and the time unless it is midnight, from a wall text or a UTC instant."""
    full = F.coalesce(text, F.date_format(instant, "yyyy-MM-dd HH:mm:ss"))
    part = lambda at, n: F.substring(full, at, n)
    month = F.element_at(F.array(*map(F.lit, V.MONTHS_GENITIVE)), part(6, 2).cast("int"))
    day = F.concat_ws(" ", part(9, 2).cast("int"), month, part(1, 4).cast("int"))
    return F.when((part(12, 2) == "00") & (part(15, 2) == "00"), day).otherwise(F.concat(day, F.lit(", "), part(12, 5)))
