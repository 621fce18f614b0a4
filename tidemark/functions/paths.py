"""Path column functions. Paths are relative and use '/'; a leading dot is part of the name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import values as V


def base_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    """The directory, '' at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def ext_of(name: Column) -> Column:
    """The lower-case extension with its dot, '' if there is none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def directories(path: Column) -> Column:
    """The directory segments, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, outermost first: a/b/c.x gives [a, a/b]."""
    parts = directories(path)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def in_inbox(path: Column) -> Column:
    return F.substring_index(path, "/", 1) == V.INBOX_DIR


def is_sidecar(path: Column) -> Column:
    return ext_of(base_of(path)).isin(*V.SIDECAR_EXTENSIONS)


def looks_like_a_copy(path: Column) -> Column:
    return F.trim(stem_of(base_of(path))).rlike(V.COPY_MARKER)


def is_junk_name(name: Column) -> Column:
    return F.lower(name).isin(*V.JUNK_NAMES) | ext_of(name).isin(*V.JUNK_EXTENSIONS)


def is_date_structure(segment: Column) -> Column:
    """Whether nothing but years, season words and separators makes up a directory name."""
    rest = F.regexp_replace(segment, r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?=[^0-9]|$)", " ")
    rest = F.regexp_replace(F.regexp_replace(rest, "(?iu)(зима|весна|лето|осень)", " "), r"(?U)[\s_\-.,()]+", "")
    return (rest == "") & segment.rlike("(?iu)[0-9]|зима|весна|лето|осень")


def is_technical(segment: Column) -> Column:
    """Whether a directory name was given by a device, a program or the planned layout."""
    s = F.regexp_replace(segment, r"(?U)^\s+|\s+$", "")
    return (s == "") | F.lower(s).isin(*V.TECHNICAL_DIRS, *V.LAYOUT_DIRS) | s.rlike(V.DEVICE_DUMP) | is_date_structure(s)


def custom_dirs(path: Column) -> Column:
    """The directories that somebody named."""
    return F.filter(directories(path), lambda s: ~is_technical(s))


def suspicion(segment: Column) -> Column:
    """'placeholder' or 'device' for a name that needs a decision, else null; careless names (no letters, hashes) are fine."""
    s = F.regexp_replace(F.coalesce(segment, F.lit("")), r"(?U)^\s+|\s+$", "")
    careless = s.rlike(r"^[^\p{L}]+$") | s.rlike("(?i)^[0-9a-f]{8,}$")
    return F.when(careless, None).when(F.lower(s).isin(*V.PLACEHOLDER_DIRS), "placeholder").when(F.lower(s).isin(*V.DEVICE_DIRS), "device")


def strip_review(path: Column) -> Column:
    return F.regexp_replace(path, f"^{V.REVIEW_DIR}/", "")


def is_quarantined(path: Column) -> Column:
    parts = F.split(path, "/")
    return (F.size(parts) > 2) & (F.get(parts, F.lit(0)) == V.GLOBAL_OTHER) & F.get(parts, F.lit(1)).isin(V.JUNK_DIR, V.DUPES_DIR)


def flat_name(path: Column) -> Column:
    """A name that keeps the whole path, for files that leave their directory."""
    return F.when(is_quarantined(path), base_of(path)).otherwise(F.replace(path, F.lit("/"), F.lit("__")))


def suffixed(path: Column, n: Column) -> Column:
    """The n-th claimant's path: ` (n)` before the extension of the name."""
    name = base_of(path)
    head = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    ext = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    return F.concat(head, stem_of(name), F.lit(" ("), n.cast("string"), F.lit(")"), ext)


def normalized(path: Column) -> Column:
    """For comparisons: one kind of separator, no doubled or final one, no long-path prefix, lower case."""
    p = F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\\\\\")
    p = F.regexp_replace(p, r"^\\\\\?\\", "")
    p = F.replace(p, F.lit("/"), F.lit("\\"))
    p = F.regexp_replace(p, r"(?<!^)\\{2,}", r"\\\\")
    return F.lower(F.regexp_replace(p, r"(?<=[^:\\])\\$", ""))


def plain_form(path: Column) -> Column:
    """A path without the prefix for long ones."""
    return F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\\\\\"), r"^\\\\\?\\", "")


def extended_form(path: Column, limit: int = V.LONG_PATH) -> Column:
    """An absolute path of `limit` characters or more with the prefix for long ones; others, and those that have it, as they are.

    The prefix turns off the system's own reading of a path, so separators, `.` and `..` are settled before.
    """
    back = F.replace(path, F.lit("/"), F.lit("\\"))
    unc, drive = back.rlike(r"^\\\\[^\\]"), back.rlike(r"^[A-Za-z]:\\")
    segments = F.split(F.substring(back, F.when(unc, 3).otherwise(4), F.length(back)), r"\\")
    empty = F.array().cast("array<string>")
    settled = F.aggregate(segments, empty, lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    body = F.array_join(settled, "\\")
    long = (F.length(path) >= limit) & ~path.startswith("\\\\?\\")
    return F.when(long & unc, F.concat(F.lit("\\\\?\\UNC\\"), body)).when(long & drive, F.concat(F.lit("\\\\?\\"), F.substring(back, 1, 3), body)).otherwise(path)


def same_path(a: Column, b: Column) -> Column:
    return normalized(a) == normalized(b)


def is_inside(child: Column, parent: Column) -> Column:
    c, p = normalized(child), normalized(parent)
    return (c != p) & c.startswith(F.when(p.endswith("\\"), p).otherwise(F.concat(p, F.lit("\\"))))
